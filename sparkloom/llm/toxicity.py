"""Toxicity by a classifier chain: each category's linear model also sees the earlier categories' probabilities."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

#: Categories in chain order: name, and the label column's expression.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
#: Labelled rows that models are fitted on at most; features of each category; folds.
SAMPLE, FEATURES, FOLDS = 12000, 1500, 3
_WORDS = re.compile(r"[^\W\d_]+")
_RARE = 4


def features_of(text: str | None) -> set[str]:
    """Distinct lower-case words, their beginnings of 3 to 7 letters (marked ``*``), and marks of case and symbols."""
    text = text or ""
    words = set(_WORDS.findall(text.lower()))
    out = set(words)
    for k in range(3, 8):
        out.update([w[:k] + "*" for w in words if len(w) > k])
    letters = sum(map(text.count, "aeiounrst")) + 1
    capitals = sum(map(text.count, "AEIOUNRST"))
    if capitals > letters:
        out.add("\x00capitals")
    for c in "*$%&#|!":
        if text.count(c) * 40 > len(text):
            out.add("\x00many " + c)
    return out


def _counts(batches):
    """How many rows have a feature, and how many of those are of each category."""
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            for f in features_of(text):
                own = sums[f]
                own[0] += 1
                own[1] += y[0]
                own[2] += y[1]
    rows = list(sums.items())
    for at in range(0, len(rows), 1 << 16):
        part = rows[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in part], "n": pa.array([s[0] for _, s in part], pa.int64()), "n0": pa.array([s[1] for _, s in part], pa.int64()), "n1": pa.array([s[2] for _, s in part], pa.int64())})


def _encode(shared):
    def run(batches):
        get = shared.value.get
        for batch in batches:
            own = [sorted(k for k in map(get, features_of(t)) if k is not None) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "y", "own"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Binary sparse rows, and dense columns of earlier probabilities."""

    def __init__(self, lists: list[list[int]], width: int):
        self.width = width
        self.size = np.array([len(x) for x in lists], np.int64)
        self.at = np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.size)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=len(self.size))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=r[self.row], minlength=self.width)


def fit_linear(x: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, decay: float = 2e-5, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic model (features, dense columns, bias) by full-batch adaptive steps; ``use`` marks its rows."""
    width, m = x.width, dense.shape[1]
    w = np.zeros(width + m + 1)
    w[-1] = np.log((y[use].mean() + 1e-3) / (1 - y[use].mean() + 1e-3)) if use.any() else 0.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    n = max(1, use.sum())
    for t in range(1, rounds + 1):
        r = np.where(use, _sigmoid(x.times(w[:width]) + dense @ w[width : width + m] + w[-1]) - y, 0.0) / n
        g = np.concatenate([x.back(r), dense.T @ r, [r.sum()]]) + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.08 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def fit_chain(ids: np.ndarray, lists: list[list[int]], ys: np.ndarray, width: int, folds: int = FOLDS) -> list[np.ndarray]:
    """One model a category. Later ones are trained on probabilities of earlier ones that models of other folds gave."""
    x = Rows(lists, width)
    fold = np.array([(int(i) * 2654435761 >> 8) % folds for i in ids], np.int64)
    dense = np.zeros((len(ids), 0))
    models = []
    for k in range(ys.shape[1]):
        y = ys[:, k].astype(float)
        models.append(fit_linear(x, dense, y, np.ones(len(y), bool)))
        if k + 1 < ys.shape[1]:
            outer = np.zeros(len(y))
            for f in range(folds):
                w = fit_linear(x, dense, y, fold != f)
                z = x.times(w[:width]) + dense @ w[width:-1] + w[-1]
                outer[fold == f] = _sigmoid(z[fold == f])
            dense = np.column_stack([dense, outer])
    return models


def _score(shared):
    def run(batches):
        names, models = shared.value
        get, width = names.get, len(names)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = Rows([[k for k in map(get, features_of(t)) if k is not None] for t in texts], width)
            dense = np.zeros((len(texts), 0))
            for w in models:
                z = x.times(w[:width]) + dense @ w[width:-1] + w[-1]
                dense = np.column_stack([dense, _sigmoid(z)])
            keep = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *[pa.array(dense[:, k]) for k in range(dense.shape[1])], pa.array(x.size > 0)], names=[*[batch.schema.names[k] for k in keep], *[f"p{k}" for k in range(dense.shape[1])], "known"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, bar: float = 0.4, sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """``(doc_id, p_low_quality, p_toxic, toxic)`` for each row of ``docs``.

    Models are fitted on at most ``sample`` labelled documents, those first by
    a hash of their id; ``features`` of each category by chi-square. Every
    document is scored on its whole text. Without labelled documents all
    probabilities are one half less than sure: 0.5, and nothing is toxic.

    Null or empty text has no features: it gets the base rate and is not toxic,
    whatever the rate; so is any text without a feature of the models. Labels with a
    null id or category are left out; a document labelled twice is trained on
    its highest labels, rows that share an id on one of their texts. Repeated
    rows score alike, long texts are read whole, ties in chi-square go by name. Empty tables give empty
    results; other columns do not matter.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    values = [F.max(F.expr(e)).cast("int").alias(n) for n, e in CHAIN]
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(*values)
    # ids of labelled documents only, each once: none of the sample is used up without a text
    chosen = plain.select("doc_id").join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    y = F.array(*[F.col(n) for n, _ in CHAIN]).alias("y")
    texts = plain.join(F.broadcast(settle(chosen.select("doc_id", y), "chosen")), "doc_id")
    # of rows that share an id, the first text stands for it
    taken = settle(texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")), "sample")
    totals = taken.agg(F.count("*").alias("n"), *[F.sum(F.col("y")[k]).alias(f"t{k}") for k in (0, 1)]).first()
    n = totals["n"]
    if not n:
        return plain.select("doc_id", *[F.lit(0.5).alias(f"p_{name}") for name, _ in CHAIN], F.lit(False).alias("toxic"))
    counted = taken.mapInArrow(_counts, "feature string, n long, n0 long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n") >= _RARE)
    counted = settle(counted, "features")

    def chi(k: int) -> Column:
        a, all_ = F.col(f"n{k}").cast("double"), float(totals[f"t{k}"] or 0)
        e = F.col("n") * (all_ / n)
        return (a - e) * (a - e) / (e + 1e-9)

    best = {r["feature"] for k in (0, 1) for r in counted.orderBy(chi(k).desc(), "feature").limit(features).select("feature").collect()}
    names = {f: k for k, f in enumerate(sorted(best))}
    # equal rows of the sample are collected in the order of id and features
    rows = taken.mapInArrow(_encode(spark.sparkContext.broadcast(names)), "doc_id long, y array<int>, own array<int>").orderBy("doc_id", "own").collect()
    models = fit_chain(np.array([r["doc_id"] for r in rows]), [r["own"] for r in rows], np.array([r["y"] for r in rows]), len(names))
    scored = plain.mapInArrow(_score(spark.sparkContext.broadcast((names, models))), "doc_id long, p0 double, p1 double, known boolean")
    return scored.select("doc_id", F.round("p0", 6).alias("p_low_quality"), F.round("p1", 6).alias("p_toxic"), (F.col("known") & (F.col("p1") >= bar)).alias("toxic"))

"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Text is read once: each block of documents becomes its distinct trigrams and,
for each document, how often it has which. All else works on those. The model
is made by joins on trigram counts over the whole corpus; a block then asks
for the trigrams that it has, shard by shard of the model, and sums up its
documents. So neither text nor a (document, trigram) pair is shuffled.
"""

from __future__ import annotations

import zlib
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, settle, ship
from .shingles import slices

ship(__name__)

#: Bits of a character, and the marks before a text's first and after its last one (beyond the last code point).
CHAR, OPEN, CLOSE = 21, (1 << 21) - 1, (1 << 21) - 2
#: Trigrams in a shard of the model, about.
SHARD = 1 << 16


def _small(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed byte planes."""
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T).tobytes(), 1)


def _unsmall(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    full = np.zeros((planes.shape[1], 4), np.uint8)
    full[:, : blob[0]] = planes.T
    return full.view("<u4").ravel().astype(np.int64)


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts, one for each character and one for each end; and the bounds of each text's share."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    rows = len(offsets) - 1
    size = np.diff(lead)
    line = np.full(len(chars) + 3 * rows, OPEN, np.int64)
    start = lead[:-1] + 3 * np.arange(rows)
    line[np.arange(len(chars)) + np.repeat(3 * np.arange(rows) + 2, size)] = chars
    line[start + size + 2] = CLOSE
    code = (line[:-2] << (2 * CHAR)) | (line[1:-1] << CHAR) | line[2:]
    inside = np.ones(len(code), bool)
    for k in (1, 2):  # the two that reach into the next text
        at = start + size + k
        inside[at[at < len(code)]] = False
    return code[inside], np.concatenate(([0], np.cumsum(size + 1)))


def _by_fold(batches):
    """Batches of one fold each."""
    for batch in batches:
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        for f in np.unique(fold):
            yield batch.filter(pa.array(fold == f))


def _count(batches):
    part, n = TaskContext.get().partitionId(), 0
    for batch in _by_fold(batches):
        for at, offsets, data in slices(batch.column("text")):
            codes, bounds = trigrams(offsets, data)
            names, back = np.unique(codes, return_inverse=True)
            own, times, sizes = [], [], []
            for r in range(len(bounds) - 1):
                found, count = np.unique(back[bounds[r] : bounds[r + 1]], return_counts=True)
                own.append(np.diff(found, prepend=0))
                times.append(count)
                sizes.append(len(found))
            rows = len(sizes)
            row = {
                "block": pa.array([(part << 24) + n], pa.int64()),
                "fold": batch.column("fold").slice(at, 1),
                **{c: pa.array([batch.column(c).slice(at, rows).to_pylist()], t) for c, t in (("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("marks", pa.list_(pa.int64())))},
                "tokens": pa.array([np.diff(bounds).tolist()], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "codes": pa.array([zlib.compress(np.diff(names, prepend=0).tobytes(), 1)], pa.binary()),
                "own": pa.array([_small(np.concatenate(own))], pa.binary()),
                "times": pa.array([_small(np.concatenate(times))], pa.binary()),
            }
            n += 1
            yield pa.RecordBatch.from_pydict(row)


def _codes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.int64))


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, index of the trigram in the block, and count of each entry."""
    sizes = np.array(row["sizes"], np.int64)
    steps = _unsmall(row["own"])
    first = np.cumsum(sizes) - sizes
    sums = np.cumsum(steps)
    base = np.where(first > 0, sums[np.maximum(first - 1, 0)], 0)
    return np.repeat(np.arange(len(sizes)), sizes), sums - np.repeat(base, sizes), _unsmall(row["times"])


def _each(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.slice(r, 1).to_pylist()[0]


def _train(batches):
    """Counts in trusted documents of every trigram that any document has, summed over the task."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for row in _each(batches):
        codes = _codes(row["codes"])
        doc, at, times = _entries(row)
        good = np.zeros(len(row["sizes"]), bool)
        good[row["trusted"] or []] = True
        count = np.bincount(at, weights=times * good[doc], minlength=len(codes)).astype(np.int64)
        keys, back = np.unique(np.concatenate([keys, codes]), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([sums, count]), minlength=len(keys)).astype(np.int64)
    for at in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(sums[at : at + (1 << 16)])], names=["code", "c"])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts one, two, and three or more from how many have count 1 to 4.

    Where counts are too few for the estimate, half a count.
    """
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return out[0], out[1], out[2]


def _minus(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, 1 - d[0]).when(c == 2, 2 - d[1]).when(c >= 3, c - d[2]).otherwise(0.0)


def _facts(prefix: str) -> list[Column]:
    return [F.sum("c").alias(f"{prefix}_all"), *[F.count_if(F.col("c") == k).alias(f"{prefix}_{k}") for k in (1, 2)], F.count_if(F.col("c") >= 3).alias(f"{prefix}_3")]


def _mass(prefix: str, d: tuple[float, float, float]) -> Column:
    return sum((F.col(f"{prefix}_{k}") * d[k - 1] for k in (1, 2, 3)), F.lit(0.0))


def model(grams: DataFrame) -> DataFrame:
    """``(code, logp)`` for each trigram of ``(code, c)``, those with count 0 included."""
    low, mid = F.lit((1 << CHAR) - 1), F.lit((1 << 2 * CHAR) - 1)

    def seen(df: DataFrame) -> tuple[float, float, float]:
        row = df.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        return discounts([row[f"n{k}"] or 0 for k in (1, 2, 3, 4)])

    three = grams.where("c > 0")
    two = settle(three.groupBy(F.col("code").bitwiseAND(mid).alias("g2")).agg(F.count("*").alias("c")), "bigrams")
    one = settle(two.groupBy(F.col("g2").bitwiseAND(low).alias("g1")).agg(F.count("*").alias("c")), "unigrams")
    d3, d2, d1 = seen(three), seen(two), seen(one)
    over3 = three.groupBy(F.shiftright("code", CHAR).alias("h2")).agg(*_facts("t"))
    over2 = two.groupBy(F.shiftright("g2", CHAR).alias("h1")).agg(*_facts("b"))
    base = one.agg(*_facts("u"), F.count("*").alias("kinds")).first()
    total, kinds = base["u_all"] or 0, base["kinds"]
    spread = sum(d1[k - 1] * base[f"u_{k}"] for k in (1, 2, 3)) / total if total else 1.0
    asked = grams.select("code", "c", F.col("code").bitwiseAND(mid).alias("g2"), F.col("code").bitwiseAND(low).alias("g1"), F.shiftright("code", CHAR).alias("h2"), F.shiftright("code", CHAR).bitwiseAND(low).alias("h1"))
    joined = asked.join(two.withColumnRenamed("c", "c2"), "g2", "left").join(one.withColumnRenamed("c", "c1"), "g1", "left").join(over3, "h2", "left").join(over2, "h1", "left")
    p1 = (_minus(F.col("c1"), d1) / total if total else F.lit(0.0)) + spread / (kinds + 1)
    p2 = F.when(F.col("b_all").isNull(), p1).otherwise((_minus(F.col("c2"), d2) + _mass("b", d2) * p1) / F.col("b_all"))
    p3 = F.when(F.col("t_all").isNull(), p2).otherwise((_minus(F.col("c"), d3) + _mass("t", d3) * p2) / F.col("t_all"))
    return joined.select("code", F.log(p3).alias("logp"))


def _ask(shards: int):
    def run(batches):
        for row in _each(batches):
            codes = _codes(row["codes"])
            shard = codes % shards
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, zlib.compress(np.diff(codes[order[cuts[s] : cuts[s + 1]]], prepend=0).tobytes(), 1)) for s in range(shards) if cuts[s] < cuts[s + 1]]
            yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]] * len(rows), pa.int64()), "shard": pa.array([s for s, _ in rows], pa.int32()), "asked": pa.array([z for _, z in rows], pa.binary())})

    return run


def _reply(batches):
    for row in _each(batches):
        own = np.array(row["codes"], np.int64)
        found = np.array(row["logps"], np.float64)[np.searchsorted(own, _codes(row["asked"]))]
        yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int64()), "shard": pa.array([row["shard"]], pa.int32()), "found": pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())})


def _score(shards: int):
    def run(batches):
        for row in _each(batches):
            codes = _codes(row["codes"])
            logp = np.zeros(len(codes))
            shard = codes % shards
            for part in row["replies"] or []:
                logp[shard == part["shard"]] = np.frombuffer(zlib.decompress(part["found"]))
            doc, at, times = _entries(row)
            sums = np.bincount(doc, weights=times * logp[at], minlength=len(row["sizes"]))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "mark": pa.array(row["marks"], pa.int64()), "n_tokens": pa.array(row["tokens"], pa.int64()), "logp": pa.array(sums)})

    return run


def perplexities(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", mark: Column | None = None, folds: int = 1) -> DataFrame:
    """``(doc_id, lang, mark, n_tokens, logp)`` for each row of ``docs``; ``trusted`` has the ids of trusted rows.

    With more than one of ``folds``, rows are dealt by id and each fold is
    scored by a model of the other folds' trusted rows: no text by itself.
    """
    plain = docs.select(F.col(key).cast("long").alias("ids"), F.col(lang).cast("string").alias("langs"), (mark if mark is not None else F.lit(0)).cast("long").alias("marks"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), fold_of(F.col(key), folds).alias("fold"))
    blocks = settle(plain.mapInArrow(_count, "block long, fold int, ids array<long>, langs array<string>, marks array<long>, tokens array<long>, sizes array<long>, codes binary, own binary, times binary"), "blocks")
    places = blocks.select("block", F.posexplode("ids").alias("at", "id"))
    good = places.join(trusted.select(F.col(key).alias("id")).distinct(), "id").groupBy("block").agg(F.collect_list("at").alias("trusted"))
    marked = blocks.join(good, "block", "left")
    parts = [_scores(blocks, marked, f, folds) for f in range(folds)]
    out = settle(reduce(DataFrame.union, [scores for scores, _ in parts]), "scores")
    release(blocks, *[model for _, model in parts])
    return out


def fold_of(key: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(folds)).cast("int")


def _scores(blocks: DataFrame, marked: DataFrame, fold: int, folds: int) -> tuple[DataFrame, DataFrame]:
    """Scores of one fold's rows, and the model that they are read from; all its trigrams are in the model, with the counts of the others (of all, where there is one fold)."""
    if folds > 1:
        blocks = blocks.where(F.col("fold") == fold)
        marked = marked.withColumn("trusted", F.when(F.col("fold") != fold, F.col("trusted"))).where(F.col("trusted").isNotNull() | (F.col("fold") == fold))
    counted = marked.select("sizes", "codes", "own", "times", "trusted").mapInArrow(_train, "code long, c long")
    grams = settle(counted.groupBy("code").agg(F.sum("c").alias("c")), "grams")
    probs = settle(model(grams), "model")
    release(grams)
    shards = max(8, -(-probs.count() // SHARD))
    held = probs.groupBy(F.pmod("code", F.lit(shards)).cast("int").alias("shard")).agg(F.array_sort(F.collect_list(F.struct("code", "logp"))).alias("m")).select("shard", F.col("m.code").alias("codes"), F.col("m.logp").alias("logps"))
    asked = blocks.select("block", "codes").mapInArrow(_ask(shards), "block long, shard int, asked binary")
    replies = asked.join(held, "shard").mapInArrow(_reply, "block long, shard int, found binary")
    mine = replies.groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("replies"))
    full = blocks.join(mine, "block", "left").select("ids", "langs", "marks", "tokens", "sizes", "codes", "own", "times", "replies")
    return full.mapInArrow(_score(shards), "doc_id long, lang string, mark long, n_tokens long, logp double"), probs


def judge_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, steady: int = 60, mark: Column | None = None) -> DataFrame:
    """``(doc_id, lang, mark, n_tokens, perplexity, threshold, keep)`` for each row of ``docs``.

    The model is trained on the documents that ``labels`` gives quality 1.
    A document is kept if its perplexity is at most the ``quantile`` of its
    language's trusted documents (of all of them, where its language has none;
    without trusted documents all are kept). Documents are
    scored by the model of the other half's trusted ones, so the quantile is of
    text that the model has not seen, as are all others; only where a half has
    no trusted document, one model is made of all. Fewer than 1 / (1 -
    ``quantile``) documents do not reach the quantile: there it is at least
    that of a log-normal spread with their mean and deviation. Perplexity
    counts ``steady`` characters of the language's average besides the
    document's own, so short texts are not rejected by chance.

    Null text is empty: one token, the end; there is nothing to judge, it is
    kept. A null language is a language of its own. Documents labelled both ways are trusted. Repeated rows are
    scored alike. Empty tables give empty results; other columns do not matter.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    halves = docs.select("doc_id").join(trusted, "doc_id", "left_semi").agg(F.count_distinct(fold_of(F.col("doc_id"), 2)).alias("n")).first()["n"]
    scored = perplexities(docs, trusted, mark=mark, folds=2 if halves == 2 else 1)
    good = scored.join(trusted, "doc_id", "left_semi")
    means = good.groupBy("lang").agg((F.sum("logp") / F.sum("n_tokens")).alias("mean"))
    every = good.agg((F.sum("logp") / F.sum("n_tokens")).alias("every"))

    def with_perplexity(df: DataFrame) -> DataFrame:
        both = df.alias("d").join(F.broadcast(every)).join(means.alias("m"), F.expr("d.lang <=> m.lang"), "left").select("d.*", F.coalesce("mean", "every", F.lit(0.0)).alias("mean"))
        return both.withColumn("perplexity", F.exp(-(F.col("logp") + steady * F.col("mean")) / (F.col("n_tokens") + steady)))

    measured = settle(with_perplexity(scored), "perplexity")
    release(scored)
    best = measured.join(trusted, "doc_id", "left_semi")
    ranked = F.percentile_approx("perplexity", quantile, 100000)
    spread = F.exp(F.avg(F.log("perplexity")) + NormalDist().inv_cdf(quantile) * F.stddev_samp(F.log("perplexity")))
    bound = F.when(F.count("*") * (1 - quantile) < 1, F.greatest(ranked, spread)).otherwise(ranked)
    bounds = best.groupBy("lang").agg(bound.alias("own"))
    whole = best.agg(bound.alias("whole"))
    out = measured.alias("d").join(F.broadcast(whole)).join(bounds.alias("b"), F.expr("d.lang <=> b.lang"), "left")
    threshold = F.coalesce("own", "whole")
    return out.select("d.doc_id", "d.lang", "d.mark", "d.n_tokens", "d.perplexity", threshold.alias("threshold"), ((F.col("n_tokens") == 1) | F.coalesce(F.col("perplexity") <= threshold, F.lit(True))).alias("keep"))

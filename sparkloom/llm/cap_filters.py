"""Near-duplicate vectors through spherical-cap filters of a structured random product code.

A vector is rotated and cut into parts; each part has a code of random
directions, and one of each makes a filter direction. A vector belongs to
every filter whose direction it exceeds a threshold on: these are list-decoded
part by part, without going through all products. Vectors that share a filter
are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle, ship

ship(__name__)

PARTS = 2
#: Filters that a vector gets at least: the best ones, where fewer exceed the threshold.
FEWEST = 12
#: For so many different vectors, directions a part and filters a vector on average; how the latter grow with their number (their power for links of cosine 0.93).
AT, WORDS, FILTERS, GROWTH = 10_000, 256, 25.5, 0.036


def code_size(n: int) -> tuple[int, float]:
    """Directions a part and threshold for ``n`` vectors: filters grow with n, members of a filter hardly."""
    words = min(1 << 14, max(64, math.ceil(WORDS * math.sqrt(n / AT))))
    filters = FILTERS * max(1.0, n / AT) ** GROWTH
    return words, NormalDist().inv_cdf(1 - min(0.5, filters / words**PARTS))


def product_code(dim: int, words: int, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rotation, the coordinates of each part, and each part's ``words`` directions of length 1 / sqrt(parts)."""
    rng = np.random.default_rng([seed, dim])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cuts = [c for c in np.array_split(np.arange(dim), PARTS) if len(c)]
    codes = []
    for cut in cuts:
        c = rng.standard_normal((words, len(cut)))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(cuts)))
    return turn, cuts, codes


def list_decode(units: np.ndarray, words: int, threshold: float) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all filters whose direction it exceeds by ``threshold``, in units of 1 / sqrt(dimension)."""
    turn, cuts, codes = product_code(units.shape[1], words)
    turned = units @ turn
    scores = [turned[:, cut] @ code.T for cut, code in zip(cuts, codes, strict=True)]
    left, right = scores[0], scores[1] if len(scores) > 1 else np.zeros((len(units), 1))
    most = min(FEWEST, left.shape[1], right.shape[1])
    best_left, best_right = -np.partition(-left, most - 1, axis=1)[:, :most], -np.partition(-right, most - 1, axis=1)[:, :most]
    sums = (best_left[:, :, None] + best_right[:, None, :]).reshape(len(units), -1)
    bar = np.minimum(threshold / np.sqrt(units.shape[1]), -np.partition(-sums, most - 1, axis=1)[:, most - 1] - 1e-12)
    top_left, top_right = left.max(1), right.max(1)
    out = []
    for r in range(len(units)):
        a = np.flatnonzero(left[r] >= bar[r] - top_right[r])
        b = np.flatnonzero(right[r] >= bar[r] - top_left[r])
        x, y = np.nonzero(left[r][a][:, None] + right[r][b][None, :] >= bar[r])
        out.append(np.sort(a[x] * right.shape[1] + b[y]))
    return out


def _normal(batches):
    """Unit vectors in double precision as bytes; null for vectors that link with nothing."""
    for batch in batches:
        units, prints = [], []
        for v in batch.column(2).to_pylist():
            x = np.array([np.nan] if v is None or None in v else v, dtype=np.float64)
            scale = np.abs(x).max() if len(x) else 0.0
            if len(x) and np.isfinite(x).all() and scale > 0:
                prints.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                x = x / scale
                units.append((x / np.sqrt(x @ x)).tobytes())
            else:
                prints.append(None)
                units.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "label", "print", "unit"])


def _decode(words: int, threshold: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = part.column("unit").to_pylist()
                found: list = [None] * len(raw)
                for size in {len(x) for x in raw}:
                    rows = [r for r, x in enumerate(raw) if len(x) == size]
                    for r, own in zip(rows, list_decode(np.stack([np.frombuffer(raw[r]) for r in rows]), words, threshold), strict=True):
                        found[r] = own.tolist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], names=[*part.schema.names, "filters"])

    return run


def compare(units: np.ndarray, copies: np.ndarray, filters: list[np.ndarray], own: int, chunk: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that filter ``own`` counts for each member, and the first member of its local component.

    A pair counts in its smallest common filter only. With two chunks, pairs across them count.
    """
    near = units @ units.T >= least
    np.fill_diagonal(near, False)
    if chunk.min() != chunk.max():
        near &= chunk[:, None] != chunk[None, :]
    label = np.arange(len(units))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(units)).min(1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    if near.any():
        before = [f[f < own] for f in filters]
        names, times = np.unique(np.concatenate(before), return_counts=True)
        names = names[times > 1]
        if len(names):
            has = np.zeros((len(units), len(names)), np.float32)
            for r, f in enumerate(before):
                has[r, np.searchsorted(names, f[np.isin(f, names, assume_unique=True)])] = 1
            near &= has @ has.T == 0
    return near.astype(np.int64) @ copies, label


def _buckets(least: float):
    """Runs of rows of one bucket; the input is sorted by bucket."""

    def flush(run: list) -> pa.RecordBatch | None:
        if len(run) < 2:
            return None
        ids = np.array([x["rep"] for x in run])
        links, label = compare(np.stack([np.frombuffer(x["unit"]) for x in run]), np.array([x["copies"] for x in run]), [np.array(x["filters"], np.int64) for x in run], run[0]["filter"], np.array([x["chunk"] for x in run]), least)
        keep = (links > 0) | (label != np.arange(len(run)))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(ids[label][keep])], names=["rep", "links", "root"])

    def work(batches):
        run: list = []
        bucket = None
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["label"], row["size"], row["filter"], row["c0"], row["c1"])
                if own != bucket:
                    if (out := flush(run)) is not None:
                        yield out
                    run, bucket = [], own
                run.append(row)
        if (out := flush(run)) is not None:
            yield out

    return work


def near_vectors(vectors: DataFrame, least: float = 0.93, words: int | None = None, threshold: float | None = None, chunk: int = 512, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Vectors are compared if their labels are equal and not null, and their
    lengths too. Pairs that share a filter are compared in double precision;
    all found at ``least`` or above count. ``words`` directions a part give
    words ** 2 filters; these and the threshold follow the number of different
    vectors unless they are given, so that filters stay small. Equal vectors are compared once and count as often as they occur.
    A filter with more than ``chunk`` members is dealt out in pairs of chunks,
    so no task compares more than two chunks at a time, and none is left out.

    Null, empty or zero vectors, and those with null or non-finite
    components, link with nothing; so do rows with a null label. Repeated rows
    are vectors of their own, linked with each other; unlike vectors under one
    id have links of their own. A null id is no component's smallest unless all
    of the component are null; then component_id is null and its rows are kept.
    Empty tables give empty
    results; other columns do not matter.
    """
    plain = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = settle(plain.mapInArrow(_normal, "vec_id long, label string, print binary, unit binary"), "vectors")
    able = rows.where("label is not null and unit is not null")
    reps = able.groupBy("label", "print").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    # different vectors have numbers of their own, whatever their ids; written, they stay as they are
    reps = settle(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    fit = code_size(reps.count())
    words, threshold = words or fit[0], threshold if threshold is not None else fit[1]
    decoded = settle(reps.select("label", "print", "rep", "copies", "unit").mapInArrow(_decode(words, threshold), "label string, print binary, rep long, copies long, unit binary, filters array<long>"), "decoded")
    entries = decoded.select("label", F.octet_length("unit").alias("size"), "print", F.explode("filters").alias("filter"))
    sizes = entries.groupBy("label", "size", "filter").count().where("count > 1")
    shared = entries.join(sizes, ["label", "size", "filter"])
    chunks = F.ceil(F.col("count") / chunk).cast("int")
    shared = shared.withColumn("chunk", F.pmod(F.xxhash64("print"), chunks).cast("int"))
    # with n chunks, a member meets its own and each other one
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    dealt = shared.withColumn("other", other).withColumn("c0", F.least("chunk", "other")).withColumn("c1", F.greatest("chunk", "other")).drop("other", "count")
    met = dealt.join(decoded.select("label", "print", "rep", "copies", "unit", "filters"), ["label", "print"])
    bucket = ["label", "size", "filter", "c0", "c1"]
    found = settle(met.select(*bucket, "chunk", "rep", "copies", "unit", "filters").repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_buckets(least), "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.select("label", "print", "rep", "copies", "low").join(links, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
    named = named.select("label", "print", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    named = settle(named, "named")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.drop("low").join(lows, "component")
    out = rows.select("vec_id", "label", "print").join(named, ["label", "print"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

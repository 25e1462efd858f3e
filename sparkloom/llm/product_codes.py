"""Vector codes: a codebook for each part of the vectors, nearest entries found in broadcast kd-trees, exact in integers."""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

#: Parts of a vector, entries of a codebook, rounds of updates, steps of one unit of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Points of a kd-tree's leaf.
LEAF = 4


class KdTree:
    """A kd-tree over integer points, as arrays of nodes in preorder: box, end of the subtree, split, points of leaves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.end: list[int] = []
        self.split: list[tuple[int, int, int] | None] = []
        self.own: list[np.ndarray] = []
        self._grow(np.arange(len(points)))

    def _grow(self, own: np.ndarray) -> None:
        k, at = len(self.end), self.points[own]
        self.low.append(at.min(0))
        self.high.append(at.max(0))
        self.end.append(0)
        self.own.append(own)
        self.split.append(None)
        axis = int(np.argmax(self.high[k] - self.low[k]))
        if len(own) > LEAF and self.high[k][axis] > self.low[k][axis]:
            order = np.argsort(at[:, axis], kind="stable")
            half = len(own) // 2
            self._grow(own[order[:half]])
            self.split[k] = (axis, int(at[order[half], axis]), len(self.end))
            self._grow(own[order[half:]])
        self.end[k] = len(self.end)

    def _look(self, node: int, rows: np.ndarray, at: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Compare rows with a leaf's points; of equal distances the lower index stays."""
        own = np.sort(self.own[node])
        gap = at[rows][:, None, :] - self.points[own][None, :, :]
        far = np.einsum("rpc,rpc->rp", gap, gap)
        pick = far.argmin(1)
        d, i = far[np.arange(len(rows)), pick], own[pick]
        better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], i[better]

    def nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest point, ties to the lower index.

        Rows go down to their home leaf first. Then all nodes are walked in
        preorder with the rows whose distance to the node's box is at most their
        best so far; rows at an equal bound go on, as a point there may tie with
        a lower index.
        """
        best = np.full(len(at), np.iinfo(np.int64).max)
        index = np.full(len(at), len(self.points), np.int64)
        home: list[tuple[int, np.ndarray]] = [(0, np.arange(len(at)))]
        first: dict[int, np.ndarray] = {}
        while home:
            node, rows = home.pop()
            if not len(rows):
                continue
            if self.split[node] is None:
                first[node] = rows
                self._look(node, rows, at, best, index)
                continue
            axis, cut, right = self.split[node]
            left = at[rows, axis] < cut
            home += [(node + 1, rows[left]), (right, rows[~left])]
        alive: list[tuple[int, np.ndarray]] = [(0, np.arange(len(at)))]
        while alive:
            node, rows = alive.pop()
            out = np.maximum(np.maximum(self.low[node] - at[rows], at[rows] - self.high[node]), 0)
            rows = rows[np.einsum("rc,rc->r", out, out) <= best[rows]]
            if not len(rows):
                continue
            if self.split[node] is None:
                rows = np.setdiff1d(rows, first[node], assume_unique=True) if node in first else rows
                if len(rows):
                    self._look(node, rows, at, best, index)
                continue
            alive += [(self.split[node][2], rows), (node + 1, rows)]
        return index, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The integer parts of a batch's vectors: rows, parts, components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), PARTS, size // PARTS)


def _assign(trees, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros(vectors.shape[:2], np.int64)
    error = np.zeros(len(vectors), np.int64)
    for p, tree in enumerate(trees):
        codes[:, p], d = tree.nearest(np.ascontiguousarray(vectors[:, p]))
        error += d
    return codes, error


def _sums(shared, size: int):
    """A task's sums and counts of the parts that each entry takes: one row an entry that takes any."""

    def run(batches):
        trees = pickle.loads(shared.value)
        entries, width = len(trees[0].points), size // PARTS
        total, count = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("x"), size)
            codes, _ = _assign(trees, vectors)
            for p in range(PARTS):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for c in range(width):  # below 2**53, so the weights are exact
                    total[p, :, c] += np.bincount(codes[:, p], weights=vectors[:, p, c], minlength=entries).astype(np.int64)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry]), **{f"s{c}": pa.array(total[part, entry, c]) for c in range(width)}})

    return run


def _codes(shared, size: int):
    def run(batches):
        trees = pickle.loads(shared.value)
        for batch in batches:
            codes, error = _assign(trees, _matrix(batch.column("x"), size))
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def bound(size: int) -> int:
    """The size within which components are held, so that a vector's distances stay below 2**63: 2**27 for 64 components."""
    return min(math.isqrt((1 << 62) // max(1, size)) // 2, 1 << 30)


def integer_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """Usable rows as (vec_id, label, x array<int>), and the length of their vectors (0 without any)."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    fits = embeddings.where(sound & (F.size(x) > 0) & (F.size(x) % PARTS == 0))
    first = fits.orderBy(F.col("vec_id").asc_nulls_last(), F.size(x)).select(F.size(x).alias("size")).first()
    size = first["size"] if first else 0
    most = float(bound(size))
    step = lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * SCALE))).cast("int")
    return fits.where(F.size(x) == size).select("vec_id", "label", F.transform(x, step).alias("x")), size


def _trees(spark: SparkSession, books: np.ndarray):
    """A broadcast of one kd-tree a codebook, readable by workers that have no copy of this module."""
    return spark.sparkContext.broadcast(cloudpickle.dumps([KdTree(book) for book in books]))


def encode_vectors(embeddings: DataFrame) -> DataFrame:
    """One row a usable vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Left out: vectors that are null, hold null or non-finite components, are
    empty, have a length that 16 does not divide, or another length than the
    usable vector with the smallest id. Integer components are held within
    ``bound`` (values of some 500,000 for 64 components), so that errors fit;
    a label's error beyond 64 bits is null. Codebooks start from the usable rows with the smallest ids (null
    last, then by vector): repeated ids and vectors are rows of their own, equal
    entries tie to the lower index, and with fewer than 64 rows the codebooks
    have fewer entries. Null labels are one label. An empty table gives no rows;
    other columns are ignored.

    A round broadcasts one kd-tree a codebook (64 entries each, whatever the
    number of vectors); tasks return sums of at most 1,024 entries.
    """
    spark = embeddings.sparkSession
    rows, size = integer_vectors(embeddings)
    out = "vec_id {}, code string, error bigint, label_error bigint, codebooks_sha256 string".format(embeddings.schema["vec_id"].dataType.simpleString())
    if not size:
        return spark.createDataFrame([], out)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    books = np.array([r["x"] for r in start], np.int64).reshape(len(start), PARTS, size // PARTS).swapaxes(0, 1).copy()
    width = size // PARTS
    for _ in range(ROUNDS):
        shared = _trees(spark, books)
        taken = rows.select("x").mapInArrow(_sums(shared, size), "part int, entry int, n bigint, " + ", ".join(f"s{c} bigint" for c in range(width)))
        for r in taken.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(width)]).collect():
            books[r["part"], r["entry"]] = [r[f"s{c}"] // r["n"] for c in range(width)]
        shared.destroy()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = _trees(spark, books)
    label = embeddings.schema["label"].dataType.simpleString()
    coded = settle(rows.mapInArrow(_codes(shared, size), f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error bigint"), "codes")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

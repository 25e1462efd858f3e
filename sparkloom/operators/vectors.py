"""Exact nearest vectors of a stated query set: blocks of vectors against chunks of queries as matrix products, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import DIGITS, top_k
from .shared import settle, ship

ship(__name__)

#: Vectors of a block, queries of a chunk, queries that one task packs.
BLOCK, CHUNK, ASKED = 4096, 1024, 1 << 16


def _pack(most: int):
    """Arrow function: rows (id, vector) to blocks of at most ``most`` vectors of one length."""

    def block(size: int, ids: list, vectors: list) -> pa.RecordBatch:
        made = [[size], [np.concatenate(ids).tobytes()], [np.concatenate(vectors).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["size", "ids", "data"])

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            own, lists = batch.column("id").to_numpy(), batch.column("vector")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            values, sizes = lists.flatten().to_numpy(), np.diff(ends)
            for size in np.unique(sizes).tolist():
                at = np.nonzero(sizes == size)[0]
                for k in range(0, len(at), most):
                    part = at[k : k + most]
                    ids, vectors = held.setdefault(size, ([], []))
                    if sum(map(len, ids)) + len(part) > most:
                        yield block(size, ids, vectors)
                        ids, vectors = held[size] = [], []
                    ids.append(own[part])
                    vectors.append(values[ends[part][:, None] + np.arange(size)])
        for size, (ids, vectors) in held.items():
            yield block(size, ids, vectors)

    return run


def _norms(x: np.ndarray) -> np.ndarray:
    """Added component by component, as the SQL does: the order of a sum decides its last digit."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += x[:, c] * x[:, c]
    return np.sqrt(total)


def _meet(k: int, kind: str):
    """Arrow function: pairs of a block and a chunk to candidates, all that can be among the first ``k`` of a query. A task keeps one floor a query."""

    def run(batches):
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                size = row["size"]
                if size != row["q_size"]:
                    continue
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                x, q = (np.frombuffer(row[c], kind).reshape(-1, size).astype(np.float64) for c in ("data", "q_data"))
                nx, nq = _norms(x), _norms(q)
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = (q / np.where(nq == 0, 1, nq)[:, None]) @ (x / np.where(nx == 0, 1, nx)[:, None]).T
                for i, j in zip(*np.nonzero(np.isin(qids, ids)[:, None] & np.isin(ids, qids)[None, :]), strict=True):
                    if qids[i] == ids[j]:
                        scores[i, j] = -np.inf
                # a margin keeps what rounding may bring level
                margin = 1.01 * 10.0**-DIGITS
                floor = floors.setdefault(row["chunk"], np.full(len(qids), -np.inf))
                open_ = np.nonzero((~(scores < floor[:, None])).sum(1) >= k)[0]
                if len(open_):
                    reached = np.partition(scores[open_], len(ids) - k, axis=1)[:, len(ids) - k]
                    floor[open_] = np.fmax(floor[open_], reached)
                a, b = np.nonzero(~(scores < floor[:, None] - margin) & ~(scores <= 0))
                dot = np.zeros(len(a))
                for c in range(size):
                    dot += q[a, c] * x[b, c]
                score = dot / (nq[a] * nx[b])
                order = np.lexsort((ids[b], -score, a))
                a, b, score = a[order], b[order], score[order]
                # of equal scores, as copies have, the first k are enough
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (score[1:] != score[:-1])
                starts = np.nonzero(new)[0]
                keep = np.arange(len(a)) - starts[np.cumsum(new) - 1] < k if len(a) else new
                yield pa.RecordBatch.from_arrays([pa.array(qids[a[keep]]), pa.array(ids[b[keep]]), pa.array(score[keep])], names=["qid", "id", "score"])

    return run


def nearest(vectors: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """``(qid, id, score, rank)``: the first ``k`` of ``vectors`` (id, vector) for each of ``asks`` by cosine, rounded, above 0; ties go by id.

    All pairs are compared, but for those of one id. Null vectors, vectors with a
    null component, and pairs of different lengths have no score. A block of 4,096
    vectors meets a chunk of 1,024 queries at a time; what a task sends on is what
    reaches the ``k``-th score that it has seen.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    sound = F.expr("id is not null and size(vector) > 0 and forall(vector, c -> c is not null)")

    def plain(df: DataFrame) -> DataFrame:
        return df.where(sound).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>" if kind == "float" else "array<double>").alias("vector"))

    packed = "size int, ids binary, data binary"
    chunks = plain(asks).repartition(1 + asks.count() // ASKED).mapInArrow(_pack(CHUNK), packed)
    chunks = settle(chunks.select(F.monotonically_increasing_id().alias("chunk"), *[F.col(c).alias(f"q_{c}") for c in ("size", "ids", "data")]), "asked")
    blocks = plain(vectors).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_pack(BLOCK), packed)
    found = settle(blocks.crossJoin(chunks).mapInArrow(_meet(k, "<f4" if kind == "float" else "<f8"), "qid long, id long, score double"), "found")
    return top_k(found.withColumn("score", F.round("score", DIGITS)).where("score > 0"), k)

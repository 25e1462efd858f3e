"""Exact substring deduplication: suffixes sorted bucket by bucket under a difference cover.

What is asked is where two suffixes of the corpus agree for ``length`` bytes
or more. A difference cover D modulo v has, for any two positions, a shift
below v that brings both onto covered positions. So suffixes that agree for
``length`` bytes have covered suffixes, at the same shift below v, that agree
for ``length - v + 1`` bytes. Those cover samples (one byte in five) are
ranked first; a suffix can only tie for long if one of the v positions from it
on holds a sample whose rank another sample shares. All others are settled by
that alone. The rest are sorted to their first ``length`` bytes one bucket at a
time; a bucket is a range of suffix keys (hashes of those bytes, as order
beyond equality is not needed), gathered from all blocks as sorted runs of
packed differences. What returns to a block is one bit for each of its keys.

Blocks are ranges of doc_id of a bounded number of bytes, so an earlier block
holds earlier text and no position need travel.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

#: A perfect difference set modulo 31: each residue but 0 is one difference of its entries. Fixed values.
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31
#: Bytes of text in a block, and keys in a bucket, about.
BLOCK, BUCKET = 1 << 22, 1 << 22

_WORD = np.random.default_rng(99).integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(data: np.ndarray, at: np.ndarray, length: int, more: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the ``length`` bytes from each position on, and 64 more bits where asked for; ``data`` is padded by 8 bytes."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out, extra = np.zeros(len(at), np.uint64), np.zeros(len(at) if more else 0, np.uint64)
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for k, o in enumerate(offsets):
        x = words[at + o] * _WORD[k]
        if more:
            extra += x ^ (x >> np.uint64(32))
            extra *= _WORD[-1]
        x ^= x >> np.uint64(31)
        out += x
        out *= _M
        out ^= out >> np.uint64(29)
    return out, extra


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct numbers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    wide = 8 if not len(steps) else max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + b"".join(len(z := zlib.compress(p.tobytes(), 1)).to_bytes(4, "little") + z for p in planes)


def unpack(blob: bytes) -> np.ndarray:
    wide, at, planes = blob[0], 1, []
    for _ in range(wide):
        size = int.from_bytes(blob[at : at + 4], "little")
        planes.append(np.frombuffer(zlib.decompress(blob[at + 4 : at + 4 + size]), np.uint8))
        at += 4 + size
    full = np.zeros((len(planes[0]), 8), np.uint8)
    full[:, :wide] = np.stack(planes, 1)
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def _blocks(batches):
    """Rows in doc_id order to blocks; a note ahead of a document says that it is a copy of an earlier one."""
    codec = pa.Codec("zstd", compression_level=7)
    part = TaskContext.get().partitionId()
    ids, texts, size, count = [], [], 0, 0
    noted: tuple = (None, set())

    def flush():
        data = b"".join(texts)
        row = [[part * (1 << 24) + count], [ids], [[len(t) for t in texts]], [codec.compress(data, asbytes=True)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["block", "ids", "sizes", "data"])

    for batch in batches:
        for doc, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind == 0:
                noted = (doc, {text} | (noted[1] if noted[0] == doc else set()))
                continue
            raw = (text or "").encode()
            if doc == noted[0] and hashlib.md5(raw).hexdigest() in noted[1]:
                continue
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
            if size >= BLOCK or len(ids) >= 1 << 16:
                yield flush()
                ids, texts, size, count = [], [], 0, count + 1
    if ids:
        yield flush()


class Block:
    """One block's bytes, and the keys of its samples and suffixes."""

    def __init__(self, sizes: list[int], blob: bytes, length: int):
        self.length = length
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        raw = pa.decompress(blob, decompressed_size=int(self.ends[-1]), codec="zstd", asbytes=True) if self.ends[-1] else b""
        self.data = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(16, np.uint8)])
        self.begin = self.ends - self.sizes

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Covered positions, counted in each document, and the keys of what must agree there."""
        short = self.length - PERIOD + 1
        covered = np.zeros(PERIOD, bool)
        covered[list(COVER)] = True
        spans = [b + np.flatnonzero(covered[np.arange(n - short + 1) % PERIOD]) for b, n in zip(self.begin, self.sizes, strict=True) if n >= self.length]
        at = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        return at, fingerprints(self.data, at, short)[0]

    def open_suffixes(self, twins: np.ndarray) -> np.ndarray:
        """Positions of whole strings with one of the sample positions ``twins`` among the next v."""
        n = int(self.ends[-1]) if len(self.ends) else 0
        marks = np.zeros(n + PERIOD + 1, np.int32)
        np.add.at(marks, np.maximum(twins - PERIOD + 1, 0), 1)
        np.add.at(marks, twins + 1, -1)
        near = np.cumsum(marks[:n]) > 0
        whole = np.zeros(n, bool)
        for b, s in zip(self.begin, self.sizes, strict=True):
            if s >= self.length:
                whole[b : b + s - self.length + 1] = True
        return np.flatnonzero(near & whole)


def _values(keys: np.ndarray, more: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the leading ``bits`` bits) and value of each key.

    Samples keep the next ``most`` bits. Suffixes keep all other bits and fill
    the value up with ``bits`` bits more, so that a larger corpus has longer keys.
    """
    rest = keys & np.uint64((1 << (64 - bits)) - 1)
    bucket = (keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)).astype(np.int64)
    if most:
        return bucket, rest >> np.uint64(64 - bits - most)
    return bucket, (rest << np.uint64(bits)) | (more >> np.uint64(64 - bits)) if bits else rest


def _distinct(bucket: np.ndarray, value: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, the first position of each, and the pair of each position. ``keys`` sort like the pairs, but for ties."""
    order = np.argsort(keys, kind="stable")
    b, v = bucket[order], value[order]
    if ((b[1:] == b[:-1]) & (v[1:] < v[:-1])).any():
        order = np.lexsort((value, bucket))
        b, v = bucket[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return b[new], v[new], order[new], back


def _runs(block: int, bucket: np.ndarray, value: np.ndarray):
    """Sorted distinct values of a block as one packed run for each bucket that it has."""
    edges = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket)) if len(bucket) else [0]
    rows = [(int(bucket[lo]), block, pack(value[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:])]
    if rows:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary())})


def _sample_runs(length: int, bits: int, most: int):
    def run(batches):
        for batch in batches:
            for block, sizes, data in zip(batch.column("block").to_pylist(), batch.column("sizes").to_pylist(), batch.column("data").to_pylist(), strict=True):
                _, keys = Block(sizes, data, length).samples()
                bucket, value = _values(keys, keys, bits, most)
                yield from _runs(block, *_distinct(bucket, value, keys)[:2])

    return run


def _answer(kind: int, earlier: bool):
    """Sort one bucket: for each block's keys, whether another (or an earlier) block has the key, as bits."""

    def solve(bucket: int, blocks: list[int], runs: list[bytes]):
        values = [unpack(r) for r in runs]
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")  # blocks come in order: the first of equal keys is the earliest
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(every), bool)
        hit[order[1:]] = same
        if not earlier:
            hit[order[:-1]] |= same
        at = 0
        for block, own in zip(blocks, values, strict=True):
            mine = hit[at : at + len(own)]
            at += len(own)
            if mine.any():
                yield block, kind, bucket, zlib.compress(np.packbits(mine).tobytes(), 1)

    def out(rows):
        return pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "bucket": pa.array([r[2] for r in rows], pa.int32()), "bits": pa.array([r[3] for r in rows], pa.binary())})

    def run(batches):
        now, blocks, runs = None, [], []
        for batch in batches:
            for bucket, block, keys in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if bucket != now and blocks:
                    yield out(list(solve(now, blocks, runs)))
                    blocks, runs = [], []
                now = bucket
                blocks.append(block)
                runs.append(keys)
        if blocks:
            yield out(list(solve(now, blocks, runs)))

    return run


def _hits(bucket: np.ndarray, size: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answer for each of a block's sorted distinct values, whose buckets these are."""
    hit = np.zeros(size, bool)
    for name, packed in answers.items():
        low, high = np.searchsorted(bucket, [name, name + 1])
        hit[low:high] = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=int(high - low)).astype(bool)
    return hit


def _open_keys(block: Block, bits: int, most: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and keys of the suffixes that samples leave open."""
    at, keys = block.samples()
    bucket, _, _, back = _distinct(*_values(keys, keys, bits, most), keys)
    twin = (np.bincount(back, minlength=len(bucket)) > 1) | _hits(bucket, len(bucket), answers)
    still = block.open_suffixes(at[twin[back]])
    return still, *fingerprints(block.data, still, block.length, more=True)


def _by_kind(notes) -> tuple[dict[int, bytes], dict[int, bytes]]:
    kinds: tuple[dict, dict] = ({}, {})
    for note in notes or []:
        kinds[note["kind"]][note["bucket"]] = note["bits"]
    return kinds


def _suffix_runs(length: int, bits: int, most: int, suffix_bits: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                _, keys, more = _open_keys(Block(one["sizes"], one["data"], length), bits, most, _by_kind(one["notes"])[0])
                yield from _runs(one["block"], *_distinct(*_values(keys, more, suffix_bits, 0), keys)[:2])

    return run


def _cut(length: int, bits: int, most: int, suffix_bits: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                block = Block(one["sizes"], one["data"], length)
                first, second = _by_kind(one["notes"])
                still, keys, more = _open_keys(block, bits, most, first)
                bucket, _, lead, back = _distinct(*_values(keys, more, suffix_bits, 0), keys)
                again = np.ones(len(keys), bool)
                again[lead] = False  # positions ascend: the first of equal keys is the earliest
                starts = still[again | _hits(bucket, len(bucket), second)[back]]
                n = int(block.ends[-1])
                marks = np.zeros(n + length + 1, np.int32)
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + length, -1)
                gone = np.cumsum(marks[:n]) > 0
                out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
                for doc, b, s in zip(one["ids"], block.begin.tolist(), one["sizes"], strict=True):
                    mine = gone[b : b + s]
                    out["doc_id"].append(doc)
                    out["n_bytes"].append(s)
                    out["n_removed"].append(int(mine.sum()))
                    out["n_spans"].append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
                    out["kept_sha256"].append(hashlib.sha256(block.data[b : b + s][~mine].tobytes()).hexdigest())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})

    return run


def repeated_bytes(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``: what stays of each document when repeats go.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a
    smaller doc_id, or earlier in the same document. Strings are judged on
    the input and never cross documents. Copies of whole documents are found
    by MD5 and size first. Strings with equal keys count as equal: keys have 64
    bits and one more for each doubling of the buckets, so that false matches
    stay rare as the corpus grows. A task holds a block, and of a document longer
    than BLOCK all its bytes with about twenty times as many for keys.

    Null text counts as empty; texts shorter than ``length`` keep all. Rows
    with a null id come before all others. Rows that share an id are
    documents of their own, in a fixed order, so a repeated row goes. Empty
    tables give empty results; other columns do not matter.
    """
    if length < PERIOD + 7:
        raise ValueError(f"length must be {PERIOD + 7} at least")
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    prints = settle(plain.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.md5("text").alias("md5")), "prints")
    firsts = prints.where(F.col("n") >= length).groupBy("md5", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("m"), F.count("doc_id").alias("ids")).where("m > 1 and m = ids")
    copies = settle(prints.join(firsts, ["md5", "n"]).where("doc_id > first").select("doc_id", "md5", "n"), "copies")
    total = prints.agg(F.sum("n")).first()[0] or 0

    notes = copies.select("doc_id", F.lit(0).alias("kind"), F.col("md5").alias("text"))
    ordered = plain.select("doc_id", F.lit(1).alias("kind"), "text").union(notes.distinct())
    parts = max(1, int(total // (8 * BLOCK)) + 1)
    blocks = settle(ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "kind", F.length("text"), "text").mapInArrow(_blocks, "block long, ids array<long>, sizes array<long>, data binary"), "blocks")

    n_samples = total * len(COVER) // PERIOD
    bits = max(0, (n_samples // BUCKET).bit_length())
    most = max(28, n_samples.bit_length() + 6) - bits  # of a sample's key, so many bits are enough to leave few open by chance
    answer = "block long, kind int, bucket int, bits binary"
    run = "bucket int, block long, keys binary"

    def solve(runs: DataFrame, kind: int, earlier: bool) -> DataFrame:
        dealt = runs.repartition("bucket").sortWithinPartitions("bucket", "block")
        return settle(dealt.mapInArrow(_answer(kind, earlier), answer), "answers")

    def noted(answers: DataFrame) -> DataFrame:
        mine = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("notes"))
        return blocks.join(mine, "block", "left").select("block", "ids", "sizes", "data", "notes")

    first = solve(blocks.select("block", "sizes", "data").mapInArrow(_sample_runs(length, bits, most), run), 0, False)
    open_runs = noted(first).mapInArrow(_suffix_runs(length, bits, most, bits), run)
    second = solve(open_runs, 1, True)
    kept = noted(first.union(second)).mapInArrow(_cut(length, bits, most, bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    gone = copies.select("doc_id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return kept.union(gone)

"""Benchmark decontamination: every passage of the corpus queries a block-max inverted index of test items."""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, settle, ship

ship(__name__)

_WORDS = re.compile(r"\w+")
_END = re.compile(r"(?<=[.!?])\s+")
#: Items in a block of postings, blocks in a range of blocks; share of items from which on a term is common.
ITEMS, RANGE, COMMON = 8, 8, 0.1
K1, B = 1.5, 0.75
SHINGLE = 5
#: Characters of benchmark text in one index, about; indexes that one scan of the corpus asks.
INDEX_CHARS, AT_ONCE = 1 << 23, 8


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: all sentences but the last, and the last; of a single one, its last quarter."""
    sentences = [w for s in _END.split(text.strip()) if (w := words_of(s))]
    if not sentences:
        return [], []
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0]
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else 1
    return words[:cut], words[cut:]


def _shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of a part's shingles of five words (of all its words, if fewer) that the passage has in sequence; 1 for no words."""
    own = _shingles(part)
    if not own:
        return 1.0
    n = len(next(iter(own)))
    return len(own & {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}) / len(own)


class Index:
    """BM25 impacts of terms on items as shares of the item's score for itself; postings in blocks and ranges of blocks with their maxima.

    Document frequencies, the number of items and their mean length are those of the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, least: float, stride: int):
        self.ids = [i for i, _ in items]
        self.parts = [parts_of(t) for _, t in items]
        bags = [Counter(q + a) for q, a in self.parts]
        idf = {t: math.log(1 + (n - m + 0.5) / (m + 0.5)) for t, m in df.items()}
        self.impacts: list[dict[str, float]] = []
        for bag in bags:
            length = sum(bag.values())
            raw = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in bag.items()}
            whole = math.fsum(raw.values())
            self.impacts.append({t: x / whole for t, x in raw.items()})
        blocks = -(-len(items) // ITEMS)
        spread = {t for t, m in df.items() if m > max(2, COMMON * n)}
        # common terms of an item that reach half of the threshold together get postings, the heaviest first
        for impact in self.impacts:
            left = sorted(((x, t) for t, x in impact.items() if t in spread), reverse=True)
            rest = math.fsum(x for x, _ in left)
            for x, t in left:
                if rest <= least / 2:
                    break
                spread.discard(t)
                rest -= x
        rare = sorted(t for b in map(set, bags) for t in b if t not in spread)
        self.terms = {t: k for k, t in enumerate(dict.fromkeys(rare))}
        # postings of the terms that are not common, by block; what common terms can add is left to the block's bar
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(blocks)]
        common = [0.0] * (blocks * ITEMS)
        for i, impact in enumerate(self.impacts):
            for t, x in impact.items():
                if t in self.terms:
                    self.postings[i // ITEMS].setdefault(self.terms[t], []).append((i, x))
                else:
                    common[i] += x
        self.bar = np.array([least - max(common[b * ITEMS : (b + 1) * ITEMS]) - 1e-9 for b in range(blocks)])
        # block maxima in the order of terms and blocks, and above them maxima over ranges of blocks
        tops = sorted((k, b, max(x for _, x in own)) for b, lists in enumerate(self.postings) for k, own in lists.items())
        self.block_of = np.array([b for _, b, _ in tops], np.int64)
        self.block_top = np.array([x for _, _, x in tops])
        code = np.array([k for k, _, _ in tops], np.int64) * (blocks + 1) + self.block_of // RANGE
        names, at = np.unique(code, return_index=True)
        self.range_of = names % (blocks + 1)
        self.range_top = np.maximum.reduceat(self.block_top, at) if len(at) else np.zeros(0)
        self.range_end = np.append(at, len(tops))
        self.first = np.searchsorted(names // (blocks + 1), np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.range_top, self.first[:-1]) if len(self.terms) else np.zeros(0)
        self.range_bar = np.minimum.reduceat(self.bar, np.arange(0, blocks, RANGE))
        self.least, self.stride = least, stride

    def open_blocks(self, terms: np.ndarray, passage: np.ndarray, passages: int):
        """``(passage, block)`` arrays of the blocks whose maxima reach their bar, for a batch of (passage, distinct term).

        Bounds are taken for the whole index, then for ranges of blocks, then
        for blocks; lists are opened only below what reached its bar.
        """
        stay = (np.bincount(passage, weights=self.most[terms], minlength=passages) >= self.bar.min())[passage]
        terms, passage = terms[stay], passage[stay]
        names, row = np.unique(passage, return_inverse=True)
        ranges, blocks = len(self.range_bar), len(self.bar)
        step = max(1, (1 << 22) // ranges)  # passages at a time, for tables of bounded size
        for k in range(0, len(names), step):
            lo, hi = np.searchsorted(row, [k, k + step])
            own, at = terms[lo:hi], row[lo:hi] - k
            rows = min(step, len(names) - k)
            place, at = _spread(self.first[own], self.first[own + 1], at)
            cell = at * ranges + self.range_of[place]
            alive = np.bincount(cell, weights=self.range_top[place], minlength=rows * ranges) >= np.tile(self.range_bar, rows)
            place, at = place[alive[cell]], at[alive[cell]]
            below, at = _spread(self.range_end[place], self.range_end[place + 1], at)
            cells, back = np.unique(at * blocks + self.block_of[below], return_inverse=True)
            good = np.bincount(back, weights=self.block_top[below], minlength=len(cells)) >= self.bar[cells % blocks]
            yield names[cells[good] // blocks + k], cells[good] % blocks

    def wand(self, terms: list[int], block: int):
        """Items of an open block that can reach the bar, by cursors over the terms' postings in it.

        Cursors are kept in the order of their items. The pivot is the first
        one up to which the terms' maxima in the block reach the bar; what lies
        before its item is skipped, and without a pivot the block is left.
        """
        lists, bar = self.postings[block], self.bar[block]
        cursors = [[own[0][0], 0, max(x for _, x in own), own] for t in terms if (own := lists.get(t))]
        while cursors:
            cursors.sort(key=_place)
            total, pivot = 0.0, -1
            for c in cursors:
                total += c[2]
                if total >= bar:
                    pivot = c[0]
                    break
            if pivot < 0:
                return
            if cursors[0][0] == pivot:
                yield pivot
                pivot += 1
            left = []
            for c in cursors:
                while c[0] < pivot:
                    c[1] += 1
                    c[0] = c[3][c[1]][0] if c[1] < len(c[3]) else 1 << 62
                if c[0] < 1 << 62:
                    left.append(c)
            cursors = left

    def judge(self, words: list[str], items: list[int]):
        """Of ``items``, those that the passage reaches the threshold for: score, question and answer overlap."""
        own = set(words)
        for i in items:
            impact = self.impacts[i]
            score = math.fsum(impact[t] for t in impact.keys() & own)
            if score >= self.least:
                question, answer = self.parts[i]
                yield self.ids[i], score, overlap(question, words), overlap(answer, words)

    def search(self, docs: list[list[str]]) -> dict[tuple[int, int], list[tuple[float, float, float]]]:
        """For ``(document, item)`` the scores and overlaps of passages that reach the threshold.

        Passages of two strides of words, one stride apart, cover a document.
        """
        found_terms, tiles, first, total = [], [], [], 0
        for words in docs:
            found = np.fromiter(map(self.terms.get, words, [-1] * len(words)), np.int64, len(words))
            hit = np.flatnonzero(found >= 0)
            found_terms.append(found[hit])
            tiles.append(total + hit // self.stride)
            first.append(total)
            total += max(1, -(-len(words) // self.stride))
        terms, tile = np.concatenate(found_terms), np.concatenate(tiles)
        begin = np.zeros(total, bool)
        begin[first] = True
        # a tile's words belong to its own passage and to the one that began a stride before
        back = ~begin[tile]
        pair = np.unique(np.concatenate([tile, tile[back] - 1]) * (len(self.terms) + 1) + np.concatenate([terms, terms[back]]))
        passage, term = np.divmod(pair, len(self.terms) + 1)
        out = defaultdict(list)
        for p, b in self.open_blocks(term, passage, total):
            owner = np.searchsorted(first, p, "right") - 1
            low, high = np.searchsorted(passage, p), np.searchsorted(passage, p, "right")
            for lo, hi, who, block, d in zip(low.tolist(), high.tolist(), p.tolist(), b.tolist(), owner.tolist(), strict=True):
                items = list(self.wand(term[lo:hi].tolist(), block))
                if items:
                    start = (who - first[d]) * self.stride
                    for item, score, q, answer in self.judge(docs[d][start : start + 2 * self.stride], items):
                        out[d, item].append((score, q, answer))
        return out


def _spread(begin: np.ndarray, end: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each ``begin`` to below its ``end``, and the label of each."""
    width = end - begin
    return np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum()), np.repeat(label, width)


def _place(cursor: list) -> int:
    return cursor[0]


def _query(blobs: list[bytes], share: float, chunk: int = 1 << 21):
    """Ask each index, one in memory at a time, with runs of documents of about ``chunk`` characters."""
    names = ("doc_id", "mark", "item_id", "score", "overlap")

    def run(batches):
        loaded = pickle.loads(zlib.decompress(blobs[0])) if len(blobs) == 1 else None
        for batch in batches:
            for blob in blobs:
                index = loaded or pickle.loads(zlib.decompress(blob))
                ids, marks, texts = (batch.column(k).to_pylist() for k in range(3))
                at = 0
                while at < len(ids):
                    begin, size = at, 0
                    while at < len(ids) and (at == begin or size + len(texts[at] or "") <= chunk):
                        size += len(texts[at] or "")
                        at += 1
                    found = index.search([words_of(t) for t in texts[begin:at]])
                    rows = []
                    for (d, item), scores in found.items():
                        good = [(min(q, a), q + a, s) for s, q, a in scores if q >= share and a >= share]
                        if good:
                            best = max(good)
                            rows.append((ids[begin + d], marks[begin + d], item, best[2], best[0]))
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=list(names))

    return run


def _item_terms(batches):
    for batch in batches:
        bags = [set(words_of(t)) for t in batch.column(1).to_pylist()]
        shards = np.repeat(batch.column(0).to_numpy(), [len(b) for b in bags])
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([t for b in bags for t in b], pa.string())], names=["shard", "term"])


def _item_lengths(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["length"])


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, share: float = 0.8, index_chars: int = INDEX_CHARS, mark: Column | None = None) -> DataFrame:
    """``(doc_id, mark, item_id, score, overlap)``: the items whose question and answer a document holds.

    Passages of two strides of words, one stride apart, cover every text; a
    stride is as long as the longest item, so each occurrence lies whole in a
    passage. A passage's BM25 score for an item is a share of the item's score
    for itself. Pairs at ``least`` and above count as leaks if ``share`` of the
    five-word shingles of the question, and of the answer, are in the passage.
    Words are compared without case or punctuation. ``mark`` is any number that
    a row is to be known by (0 by default).

    Statistics are those of the whole benchmark, so results do not depend on
    ``index_chars``: a longer benchmark is indexed in parts of about so many
    characters. A scan of the corpus asks AT_ONCE of them, one after the
    other. Items and texts that are null or without words match nothing. A row
    stands for a document and item once; repeated rows each give theirs. An
    empty benchmark or corpus gives no rows.
    """
    tests = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (mark if mark is not None else F.lit(0)).cast("long").alias("mark"), F.col("text").cast("string").alias("text"))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(chars // index_chars) + 1
    tests = settle(tests.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")), "items")
    facts = tests.select("text").mapInArrow(_item_lengths, "length long").where("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    terms = settle(tests.select("shard", "text").mapInArrow(_item_terms, "shard int, term string"), "terms")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    asked = settle(terms.distinct().join(df, "term"), "df")
    out = None
    schema = "doc_id long, mark long, item_id long, score double, overlap double"
    for group in range(0, shards, AT_ONCE):
        blobs = []
        for k in range(group, min(shards, group + AT_ONCE)):
            rows = tests.where(F.col("shard") == k).orderBy("item_id", "text").collect()
            usable = [(r["item_id"], r["text"]) for r in rows if words_of(r["text"])]
            if usable:
                counts = {r["term"]: r["df"] for r in asked.where(F.col("shard") == k).collect()}
                blobs.append(zlib.compress(cloudpickle.dumps(Index(usable, counts, facts["n"], facts["mean"], least, max(64, facts["longest"]))), 1))
        if blobs:
            found = plain.mapInArrow(_query(blobs, share), schema)
            out = found if out is None else out.union(found)
    release(tests, terms, asked)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)

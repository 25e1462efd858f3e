"""Lexical ranking of many queries at once: a coded corpus, BM25, TF-IDF cosine, top-k.

A corpus is tokenised once. Each document becomes its distinct terms as 64-bit
hashes with their counts; statistics, rankings of any setting and candidates
for containment are read from that table.
"""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARTICLES, WORDS, tokenize
from .shared import settle

#: Entries of a (term, query) matrix; larger query sets are asked in parts.
MATRIX = 1 << 24
#: Terms whose weights are sent to all tasks at most; beyond that norms are made by a join.
VOCABULARY = 1 << 22
#: Decimals that scores are rounded to before ranking: sums differ in the last bits by order.
DIGITS = 6

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Codes(dict):
    """Codes of terms as ``code`` gives them in the JVM, each hashed once; some hundred MB at most."""

    def __missing__(self, term: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        found = self[term] = xxhash.xxh64_intdigest(term.encode(), 42)
        return found

    def of_word(self, word: str) -> list[int]:
        """A word and its inner bigrams; a provision mark is one term."""
        if len(word) <= 2 or word[0] == "§":
            return [self[word]]
        return [self[word], *map(self.__getitem__, map("".join, zip(word, word[1:], strict=False)))]


def _count():
    """Arrow function: distinct terms of each text and their counts. Each distinct word of a batch is cut and hashed once."""
    codes = Codes()
    find, marks = re.compile(WORDS).findall, re.compile(ARTICLES.replace(r"\d", "[0-9]")).findall

    def run(batches):
        for batch in batches:
            words: list[str] = []
            size = []
            for text in batch.column("text").to_pylist():
                own = find(text or "")
                if text and "제" in text:
                    own += ["§" + a for a in marks(text)]
                words += own
                size.append(len(own))
            coded = pa.array(words, pa.large_string()).dictionary_encode()
            lists = list(map(codes.of_word, coded.dictionary.to_pylist()))
            width = np.fromiter(map(len, lists), np.int64, len(lists))
            vocabulary, place = np.unique(np.fromiter(chain.from_iterable(lists), np.uint64, width.sum()).view(np.int64), return_inverse=True)
            word = coded.indices.to_numpy().astype(np.int64)
            begin, reach = (np.cumsum(width) - width)[word], width[word]
            at = np.repeat(begin - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
            key = np.repeat(np.repeat(np.arange(len(size)), size), reach) * max(1, len(vocabulary)) + place[at]
            dl = np.bincount(key // max(1, len(vocabulary)), minlength=len(size))
            key, tf = np.unique(key, return_counts=True)
            row, term = np.divmod(key, max(1, len(vocabulary)))
            bounds = pa.array(np.searchsorted(row, np.arange(len(size) + 1)), pa.int32())
            kept = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(dl, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(vocabulary[term], pa.int64())), pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int32()))], names=[*[batch.schema.names[k] for k in kept], "dl", "terms", "tfs"])

    return run


@dataclass(frozen=True)
class Corpus:
    """Coded documents ``(row, id, ..., dl, terms, tfs)``, how many there are, and their mean length."""

    rows: DataFrame
    n: int
    avg_dl: float

    def where(self, condition: Column) -> Corpus:
        """A part of the corpus with statistics of its own."""
        return measured(self.rows.where(condition))


def measured(rows: DataFrame) -> Corpus:
    whole = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl")).first()
    return Corpus(rows, whole["n"], max(whole["avg_dl"] or 0.0, 1e-9))


def code(term: Column) -> Column:
    return F.xxhash64(term)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> Corpus:
    """The coded corpus. Null texts have no terms; repeated rows are documents of their own."""
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), *carry, F.col(text).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields[:-1])
    return measured(settle(tokens.mapInArrow(_count(), f"{kept}, dl long, terms array<long>, tfs array<int>"), "corpus"))


def frequencies(corpus: Corpus, only: DataFrame | None = None) -> DataFrame:
    """``(term, df)`` as codes: how many documents have a term; ``only`` names the terms asked for."""
    seen = corpus.rows.select(F.explode("terms").alias("term"))
    if only is not None:
        seen = seen.join(only.select("term").distinct(), "term", "left_semi")
    return seen.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(qid, term, qtf)``, terms as codes: a repeated term counts each time."""
    return queries.select(F.col(key).alias("qid"), F.explode(tokenize(F.col(text))).alias("t")).groupBy("qid", code(F.col("t")).alias("term")).agg(F.count("*").alias("qtf"))


def top_k(scores: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The first ``k`` of each query by score down, id up, with ``rank``."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(terms: np.ndarray, weights: np.ndarray, qids: np.ndarray, value, k: int, rows: int = 256):
    """Arrow function: each block of documents against all queries, the block's best ``k`` of each query."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("terms")
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                own, tf = np.asarray(lists.flatten()), np.asarray(part.column("tfs").flatten())
                place = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                hit = terms[place] == own
                table = np.zeros((part.num_rows, len(terms)))
                table[doc[hit], place[hit]] = value(part, doc[hit], tf[hit])
                scores = table @ weights
                # a margin keeps what rounding may bring level
                floor = np.sort(scores, axis=0)[max(0, part.num_rows - k)] - 10.0**-DIGITS
                d, q = np.nonzero((scores >= floor) & (scores > 0))
                yield pa.RecordBatch.from_arrays([pa.array(qids[q], pa.int64()), part.column("id").take(pa.array(d)), pa.array(scores[d, q])], names=["qid", "id", "score"])

    return run


def _search(rows: DataFrame, asks: list, weight, value, k: int) -> DataFrame:
    """``(qid, id, score, rank)`` for query rows ``(qid, term, ...)``; ``weight`` gives a query term's weight, ``value`` a document term's."""
    by_query: dict[int, list] = {}
    for r in asks:
        by_query.setdefault(r["qid"], []).append(r)
    parts, group, held = [], [], set()
    for qid in sorted(by_query):
        more = held | {r["term"] for r in by_query[qid]}
        if group and len(more) * (len(group) + 1) > MATRIX:
            parts.append((group, held))
            group, more = [], {r["term"] for r in by_query[qid]}
        group, held = [*group, qid], more
    if group:
        parts.append((group, held))
    found = []
    for qids, codes in parts:
        terms = np.array(sorted(codes), np.int64)
        weights = np.zeros((len(terms), len(qids)))
        for j, qid in enumerate(qids):
            for r in by_query[qid]:
                weights[np.searchsorted(terms, r["term"]), j] = weight(r)
        found.append(rows.mapInArrow(_blocks(terms, weights, np.array(qids), value, k), "qid long, id long, score double"))
    scored = reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], "qid long, id long, score double")
    return top_k(scored.withColumn("score", F.round("score", DIGITS)).where("score > 0"), k)


def bm25_top(corpus: Corpus, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(qid, id, score, rank)``: the first ``k`` for each query of a stated set, in one scan of the coded corpus.

    Documents are scored in blocks against a matrix of query weights, and each
    block keeps its best ``k``, so what is shuffled is k rows a query and block
    whatever the lengths of postings. ``queries`` (qid, term, qtf) is a stated
    set and goes through the driver; larger ones are asked in parts of MATRIX entries.
    """
    df = frequencies(corpus, queries)
    rows = queries.join(df, "term").collect()
    n, mean = corpus.n, corpus.avg_dl

    def weight(r) -> float:
        return r["qtf"] * math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) * (k1 + 1)

    def value(part, doc, tf):
        return tf / (tf + (k1 * (1 - b + b * np.asarray(part.column("dl")) / mean))[doc])

    return _search(corpus.rows.select("id", "dl", "terms", "tfs"), rows, weight, value, k)


def _norms(terms: np.ndarray, idf: np.ndarray):
    """Arrow function: adds each document's length as a vector."""

    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            w = (1 + np.log(np.asarray(batch.column("tfs").flatten()))) * idf[np.searchsorted(terms, np.asarray(lists.flatten()))]
            norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], names=[*batch.schema.names, "dn"])

    return run


def tfidf_top(corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    """Cosine of (1 + ln tf) * (ln((1 + N) / (1 + n)) + 1) vectors; query terms that no document has are left out.

    Norms take the weights of all terms of the corpus: VOCABULARY of them are
    sent to all tasks at most; a larger vocabulary is joined to the coded terms.
    """
    n = corpus.n
    df = settle(frequencies(corpus), "df")
    rows = corpus.rows.select("row", "id", "terms", "tfs")
    if df.count() <= VOCABULARY:
        every = df.orderBy("term").toPandas()
        idf = np.log((1 + n) / (1 + every["df"].to_numpy(np.float64))) + 1
        normed = rows.mapInArrow(_norms(every["term"].to_numpy(np.int64), idf), "row long, id long, terms array<long>, tfs array<int>, dn double")
    else:
        each = rows.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        w = (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
        normed = rows.join(each.join(df, "term").groupBy("row").agg(F.sqrt(F.sum(w * w)).alias("dn")), "row")
    asks = queries.join(df, "term").collect()
    size: dict[int, float] = {}

    def entry(r) -> float:
        return (1 + math.log(r["qtf"])) * (math.log((1 + n) / (1 + r["df"])) + 1)

    for r in asks:
        size[r["qid"]] = size.get(r["qid"], 0.0) + entry(r) ** 2

    def weight(r) -> float:
        return entry(r) * (math.log((1 + n) / (1 + r["df"])) + 1) / math.sqrt(size[r["qid"]])

    def value(part, doc, tf):
        return (1 + np.log(tf)) / np.asarray(part.column("dn"))[doc]

    return _search(normed.select("id", "terms", "tfs", "dn"), asks, weight, value, k)


def containing(corpus: Corpus, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(item_id, id)``: documents whose text contains an item's text.

    Words inside an item, between its first and last white space, are whole
    words of such a document. The rarest of their terms finds candidates, which
    are then compared. Items without inner words are a few short ones, held
    against all texts. Null texts contain nothing; empty items are in every text.
    """
    asked = items.where("text is not null").select("item_id", F.col("text").alias("needle"))
    inner = tokenize(F.regexp_replace("needle", r"^\S+|\S+$", ""))
    terms = asked.select("item_id", F.explode(F.array_distinct(F.transform(inner, code))).alias("term"))
    counted = terms.join(frequencies(corpus, terms), "term", "left").groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    anchors = settle(counted, "anchors")
    near = corpus.rows.select("id", F.explode("terms").alias("term")).join(anchors, "term").select("id", "item_id").distinct()
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = near.join(asked, "item_id").join(plain, "id").where("contains(text, needle)").select("item_id", "id")
    bare = settle(asked.join(anchors, "item_id", "left_anti"), "bare")
    if bare.isEmpty():
        return found
    return found.union(plain.join(bare, F.expr("contains(text, needle)")).select("item_id", "id"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if one is a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    norm = size(a) * size(b)
    return F.when(norm > 0, dot / norm).otherwise(0.0)

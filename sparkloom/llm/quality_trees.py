"""Quality rules: gradient-boosted trees over document statistics, monotone in chosen ones, scored as flat node arrays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

#: Labelled rows that trees are fitted on at most; folds of the held-out scores; low rows kept that weigh as much as one trusted row lost.
SAMPLE, FOLDS, COST = 12000, 3, 10
#: Trees, levels, learning rate, bins of a feature, penalty of a leaf's weight, least weight of a leaf.
TREES, DEPTH, RATE, BINS, DECAY, LEAST = 60, 4, 0.2, 64, 1.0, 1.0
#: Statistics that trees see, and whether the score may only fall (-1) in them.
FEATURES = {"words": 0, "word_chars": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "digits": 0, "marks": 0, "wide": 0, "distinct": 0, "top_word": -1, "line_words": 0}
#: Characters that are taken at a time, about; a longer text is taken alone.
AT_ONCE = 1 << 21
WINDOW = 8
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _classes() -> np.ndarray:
    """Bits of the first 128 characters, and of all others: space 1, symbol 2, capital 4, small letter 8, digit 16, mark 32, wide 64."""
    bits = np.zeros(129, np.uint8)
    for k in range(128):
        c = chr(k)
        bits[k] = (c in _SPACE) + 2 * (c in "#*$%&|<>") + 4 * ("A" <= c <= "Z") + 8 * ("a" <= c <= "z") + 16 * ("0" <= c <= "9") + 32 * (33 <= k < 127 and not c.isalnum())
    bits[128] = 64
    return bits


def _repeated(word: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words of each text in a window of eight that the text has twice or more; windows are named exactly, by doubling their width."""
    if len(word) < WINDOW:
        return np.zeros(docs, np.int64)
    name, step = word.astype(np.int64), 1
    while step < WINDOW:
        name = np.unique(name[:-step] * (int(name.max()) + 1) + name[step:], return_inverse=True)[1]
        step *= 2
    own = doc[: len(name)]
    whole = np.flatnonzero(own == doc[WINDOW - 1 :])
    _, at, times = np.unique(own[whole] * (int(name.max()) + 1) + name[whole], return_inverse=True, return_counts=True)
    twice = whole[times[at] > 1]
    edge = np.zeros(len(word) + 1, np.int64)
    edge[twice] += 1
    edge[twice + WINDOW] -= 1
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows by _COUNTS, integers) and features (rows by FEATURES) of texts."""
    joined = "".join(t + "\n" for t in texts)
    start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1].astype(np.int64)
    cls = _classes()[np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), 128)]

    def held(bit: int) -> np.ndarray:
        return np.add.reduceat((cls & bit) > 0, start, dtype=np.int64)

    space = (cls & 1) > 0
    begins = ~space
    begins[1:] &= space[:-1]
    doc = np.searchsorted(start, np.flatnonzero(begins), side="right") - 1
    words = np.bincount(doc, minlength=len(texts))
    chars = np.diff(np.append(start, len(cls))) - np.add.reduceat(space, start, dtype=np.int64)
    name = pa.array(_WORDS.findall(joined), pa.large_string()).dictionary_encode().indices.to_numpy()
    lines, dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = [line for line in text.split("\n") if line.strip(_SPACE)]
        lines[k], dup[k] = len(own), len(own) - len(set(own))
    repeated = _repeated(name, doc, len(texts))
    pairs, times = np.unique(doc * (len(name) + 1) + name, return_counts=True)
    owner = pairs // (len(name) + 1)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, times)
    symbols, n, c = held(2), np.maximum(words, 1), np.maximum(chars, 1)
    features = [np.log1p(words), chars / n, symbols / n, dup / np.maximum(lines, 1), repeated / n, held(4) / np.maximum(held(4 | 8 | 64), 1), held(16) / c, held(32) / c, held(64) / c, np.bincount(owner, minlength=len(texts)) / n, most / n, n / np.maximum(lines, 1)]
    return np.stack([words, chars, symbols, dup, repeated], 1), np.stack(features, 1)


def _measure(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts, features, at = [], [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
                size += len(texts[end])
                end += 1
            found = statistics(texts[at:end])
            counts.append(found[0])
            features.append(found[1])
            at = end
        if texts:
            own = np.concatenate(counts)
            wide = pa.array(np.concatenate(features).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(own[:, k]) for k in range(len(_COUNTS))], wide], names=["doc_id", *_COUNTS, "features"])


class Trees:
    """Boosted trees as flat arrays: feature, threshold, left and right node, value; leaves lead to themselves."""

    def __init__(self):
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.roots: list[int] = []
        self.base = 0.0

    def node(self, value: float) -> int:
        k = len(self.value)
        for own, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            own.append(x)
        return k

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality: all rows walk down all trees at once."""
        feature, threshold, value = np.array(self.feature, np.int64), np.array(self.threshold), np.array(self.value)
        left, right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        at = np.tile(np.array(self.roots, np.int64), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH if self.roots else 0):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        total = np.full(len(x), self.base)
        for k in range(len(self.roots)):  # one order of addition, whatever the rows
            total += value[at[:, k]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _grow(trees: Trees, codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, low: float, high: float, signs: np.ndarray) -> int:
    """A node for ``rows``; its weight stays within [low, high], so that monotone features stay so further down."""

    def weight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip(-a / (b + DECAY), low, high)

    def gain(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -(2 * a * w + (b + DECAY) * w * w)

    sum_g, sum_h = g[rows].sum(), h[rows].sum()
    own = weight(sum_g, sum_h)
    node = trees.node(float(RATE * own))
    if depth == DEPTH:
        return node
    best, bar = None, float(gain(sum_g, sum_h, own)) + 1e-6
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        left_g = np.cumsum(np.bincount(codes[rows, f], weights=g[rows], minlength=len(cut) + 1))[:-1]
        left_h = np.cumsum(np.bincount(codes[rows, f], weights=h[rows], minlength=len(cut) + 1))[:-1]
        a, b = weight(left_g, left_h), weight(sum_g - left_g, sum_h - left_h)
        total = gain(left_g, left_h, a) + gain(sum_g - left_g, sum_h - left_h, b)
        fits = (left_h >= LEAST) & (sum_h - left_h >= LEAST) & ((b - a) * signs[f] >= 0)
        total = np.where(fits, total, -np.inf)
        k = int(total.argmax())
        if total[k] > bar:
            best, bar = (f, k, float(a[k]), float(b[k])), float(total[k])
    if best is None:
        return node
    f, k, a, b = best
    trees.feature[node], trees.threshold[node] = f, float(cuts[f][k])
    goes = codes[rows, f] <= k
    middle = (a + b) / 2
    bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
    trees.left[node] = _grow(trees, codes, cuts, g, h, rows[goes], depth + 1, *bounds[0], signs)
    trees.right[node] = _grow(trees, codes, cuts, g, h, rows[~goes], depth + 1, *bounds[1], signs)
    return node


def fit(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Trees for the log odds of ``y``, on values binned at quantiles."""
    cuts = [np.unique(np.quantile(col, np.arange(1, BINS) / BINS, method="lower"))[: BINS - 1] for col in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    codes = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    trees = Trees()
    share = y.mean()
    trees.base = float(np.log(share / (1 - share)))
    total, everyone = np.full(len(y), trees.base), np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        first = len(trees.value)
        trees.roots.append(_grow(trees, codes, cuts, p - y, np.maximum(p * (1 - p), 1e-12), everyone, 0, -np.inf, np.inf, np.array(signs)))
        one = Trees()
        one.feature, one.threshold, one.value, one.roots = trees.feature[first:], trees.threshold[first:], trees.value[first:], [0]
        one.left, one.right = [k - first for k in trees.left[first:]], [k - first for k in trees.right[first:]]
        p = one.score(x)
        total += np.log(p / (1 - p))
    return trees


def bar_of(held: np.ndarray, y: np.ndarray) -> float:
    """The bar up to 0.5 that costs least on held-out scores: COST for a trusted row below it, 1 for a low row at or above it; ties to the highest."""
    bars = np.unique(np.append(held[held < 0.5], 0.5))
    lost = np.searchsorted(np.sort(held[y == 1]), bars, side="left")
    kept = (y == 0).sum() - np.searchsorted(np.sort(held[y == 0]), bars, side="left")
    cost = COST * lost + kept
    return float(bars[np.flatnonzero(cost == cost.min())[-1]])


def fit_quality(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[Trees, float] | None:
    """Trees fitted on all rows, and the bar by scores of trees that were fitted on other folds. None without both labels."""
    if len(np.unique(y)) < 2:
        return None
    signs = list(FEATURES.values())
    fold, held = ids * 2654435761 % (1 << 32) % FOLDS, np.full(len(y), np.nan)
    for k in range(FOLDS):
        out = fold == k
        if out.any() and len(np.unique(y[~out])) == 2:
            held[out] = fit(x[~out], y[~out], signs).score(x[out])
    known = ~np.isnan(held)
    return fit(x, y, signs), bar_of(held[known], y[known])


def _verdicts(model: tuple[Trees, float] | None):
    def run(batches):
        for batch in batches:
            words, repeats = batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy()
            failed = (words < 20) | (100 * repeats > 30 * words)
            x = np.array(batch.column("features").flatten()).reshape(len(batch), len(FEATURES))
            score = model[0].score(x) if model else np.ones(len(batch))
            kept = ~failed & (score >= model[1] if model else True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in _COUNTS], pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *_COUNTS, "base_failed", "kept", "score"])

    return run


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, features and labels (1 good) of at most ``most`` labelled documents that exist, by hash of the id; one text and one label an id."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    known, wanted = marks.count(), most + 10 * most**0.5
    if known > 0:  # tasks return few rows beyond the sample, however many there are; ids without a text may leave it smaller
        marks = marks.where(place < int((1 << 40) * min(1.0, wanted / known)))
    rows = stats.join(marks, "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("features").alias("features"))
    got = rows.orderBy(place, "doc_id").limit(most).collect()
    return np.array([r["doc_id"] for r in got], np.int64), np.array([r["features"] for r in got], float).reshape(len(got), len(FEATURES)), np.array([float(r["y"] > 0) for r in got])


def judge_documents(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """One row a document: ``doc_id``, the five counts, ``base_failed``, ``kept`` and ``score`` (probability of good quality).

    Null and empty texts have no words and fail the base rule. Trees are fitted
    on at most ``most`` labelled rows; without both labels all that passes the
    base rule is kept. Each row is judged by its own text, whatever rows share
    its id; equal texts get equal verdicts. Rows without an id are judged like
    others and train nothing. An empty table gives no rows; other columns are
    ignored. A text is held whole in its task, with some forty times its size.
    """
    idtype = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    stats = settle(docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {idtype}, {counts}, features array<double>"), "statistics")
    model = fit_quality(*labelled_sample(stats, labels, most))
    return stats.mapInArrow(_verdicts(model), f"doc_id {idtype}, {counts}, base_failed boolean, kept boolean, score double")

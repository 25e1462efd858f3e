"""Jaccard self-join of documents on word shingles through parity sketches.

A sketch has B words of 64 bits. Each shingle of a set belongs to one word and
is XORed into it by its 64-bit hash, so a word is the parity of what belongs to
it. Each shingle that only one of two sets holds changes one word: the number
of words in which two sketches differ is no more than the symmetric
difference. Two sets over the threshold whose sizes lie in a size band differ
in d shingles at most, so with B > d words they agree in B - d words at least
(pigeonhole): documents are joined on (size band, position, word), and pairs
are verified on their whole shingle sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, narrow, release, settle, ship
from .shingles import mix, set_hash, shingle_sets, slices

ship(__name__)

#: Members of a group that one task compares at a time; larger groups are dealt out in pairs of chunks.
CHUNK = 1024
#: One text in so many shows which sketch words are hot; members that make a word hot, about; parts a hot word is dealt into.
SHOWN, HOT, PARTS = 64, 4096, 64
#: Texts that are held against one center in a task.
SIDE = 64
#: Bytes of text that a worker cuts into shingles at a time; what it holds meanwhile is some 50 times that.
SLICE = 1 << 18


def size_bands(percent: int, upto: int) -> tuple[list[int], list[int], list[int]]:
    """First size, most differing shingles d and sketch words B of each band.

    A pair over the threshold has its smaller set in band T and the other in T or T + 1.
    """
    starts = [1]
    while starts[-1] <= upto:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    starts += [max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1)]
    most, sketch = [], []
    for t in range(len(starts) - 2):
        small = starts[t + 1] - 1
        large = min(starts[t + 2] - 1, small * 100 // percent)
        d = (100 - percent) * (small + large) // (100 + percent)
        most.append(d)
        sketch.append(d + 1 + (max(2, d // 4) if d else 0))
    return starts[: len(most)], most, sketch


def _own_sets(k: int, seed: int):
    """Size, hash, second hash and bit sketch of each row's shingle set."""

    def run(batches):
        for batch in batches:
            for at, offsets, data in slices(batch.column("text"), SLICE):
                tokens, bounds = shingle_sets(offsets, data, k)
                rows = len(bounds) - 1
                sketch = [bit_sketch(tokens[bounds[r] : bounds[r + 1]]).tobytes() for r in range(rows)]
                kept = [batch.column(c).slice(at, rows) for c in ("doc_id", "mark")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds)), pa.array(set_hash(tokens, bounds, seed)), pa.array(set_hash(tokens, bounds, ~seed & 0xFFFF)), pa.array(sketch, pa.binary())], names=["doc_id", "mark", "n_shingles", "node", "twin", "sketch"])

    return run


def sketch_keys(tokens: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all rows, and the row of each.

    Words with few shingles match by chance. A row leaves out its words with
    up to w shingles (w at most 2) if they are fewer than B - d: of the B - d
    words in which two similar sets agree, both hold the same shingles in each,
    so one at least stays in for both.
    """
    size = np.diff(bounds)
    if not len(tokens):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, most, sketch = (np.array(x) for x in size_bands(percent, int(size.max())))
    owner = np.repeat(np.arange(len(size)), size)
    band = np.searchsorted(starts, size, "right") - 1
    all_keys, all_rows = [], []
    for shift in (0, 1):
        t = band - shift
        use = (t >= 0) & (size > 0)
        use[use] = most[t[use]] > 0  # without a difference only equal sets are similar
        if not use.any():
            continue
        b = np.where(use, sketch[np.maximum(t, 0)], 1)
        d = np.where(use, most[np.maximum(t, 0)], 0)
        mine = use[owner]
        tok, own = tokens[mine], owner[mine]
        pos = ((tok >> np.uint64(32)) * b[own].astype(np.uint64)) >> np.uint64(32)
        edge = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (pos[1:] != pos[:-1]))))
        word = np.bitwise_xor.reduceat(mix(tok), edge)
        many = np.diff(np.append(edge, len(tok)))
        own, pos = own[edge], pos[edge]
        filled = np.bincount(own, minlength=len(size))
        weak = b - filled
        spare = b - d - 1
        floor = np.where(weak <= spare, 0, -1)
        for w in (1, 2):
            weak = weak + np.bincount(own[many == w], minlength=len(size))
            floor = np.where((floor == w - 1) & (weak <= spare), w, floor)
        stay = many > floor[own]
        tag = mix(t[own].astype(np.uint64) << np.uint64(32) | pos)
        all_keys.append(mix(word + tag)[stay])
        all_rows.append(own[stay])
        for r in np.flatnonzero(use & (floor < 0)):  # too many empty words to leave out
            seen = pos[own == r]
            free = np.setdiff1d(np.arange(b[r], dtype=np.uint64), seen)
            all_keys.append(mix(mix(np.uint64(t[r]) << np.uint64(32) | free)))
            all_rows.append(np.full(len(free), r))
    if not all_keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(all_keys), np.concatenate(all_rows)


def _keys(k: int, percent: int, seed: int):
    def run(batches):
        done: set[int] = set()  # copies within a task give their keys once
        for batch in batches:
            for _, offsets, data in slices(batch.column(0), SLICE):
                tokens, bounds = shingle_sets(offsets, data, k)
                node = set_hash(tokens, bounds, seed)
                fresh = np.zeros(len(node), bool)
                for r, x in enumerate(node.tolist()):
                    if x not in done:
                        done.add(x)
                        fresh[r] = True
                keys, rows = sketch_keys(tokens, bounds, percent)
                keep = fresh[rows]
                keys, rows = keys[keep].view(np.int64), rows[keep]
                for at in range(0, len(keys), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)]), pa.array(node[rows[at : at + (1 << 17)]])], names=["key", "node"])

    return run


def bit_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of a set in 4 to 8 bits a shingle, a power of two in all: half a sketch XORed on the other is the next smaller one."""
    size = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def most_apart(n_a, n_b, percent: int):
    """Symmetric difference of two similar sets of these sizes at most."""
    return (100 - percent) * (n_a + n_b) // (100 + percent)


def _near_pairs(percent: int):
    """Pairs whose sketches do not rule them out."""

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb"))
            keep = []
            for r in range(len(a)):
                x, y = np.frombuffer(sa[r], np.uint64), np.frombuffer(sb[r], np.uint64)
                words = min(len(x), len(y))
                if np.bitwise_count(fold(x, words) ^ fold(y, words)).sum() <= most_apart(na[r], nb[r], percent):
                    keep.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([a[r] for r in keep], pa.int64()), pa.array([b[r] for r in keep], pa.int64())], names=["a", "b"])

    return run


def _open_groups(percent: int, few: int, joins: bool):
    """Pairs that would join components of a group, where sketches and failed tests do not rule them out; rows come sorted by group and chunks.

    A member brings ``few`` pairs at most with each other component. With
    ``joins`` that component then counts as joined, so its members bring none.
    ``cut`` says whether a group has pairs that are not among them.
    """

    def flush(run: list) -> pa.RecordBatch:
        out_a, out_b, cut = [], [], False
        if len(run) > 1:
            node, comp, size = (np.array([x[c] for x in run], np.int64) for c in ("node", "c", "n"))
            raw = [np.frombuffer(x["sketch"], np.uint64) for x in run]
            words = min(map(len, raw))
            bits = np.stack([fold(x, words) for x in raw])
            side = np.array([x["side"] for x in run], np.int64)
            across = side.min() != side.max()
            for r in range(len(run) - 1):
                other = np.arange(r + 1, len(run))
                other = other[(comp[other] != comp[r]) & (side[other] != side[r])] if across else other[comp[other] != comp[r]]
                if run[r]["failed"]:
                    other = other[~np.isin(node[other], run[r]["failed"])]
                if not len(other):
                    continue
                apart = np.bitwise_count(bits[other] ^ bits[r]).sum(1)
                other = other[apart <= most_apart(size[other], size[r], percent)]
                met, times = np.unique(comp[other], return_counts=True)
                if len(met):
                    order = np.argsort(comp[other], kind="stable")
                    begin = np.cumsum(times) - times
                    other = other[np.concatenate([order[b : b + min(few, n)] for b, n in zip(begin, times, strict=True)])]
                    cut = cut or joins or bool((times > few).any())
                if joins:
                    comp[np.isin(comp, met)] = comp[r]
                out_a += [int(node[r])] * len(other)
                out_b += node[other].tolist()
        return pa.RecordBatch.from_arrays([pa.array([run[0]["key"]] * len(out_a) if run else [], pa.int64()), pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array([cut] * len(out_a), pa.bool_())], names=["key", "a", "b", "cut"])

    def work(batches):
        run: list = []
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                group = (row["key"], row["kind"], row["c0"], row["c1"])
                if group != now:
                    yield flush(run)
                    run, now = [], group
                run.append(row)
        yield flush(run)

    return work


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    sets = []
    for _, offsets, data in slices(column, SLICE):
        tokens, bounds = shingle_sets(offsets, data, k)
        sets += [tokens[bounds[r] : bounds[r + 1]] for r in range(len(bounds) - 1)]
    return sets


def _verify(k: int, percent: int):
    """Whole shingle sets of a side's texts against its center's, which comes first."""

    def run(batches):
        center = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b, ok = [], [], []
                for a_, b_, x in zip(part.column("a").to_pylist(), part.column("node").to_pylist(), _sets(part.column("text"), k), strict=True):
                    if a_ == b_:
                        center = x
                        continue
                    shared = len(np.intersect1d(center, x, assume_unique=True))
                    a.append(a_)
                    b.append(b_)
                    ok.append(100 * shared >= percent * (len(center) + len(x) - shared))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _small(df: DataFrame, most: int = BROADCAST_ROWS // 8) -> DataFrame:
    """A settled table of ids, broadcast where it is small."""
    return F.broadcast(df) if df.count() <= most else df


def jaccard_rows(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """``(doc_id, mark, n_shingles, component_id, first_key, first_mark)`` for each row; see ``jaccard_components``.

    ``mark`` is a hash of a row's content (of its text, by default). The first row of a
    component, by id (null last) and mark, is named by key (0 for null) and
    mark. For rows without shingles these two are null.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), (mark if mark is not None else F.xxhash64(F.col(text))).alias("mark"), F.col(text).cast("string").alias("text"))
    seed = 0
    while True:
        sets = settle(plain.mapInArrow(_own_sets(k, seed), "doc_id long, mark long, n_shingles long, node long, twin long, sketch binary"), "sets")
        full = sets.where("n_shingles > 0")
        reps = settle(full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"), F.min("twin").alias("low"), F.max("twin").alias("high")), "reps")
        if reps.where("low <> high").isEmpty():
            break
        seed += 1  # two sets share 64 bits: hash all anew
        release(sets, reps)

    def words(rows: DataFrame) -> DataFrame:
        return rows.select("text").mapInArrow(_keys(k, percent, seed), "key long, node long")

    # which words are hot only decides how they are dealt out, not what meets
    shown = plain.where(F.pmod(F.xxhash64("text"), F.lit(SHOWN)) == 0)
    hot = settle(words(shown).groupBy("key").agg(F.count_distinct("node").alias("m")).where(F.col("m") * SHOWN >= HOT).select("key"), "hot")
    dealt = words(plain).join(_small(hot.select("key", F.lit(True).alias("hot"))), "key", "left")
    dealt = dealt.select("key", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(-1).cast("int").alias("part"), "node")
    by_node = Window.partitionBy("key", "part").orderBy("node")
    seen = dealt.select("key", "part", "node", F.first("node").over(by_node.rowsBetween(Window.unboundedPreceding, 0)).alias("center"), F.lag("node").over(by_node).alias("back"), F.lead("node").over(by_node).alias("ahead"))
    member = "(node = center and (part >= 0 or ahead <> node)) or (node <> center and back <> node)"
    groups = settle(seen.where(member).select("key", "part", "node", "center"), "groups")
    heads = groups.where("part >= 0 and node = center").select("key", "node", F.min("node").over(Window.partitionBy("key")).alias("center"))
    links = groups.select("node", "center").union(heads.select("node", "center")).where("node <> center").distinct()

    wanted = groups.select("node").distinct()
    sketches = settle(full.select("node", F.col("n_shingles").alias("n"), "sketch").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sketches")
    left = links.join(sketches.select(F.col("node").alias("center"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "center")
    both = left.join(sketches.select("node", F.col("n").alias("nb"), F.col("sketch").alias("sb")), "node")
    near = settle(both.select(F.col("center").alias("a"), F.col("node").alias("b"), "na", "nb", "sa", "sb").mapInArrow(_near_pairs(percent), "a long, b long"), "near")

    def texts_of(pairs: DataFrame, most: int) -> DataFrame:
        nodes = narrow(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), most).distinct()
        named = (F.broadcast(nodes) if 2 * most <= BROADCAST_ROWS else nodes).join(reps, "node")
        asked = settle(named.select("node", F.coalesce("first.doc_id", F.lit(0)).alias("key"), F.col("first.mark").alias("mark")), "asked")
        rows = plain.select(F.coalesce("doc_id", F.lit(0)).alias("key"), "mark", "text").join(_small(asked, BROADCAST_ROWS), ["key", "mark"]).select("node", "text")
        # rows repeated as a whole bring their node's text as often
        out = settle(rows, "texts")
        if out.count() > asked.count():
            once = settle(out.dropDuplicates(["node"]), "texts")
            release(out)
            out = once
        release(asked)
        return out

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Each center's text meets the texts of its pairs, so many at a time: a text travels once a pair, a center once a side."""
        pairs = narrow(pairs, pairs.count())
        times = pairs.groupBy("a").agg(F.count("*").alias("m"))
        sides = pairs.join(times, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / SIDE)).cast("int").alias("side"))
        asked = sides.select("a", "side", F.lit(1).alias("role"), F.col("b").alias("node")).union(sides.select("a", "side", F.lit(0).alias("role"), F.col("a").alias("node")).distinct())
        asked = settle(asked, "sides")
        rows = texts.join(_small(asked), "node").select("a", "side", "role", "node", "text")
        out = settle(rows.repartition("a", "side").sortWithinPartitions("a", "side", "role").mapInArrow(_verify(k, percent), "a long, b long, ok boolean"), "tested")
        release(asked)
        return out

    def labelled(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        a, b = (comp.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")

    tested: list[DataFrame] = []

    def connected(pairs: DataFrame, comp: DataFrame, few: int = 1) -> DataFrame:
        """Components once no pair is open; a few pairs of each component a round, most are settled by then."""
        most = pairs.count()
        texts, mine = texts_of(pairs, most), []
        while True:
            known = comp.count()
            crossing = labelled(narrow(pairs, most), narrow(comp, known))
            for done in mine:
                crossing = crossing.join(narrow(done.select("a", "b"), most), ["a", "b"], "left_anti")
            crossing = narrow(crossing, most)
            line = Window.partitionBy(F.greatest("ca", "cb")).orderBy(F.least("ca", "cb"), "a", "b")
            pick = settle(crossing.withColumn("r", F.row_number().over(line)).where(F.col("r") <= few).select("a", "b"), "pick")
            if pick.isEmpty():
                release(pick, texts)
                return comp
            mine.append(verified(pick, texts))
            tested.append(mine[-1])
            after = settle(components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(mine[-1].where("ok").select("a", "b")), most=known + most), "components")
            release(pick, comp)
            comp, few = after, few * 8

    comp = connected(near, settle(components(near.limit(0), most=0), "components"))
    # a group of two has met
    rest = settle(groups.groupBy("key").agg(F.count("*").alias("m")).where("m > 2").select("key"), "rest")
    # at first a few pairs stand for two components, then each member meets each other component by itself
    few, joins = 2, True
    while True:
        mine = groups.select("key", "node").join(rest, "key", "left_semi").join(comp, F.col("node") == F.col("id"), "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        parts = mine.groupBy("key", "c").agg(F.count("*").alias("m"))
        split = settle(parts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("many"), F.sum("m").alias("all"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"), "split")
        # members outside the largest component meet it and each other; chunk i of theirs meets chunk j of either
        own = mine.join(_small(split), "key").withColumn("out", F.col("c") != F.col("main"))
        chunks_in, chunks_out = F.ceil(F.col("many") / CHUNK), F.ceil((F.col("all") - F.col("many")) / CHUNK)
        chunk = F.pmod(F.xxhash64("node"), F.when(F.col("out"), chunks_out).otherwise(chunks_in))
        pairs_out = F.transform(F.sequence(F.lit(0), chunks_out - 1), lambda i: F.struct(F.lit("o").alias("kind"), F.least(i, F.col("chunk")).alias("c0"), F.greatest(i, F.col("chunk")).alias("c1"), F.col("chunk").alias("side")))
        met_in = F.transform(F.sequence(F.lit(0), chunks_in - 1), lambda j: F.struct(F.lit("i").alias("kind"), F.col("chunk").alias("c0"), j.alias("c1"), F.lit(-1).cast("long").alias("side")))
        met_out = F.transform(F.sequence(F.lit(0), chunks_out - 1), lambda i: F.struct(F.lit("i").alias("kind"), i.alias("c0"), F.col("chunk").alias("c1"), F.lit(-2).cast("long").alias("side")))
        dealt = own.withColumn("chunk", chunk).withColumn("met", F.explode(F.when(F.col("out"), F.concat(pairs_out, met_in)).otherwise(met_out))).select("key", "node", "c", "met.*")
        bad = [t.where("not ok").select("a", "b") for t in tested] or [near.limit(0)]
        failed = [x for t in bad for x in (t.select(F.col("a").alias("node"), F.col("b").alias("x")), t.select(F.col("b").alias("node"), F.col("a").alias("x")))]
        failed = reduce(DataFrame.union, failed).groupBy("node").agg(F.collect_set("x").alias("failed"))
        run = ["key", "kind", "c0", "c1"]
        rows = dealt.join(sketches, "node").join(failed, "node", "left").select(*run, "side", "node", "c", "n", "sketch", "failed").repartition(*run).sortWithinPartitions(*run)
        found = settle(rows.mapInArrow(_open_groups(percent, few, joins), "key long, a long, b long, cut boolean"), "found")
        before = len(tested)
        comp = connected(found.select("a", "b").distinct(), comp, few=8)
        # a pair that stood for others in its group and failed: they meet in the next round
        wrong = [t.where("not ok").select("a", "b") for t in tested[before:]]
        again = settle((found.where("cut").join(reduce(DataFrame.union, wrong), ["a", "b"], "left_semi") if wrong else found.limit(0)).select("key").distinct(), "rest")
        release(split, found, rest)
        rest = again
        if rest.isEmpty():
            break
        few, joins = few * 32, False

    named = reps.join(comp, F.col("node") == F.col("id"), "left").select("node", "first", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("least"))
    placed = settle(named.join(least, "c").select("node", "least"), "placed")
    release(groups, hot, rest, sketches, near, comp, reps, *tested)
    out = full.join(placed, "node").select("doc_id", "mark", "n_shingles", F.col("least.doc_id").alias("component_id"), F.coalesce("least.doc_id", F.lit(0)).alias("first_key"), F.col("least.mark").alias("first_mark"))
    none = F.lit(None).cast("long")
    return out.union(sets.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), none.alias("first_key"), none.alias("first_mark")))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row: the smallest id reachable by links of Jaccard similarity ``percent`` or more.

    Links need not all be listed for that: within the group of one sketch
    word, each member meets the group's first; then, in groups whose members
    are in different components, pairs meet that would join these, until none
    is left. Pairs that meet are first held against each other by bit sketches,
    whose Hamming distance is no more than the symmetric difference, then
    verified on their whole shingle sets; sketches, not texts, travel for all
    but those. Equal sets are one node throughout, however many rows have
    them; two 64-bit hashes say whether they are equal. A word that many sets
    share is dealt out in parts, which meet through their first members.

    Null or empty texts, or texts of white space, have no shingles and link
    with nothing. Repeated rows are in one component. A null id stays null,
    links what it is similar to, and is never the smallest while its component
    has another. Empty tables give empty results; other columns do not matter.
    """
    return jaccard_rows(docs, k, percent, key, text).select("doc_id", "n_shingles", "component_id")

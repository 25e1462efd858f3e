"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, fresh, release, row_mark, settle, ship

ship(__name__)

#: Sources whose facts are broadcast at most.
BROADCAST_SOURCES = 100_000
#: Rows of a slice of the rank scale, about.
SLICE = 2048


def word_count(text: Column) -> Column:
    """Number of runs of non-white characters; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A fixed pseudo-random number in (0, 1) for a key: 52 bits of MD5."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)


def water_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, source_size)`` to targets: the total is shared by weight, no target above ``most`` times its source's size.

    Sources in code-point order, null last, take ``weights`` in turn. What
    capped sources leave goes to the others by weight, until none is above:
    in order of cap over weight, a source is capped if the level that the
    sources from it on would reach is at or above its own.
    All sums are whole numbers up to the last division. One row a source: these
    windows see no documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(every) - 1) % len(weights) + 1)
    rows = sources.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("all_size", F.sum("source_size").over(total))
        .withColumn("w_rest", F.sum("w").over(rest))
        .withColumn("cap_done", F.coalesce(F.sum("cap").over(done), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("w_rest") <= (F.col("all_size") - F.col("cap_done")) * F.col("w"))
        .withColumn("left", F.col("all_size") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(total), F.lit(0)))
        .withColumn("w_left", F.sum(F.when(~F.col("capped"), F.col("w"))).over(total))
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("left")).cast("double") / F.col("w_left"))
    return rows.select("source", "source_size", "source_rows", target.alias("target"))


def _ranked(rows: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """``rows`` (key, source, size, emphasis, u, mark) with their source's facts, whole copies and Pareto rank.

    Facts are broadcast where the sources are few; else Spark joins and splits a hot source.
    """
    rate = F.when(F.col("d.size") > 0, F.least(F.lit(float(most)), F.try_divide(F.col("f.target"), F.col("f.source_size")) * F.col("d.emphasis"))).otherwise(0.0)
    joined = rows.alias("d").join(facts.alias("f"), F.expr("d.source <=> f.source")).select("d.*", *[f"f.{c}" for c in facts.columns if c != "source"], F.floor(rate).cast("long").alias("copies"), rate.alias("rate"))
    p = F.col("rate") - F.col("copies")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return joined.withColumn("p", p).withColumn("rank", F.when(F.col("p") > 0, odds)).drop("rate", "p")


def _order(prefix: str = "") -> Column:
    """A row's place among those of its source; rows that tie in it are equal in key, size and mark."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("rank", "key", "size", "mark")])


def mixture(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row a source: size, target, and the place at which the sampling of its rows ends.

    ``sized`` has key, source, size, emphasis, u and mark, but no text. Ranks are never
    gathered by source: sizes are summed per slice of the rank scale, the
    slice that holds the end is found on those sums, and only its distinct
    places are ordered. Of ``cut_all`` equal rows at the end's place,
    ``cut_take`` are taken.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = settle(water_targets(sources, weights, most), "targets", 1)
    few = targets.count() <= BROADCAST_SOURCES
    ranked = _ranked(sized, F.broadcast(targets) if few else targets, most)
    part = F.try_divide(F.col("target"), F.col("source_size")) - F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    part = F.least(F.greatest(F.coalesce(part, F.lit(0.5)), F.lit(1e-6)), F.lit(1 - 1e-6))
    # even slices: back from Pareto's scale to u's, as if all rows of the source had its own rate
    even = F.col("rank") * part / (1 - part)
    ranked = ranked.withColumn("slice", F.floor(even / (1 + even) * F.ceil(F.col("source_rows") / F.lit(SLICE))).cast("long"))
    slices = settle(ranked.groupBy("source", "slice").agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("size") * F.col("copies")).alias("sure"), F.first("target").alias("target")), "slices")
    # at most one row per SLICE documents and source
    room = slices.groupBy("source").agg((F.first("target") - F.sum("sure")).alias("room"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slices.where("slice is not null").withColumn("ahead", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = ahead.alias("a").join(room.alias("r"), F.expr("a.source <=> r.source")).where("ahead + words > room")
    ends = settle(ends.groupBy("a.source").agg(F.min(F.struct("slice", "ahead", "room")).alias("e")).select("source", "e.*"), "ends", 1)
    inside = ranked.alias("d").join(F.broadcast(ends).alias("e") if few else ends.alias("e"), F.expr("d.source <=> e.source and d.slice = e.slice")).select("d.source", "d.rank", "d.key", "d.size", "d.mark", "e.ahead", "e.room")
    places = inside.groupBy("source", "rank", "key", "size", "mark", "ahead", "room").agg(F.count("*").alias("cut_all"))
    line = Window.partitionBy("source").orderBy("rank", "key", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = places.withColumn("before", F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("cut_all")).over(line), F.lit(0))).where("before + size * cut_all > room")
    half = F.floor((F.col("room") - F.col("before")) / F.col("size") + 0.5)
    end = placed.groupBy("source").agg(F.min(F.struct("rank", "key", "size", "mark", "cut_all", F.greatest(F.lit(0), F.least(F.col("cut_all"), half)).cast("long").alias("cut_take"))).alias("cut"))
    out = targets.alias("t").join(end.alias("c"), F.expr("t.source <=> c.source"), "left").select("t.source", "t.source_size", "t.target", F.expr("struct(c.cut.rank, c.cut.key, c.cut.size, c.cut.mark)").alias("cut"), F.col("c.cut.cut_all").alias("cut_all"), F.col("c.cut.cut_take").alias("cut_take"))
    return settle(out, "mixture", 1)


def _copies(rows: DataFrame, measured: Callable[[DataFrame], DataFrame], facts: DataFrame, most: int, carry: list[str]) -> DataFrame:
    """``rows`` with ``copies``: those ahead of their source's end get one more. Equal rows at the end are counted, then dealt.

    ``measured`` adds size, emphasis, u and mark to rows with key and source.
    """
    seen = facts.agg(F.count("*").alias("n"), F.max("cut_all").alias("most")).first()
    facts = F.broadcast(facts) if seen["n"] <= BROADCAST_SOURCES else facts
    names = ["key", "source", "size", "source_size", "target", "copies", *carry]
    ranked = _ranked(measured(rows), facts, most)
    at_end = F.coalesce(F.col("rank").isNotNull() & (_order() == F.col("cut")), F.lit(False))
    more = F.when(F.col("rank").isNull(), 0).when(F.col("cut_all").isNull() | (_order() < F.col("cut")), 1).when(_order() == F.col("cut"), F.col("cut_take")).otherwise(0)
    if (seen["most"] or 1) == 1:  # one row at each end
        return ranked.withColumn("copies", F.col("copies") + more).select(*[column(n) for n in names])
    near = rows.alias("d").join(facts.alias("f"), F.expr("d.source <=> f.source and d.key <=> f.cut.key"), "left_semi")
    last = _ranked(measured(near), facts, most)
    clear = ranked.where(~at_end).withColumn("copies", F.col("copies") + more).select(*[column(n) for n in names])
    ends = last.where(at_end).groupBy(*[column(n) for n in names], "cut_all", "cut_take").agg(F.count("*").alias("rows"))
    each = F.explode(F.array(F.struct(F.lit(1).alias("more"), F.least("rows", "cut_take").alias("times")), F.struct(F.lit(0).alias("more"), (F.col("rows") - F.least("rows", "cut_take")).alias("times"))))
    dealt = ends.withColumn("each", each).where("each.times > 0").withColumn("copies", F.col("copies") + F.col("each.more")).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("each.times"))))
    return clear.union(dealt.select(*[column(n) for n in names]))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 7,
    emphasis: Column | None = None,
) -> DataFrame:
    """How many copies of each row a mixture takes.

    A source whose target is r times its size expects r copies of each row
    (times ``emphasis``, if given, at most ``most``). The whole part is taken
    for certain. The rest p is an inclusion probability: rows are ranked by
    Pareto's odds(u) / odds(p), u a fixed hash of the key, and taken in that
    order until the source's words reach its target; the row in which the
    target falls is taken if half of it or more fits.

    Rows with null or empty text have size 0 and are taken 0 times. Null
    sources form one source. Repeated rows are rows of their own: they are
    ordered by key, size and a hash of the text, and of rows equal in all three as
    many as fit are taken. Empty tables give empty results. Returns doc_id,
    source, size, source_size, target, copies and taken; other columns of
    ``docs`` do not matter.
    """
    weight = emphasis if emphasis is not None else F.lit(1.0)
    u = uniform(F.col(key), seed).alias("u")
    sized = settle(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), weight.cast("double").alias("emphasis"), u, F.xxhash64(F.col(text)).alias("mark")), "sizes")
    out = _copies(sized, lambda rows: rows, mixture(sized, weights, most), most, [])
    return out.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mixture itself: each row as often as it is taken, with the columns of ``docs``.

    Where sampling ends is found without texts; then one scan of ``docs``
    repeats each row by its own key and its source's facts, without a shuffle.
    Only rows equal in all columns at a source's end are counted together.
    Null and empty texts are taken 0 times, null ids and sources count as
    values; columns of any name, and empty tables, give what the rows say.
    """
    # inner names stay inner: the row's own columns travel under numbers
    inside = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[column(c).alias(i) for c, i in zip(docs.columns, inside, strict=True)], F.col("doc_id").alias("key"), F.col("source").alias("source"))
    text = F.col(inside[[c.lower() for c in docs.columns].index("text")])

    def measured(df: DataFrame) -> DataFrame:
        own = df.select(*inside)
        return df.withColumns({"size": word_count(text), "emphasis": F.lit(1.0), "u": uniform(F.col("key"), seed), "mark": row_mark(own)})

    sized = settle(measured(rows).select("key", "source", "size", "emphasis", "u", "mark"), "sizes")
    facts = mixture(sized, weights, most)
    release(sized)
    out = _copies(rows, measured, facts, most, inside).where("copies > 0")
    (times,) = fresh(docs, "times")
    return out.select(*[column(i).alias(c) for c, i in zip(docs.columns, inside, strict=True)], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(times)).drop(times)

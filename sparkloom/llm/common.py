"""Shared pieces: shared-folder tables, row marks, worker shipping, connected components."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..operators.shared import release, settle, shared_folder

__all__ = ["column", "components", "fresh", "marked_rows", "release", "row_key", "row_mark", "settle", "shared_folder", "ship"]

#: White space of the word contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of 16 bytes that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Links from which on a round's minima are written, so that a hub's rows can be split between tasks.
HUB_LINKS = 1_000_000
#: Links that one task takes in a round; so few need no shuffle.
TASK_LINKS = 100_000


def ship(module: str) -> None:
    """Send functions of a module to executors by value: workers need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_mark(df: DataFrame) -> Column:
    """64 bits of all columns of a row, nulls told apart from values. With the row's key it names the row's content."""
    parts: list[Column] = []
    for field in df.schema.fields:
        own = column(field.name)
        parts += [own.isNull(), F.array_sort(F.map_entries(own)) if isinstance(field.dataType, MapType) else own]
    return F.xxhash64(*parts)


def row_key(name: str = "doc_id") -> Column:
    """The key as a number that joins: null as 0, which the row's mark tells apart."""
    return F.coalesce(F.col(name).cast("long"), F.lit(0))


def marked_rows(docs: DataFrame, rows: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that are (``left_semi``) or are not (``left_anti``) in ``rows``, distinct pairs ``(key, mark)``.

    Up to BROADCAST_ROWS pairs are broadcast, so no text is shuffled; beyond
    that the join shuffles by key. The result is the same.
    """
    a, b = fresh(docs, "key", "mark")
    asked = rows.select(F.col("key").alias(a), F.col("mark").alias(b))
    if rows.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    named = docs.select("*", row_key(key).alias(a), row_mark(docs).alias(b))
    return named.join(asked, [a, b], how).select(*[column(c) for c in docs.columns])


def narrow(rows: DataFrame, most: int | None) -> DataFrame:
    """``rows`` in one task if they are at most ``most`` and that is no more than TASK_LINKS: their joins and groups then need no shuffle."""
    return rows.coalesce(1) if most is not None and most <= TASK_LINKS else rows


def _joined(batches):
    """Each end of the links of a task, with the smallest end that it reaches."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([top(x) for x in list(above)], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, vertex: str = "bigint", most: int | None = None) -> DataFrame:
    """Connected components of undirected links ``(a, b)``, as ``(id, component)`` with the smallest id of each.

    Rounds of large-star and small-star, each a shuffle on one column. Links
    are kept as (larger end, smaller end). A round joins links to the minima of
    their ends; with many links the minima are written first, so that Spark can
    split the rows of a hub over several tasks. Links of one task, TASK_LINKS at
    most, make their round in that task without a shuffle. ``most`` is a bound of
    their number, where the caller knows one; if it fits one task, that task joins
    them in one pass without rounds. Rows with a null or equal ends link nothing.
    Vertices without a link are not returned.
    """
    if vertex == "bigint" and most is not None and most <= TASK_LINKS:
        few = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        return few.coalesce(1).mapInArrow(_joined, "id long, component long")
    cur = settle(
        narrow(edges, most)
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        seen = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (seen["n"], seen["h"])
        if state == before or not seen["n"]:
            break
        before = state
        tasks = -(-seen["n"] // TASK_LINKS)

        def minima(pairs: DataFrame, n: int = seen["n"]) -> DataFrame:
            low = pairs.groupBy("u").agg(F.min("v").alias("m"))
            return settle(low, "minima") if n > HUB_LINKS else low

        links = narrow(cur, seen["n"])
        low = minima(links)
        # each larger neighbour of a vertex, and the vertex itself, goes to the smallest that the vertex sees
        up = links.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = settle(narrow(up.union(low.select("u", F.col("m").alias("v"))), seen["n"]).distinct(), "links", tasks)
        links = narrow(large, seen["n"])
        small_low = minima(links)
        small = links.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(narrow(small.union(small_low.select("u", F.col("m").alias("v"))), seen["n"]).distinct(), "links", tasks)
        release(cur, low, large, small_low)
        cur = after
    cur = narrow(cur, seen["n"])
    roots = cur.select(F.col("v").alias("id")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component"))).select(F.col("id").cast(vertex), F.col("component").cast(vertex))

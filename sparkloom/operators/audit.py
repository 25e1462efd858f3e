"""Duplicates, consistency, reconciliation and order-free digests of tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, ship

ship(__name__)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def inconsistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value; a missing value counts as one."""
    kinds = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(key).agg(kinds.alias("kinds")).where("kinds > 1")


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's columns in name order, each with its length, so that no border moves; nulls are told from empty strings."""
    text = lambda c: F.col(c).cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit("="), text(c)), F.lit("~")) for c in sorted(df.columns)]), 256)


def multiset(digest: Column) -> list[Column]:
    """``n`` and ``digest`` of SHA-256 values whatever their order: the eight words of each are summed, and the sums hashed.

    Sums combine before the shuffle; repeated values count each time.
    """
    words = [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    return [F.count("*").alias("n"), F.sha2(F.concat_ws(",", *[w.cast("string") for w in words]), 256).alias("digest")]


def digest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and digest of a table's rows, which do not depend on their order."""
    return df.groupBy(*(by or [])).agg(*multiset(row_hash(df)))


def _written(size: int):
    """Vectors of ``size`` components as text of nine digits each, rounded from exact values, halves to even, as C and SQL write them; Spark rounds halves up."""
    line = ",".join(["%.8e"] * size)

    def write(vectors: pa.Array) -> pa.Array:
        numbers = vectors.flatten().to_pylist()
        return pa.array([line % tuple(numbers[k : k + size]) for k in range(0, len(numbers), size)], pa.string())

    return F.arrow_udf(write, "string")


def index_hash(df: DataFrame, record: Column, vector: str, size: int) -> DataFrame:
    """Count and digest of an index: each row's record with its length before it, and its vector to nine digits a component.

    Nine digits tell all 32-bit floats apart. A vector that is null, of another
    length than ``size``, or with a null or non-finite component fails the query.
    """
    sound = (F.size(vector) == size) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col(vector)).otherwise(F.raise_error(F.lit(f"vectors need {size} finite components")))
    numbers = _written(size)(checked)
    return df.agg(*multiset(F.sha2(F.concat(F.octet_length(record).cast("string"), F.lit(":"), record, numbers), 256)))


def align(rows: DataFrame, reference: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``: the place of their key in ``reference`` by ``order``.

    ValueError names the first key that either side has twice, or that one side lacks.
    """
    for side, df in (("rows", rows), ("reference", reference)):
        twice = df.groupBy(key).count().where("count > 1").orderBy(key).limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0][key]}: twice in the {side}")
    for side, a, b in (("reference", rows, reference), ("rows", reference, rows)):
        lost = a.join(b, a[key].eqNullSafe(b[key]), "left_anti").orderBy(key).limit(1).collect()
        if lost:
            raise ValueError(f"{lost[0][key]}: not in the {side}")
    placed = renumber(reference.select(F.lit(0).alias("_group"), *dict.fromkeys([key, *order])), "_group", order, "place").select(F.col(key).alias("_key"), "place")
    return rows.join(placed, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def renumber(rows: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """``name`` from 0 in each group by ``order``, ties in any order.

    Rows are dealt out by ranges of group and order and written; a range starts
    at what lies before it, so no group is one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    return dealt.join(starts, [group, "_range"]).withColumn(name, (F.col("_start") + F.row_number().over(inside) - 1).cast("long")).drop("_range", "_start")


def reconcile(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that are missing, extra or differ in a field, with the names of those fields."""
    a, b = old.select(key, F.struct(*fields).alias("a")), new.select(key, F.struct(*fields).alias("b"))
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]), lambda x: x.isNotNull())
    both = a.join(b, key, "full").select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.size(differ) > 0, "differs").alias("state"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(differ, ",")).otherwise("").alias("fields"))
    return both.where("state is not null")

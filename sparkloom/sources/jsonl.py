"""JSON Lines sources and sinks: schema-first, fail-loud scans; ordered, never-overwriting exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON Lines files; a malformed line fails the query if ``strict``, else it is left out."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(paths)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, by Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            out.append(p)
    return out


def scan_all(spark: SparkSession, paths: list[str], schema: str, fallback: str | None = None) -> DataFrame:
    """All files that exist, concatenated; if they have no row, the fallback file."""
    there = existing(spark, paths)
    rows = scan(spark, there, schema) if there else spark.createDataFrame([], schema)
    return scan(spark, fallback, schema) if fallback and rows.isEmpty() else rows


def merge_inputs(inputs: list[DataFrame], key: str) -> DataFrame:
    """Inputs one after another with ``input`` as their number; a key that comes twice fails the query."""
    every = reduce(DataFrame.unionByName, [d.withColumn("input", F.lit(k)) for k, d in enumerate(inputs)])
    twice = every.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys given twice: {[r[key] for r in twice]}")
    return every


def export_ordered(df: DataFrame, path: str, order: list[str], tasks: int = 1) -> None:
    """Write rows in order as JSON Lines, one file a range; an existing path fails."""
    df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.mode("errorifexists").json(path)

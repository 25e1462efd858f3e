"""JSON Lines that refuse what a lenient parser lets through: repeated keys at any depth, malformed and blank lines, with line numbers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.shared import ship

ship(__name__)


def _unique(pairs: list[tuple]) -> dict:
    out = {}
    for key, value in pairs:
        if key in out:
            raise ValueError(f"repeated key: {key}")
        out[key] = value
    return out


def reason_of(line: str | None) -> str | None:
    """Why a line is refused, None if it is one JSON object without repeated keys."""
    if line is None or not line.strip():
        return "blank line"
    try:
        return None if isinstance(json.loads(line, object_pairs_hook=_unique), dict) else "not an object"
    except json.JSONDecodeError as e:
        return f"malformed: {e.msg} at {e.pos}"
    except (ValueError, RecursionError) as e:
        return str(e) if isinstance(e, ValueError) else "malformed: too deep"


def suspicious(line: Column) -> Column:
    """True for every line that may be refused: the JVM's own parser refuses repeated keys.

    It also stops behind the first value; inside an array and inside an object
    a line with anything behind that value can't parse both ways.
    """
    inside = [F.try_parse_json(F.concat(F.lit(a), line, F.lit(b))).isNull() for a, b in (("[", "]"), ('{"k":', "}"))]
    return inside[0] | inside[1] | ~F.startswith(F.ltrim(F.coalesce(line, F.lit(""))), F.lit("{"))


def line_faults(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that are refused, with ``fault`` added. All lines are parsed in the JVM; Python sees the suspicious ones only."""
    name = F.udf(reason_of, StringType(), useArrow=True)
    return lines.where(suspicious(F.col(value))).withColumn("fault", name(F.col(value))).where("fault is not null")


def numbered_faults(spark: SparkSession, paths: list[str], limit: int = 20) -> list[tuple[str, int, str]]:
    """(file, line number from 1, fault) of refused lines, the first ``limit`` by file and line; empty for good files.

    Lines are counted by block of a file only if some line is refused.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    bad = line_faults(raw).select("file", "block", "at", "fault")
    found = bad.orderBy("file", "block", "at").limit(limit).collect()
    if not found:
        return []
    files = spark.createDataFrame(sorted({(r["file"],) for r in found}), "file string")
    narrow = raw.join(F.broadcast(files), "file").groupBy("file", "block")
    counts = narrow.agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = {(r["file"], r["block"]): r["start"] - r["first"] for r in counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).collect()}
    return [(r["file"], r["at"] + starts[r["file"], r["block"]] + 1, r["fault"]) for r in found]


def read_strict(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON Lines files by ``schema``; ValueError names file, line and reason of the first refused line.

    Keys that the schema does not have are left out, absent ones are null.
    """
    faults = numbered_faults(spark, paths, 1)
    if faults:
        file, number, fault = faults[0]
        raise ValueError(f"{file}:{number}: {fault}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)

"""One text to many rows by a fold, in Arrow batches; and windows that are rows joined to whole texts again."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import structure
from .shared import ship

ship(__name__)
ship(structure.__name__)

#: Characters of text that one output batch is made of, about.
AT_ONCE = 1 << 22


def _run(fold: Callable[..., Iterable[tuple]], kinds: list, names: list[str]):
    def flush(rows: list[tuple], owner: list[int], kept: pa.RecordBatch) -> pa.RecordBatch:
        made = [pa.array(list(own), kind) for own, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*kept.take(pa.array(owner)).columns, *made], names=names)

    def run(batches):
        for batch in batches:
            kept = batch.select(batch.schema.names[:-1])
            rows: list[tuple] = []
            owner: list[int] = []
            size = 0
            for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if text is None:
                    continue
                own = list(fold(text))
                rows += own
                owner += [k] * len(own)
                size += len(text) if isinstance(text, str) else sum(len(x) for x in text.values() if isinstance(x, str))
                if rows and size > AT_ONCE:
                    yield flush(rows, owner, kept)
                    rows, owner, size = [], [], 0
            if rows:
                yield flush(rows, owner, kept)

    return run


def fold_rows(df: DataFrame, keys: list[str], text: str, fold: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``keys`` of each row beside each tuple that ``fold`` makes of its ``text``; null texts give no rows. No shuffle.

    ``text`` may be a struct column, which ``fold`` gets as a dict.

    ``schema`` is the DDL of the tuples. Rows are folded one by one, so
    repeated keys do not mix; a text is held whole in its task.
    """
    plain = df.select(*keys, F.col(text).alias("_text"))
    made = _parse_datatype_string(schema)
    out = StructType(plain.schema.fields[:-1] + made.fields)
    return plain.mapInArrow(_run(fold, [f.type for f in to_arrow_schema(made)], out.names), out)


def structure_units(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lossless numbered units of each text; see ``functions.structure.units``."""
    return fold_rows(df, keys, text, structure.units, structure.UNIT)


def packed_lines(df: DataFrame, keys: list[str], text: str = "text", target: int = structure.TARGET) -> DataFrame:
    """Lines packed to chunks of about ``target`` characters; see ``functions.structure.packed``."""
    return fold_rows(df, keys, text, lambda x: structure.packed(x, target), structure.PACK)


def window_rows(df: DataFrame, keys: list[str], text: str = "text", size: int = structure.SIZE, least: int = structure.LEAST, overlap: int = structure.OVERLAP) -> DataFrame:
    """Overlapping windows of each text as rows; see ``functions.structure.windows``. ``overlap`` is below ``least``, ``least`` below ``size``."""
    if not 0 <= overlap < least < size:
        raise ValueError("windows need 0 <= overlap < least < size")
    return fold_rows(df, keys, text, lambda x: structure.windows(x, size, least, overlap), structure.WINDOW)


def stitch(windows: DataFrame, group: list[str], identity: list[str] | None = None, body: str = "body") -> DataFrame:
    """Windows of a group joined to one body: ``group``, ``body``, ``source_start``, ``source_end``, ``n_windows``, ``fault``.

    Windows are ordered by source_start and source_end; each adds what lies
    behind the furthest end before it. ``fault`` names the first reason why a
    group is not one continuous text, else it is null and the body is exact:
    ``identity`` (columns of ``identity`` differ from the first window's),
    ``length`` (a body is not as long as its span), ``gap``, ``overlap`` (the
    text both windows have differs). With a fault the body is null. A group is
    shuffled once and held in one task, as its body is one value.
    """
    own = Window.partitionBy(*group).orderBy("source_start", "source_end", body)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # the furthest window before covers all that this one may share with earlier ones
    far = F.max_by(F.struct(F.col("source_start").alias("start"), F.col("source_end").alias("end"), F.col(body).alias("text")), F.struct("source_end", "source_start")).over(before)
    at = windows.withColumn("_far", far).withColumn("_first", F.first(F.struct(*(identity or group))).over(own))
    width = F.col("source_end") - F.col("source_start")
    shared = F.least(F.col("_far.end"), F.col("source_end")) - F.col("source_start")
    same = F.substring(F.col("_far.text"), (F.col("source_start") - F.col("_far.start") + 1).cast("int"), shared.cast("int")) == F.substring(F.col(body), F.lit(1), shared.cast("int"))
    fault = (
        F.when(~F.struct(*(identity or group)).eqNullSafe(F.col("_first")), "identity")
        .when(F.coalesce(F.length(body), F.lit(-1)) != width, "length")
        .when(F.col("source_start") > F.col("_far.end"), "gap")
        .when(~same, "overlap")
    )
    part = F.substring(F.col(body), F.greatest(F.coalesce(F.col("_far.end") - F.col("source_start"), F.lit(0)), F.lit(0)).cast("int") + 1, F.greatest(width, F.lit(0)).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("source_start", "source_end", part.alias("part"))))
    faults = F.min(F.when(fault.isNotNull(), F.struct("source_start", fault.alias("fault"))))["fault"]
    joined = at.groupBy(*group).agg(listed.alias("_parts"), F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"), F.count("*").alias("n_windows"), faults.alias("fault"))
    whole = F.array_join(F.transform("_parts", lambda p: p["part"]), "")
    return joined.select(*group, F.when(F.col("fault").isNull(), whole).alias(body), "source_start", "source_end", "n_windows", "fault")

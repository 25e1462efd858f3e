"""Upserts, scoped deletes, version history, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scoped_merge(old: DataFrame, new: DataFrame, key: str, scope: str, prune_all: bool = False) -> DataFrame:
    """Upsert by key. Old rows that the input lacks go only in scopes that the input touches; empty input removes nothing."""
    rest = old.join(new.select(key), key, "left_anti")
    touched = new.select(scope).distinct()
    kept = rest.join(new.limit(1).select(F.lit(1).alias("_any")), how="left_anti") if prune_all else rest.join(touched, scope, "left_anti")
    return new.unionByName(kept.select(*new.columns))


def sync_states(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Each key of either side: embed (new or changed text), reuse, or remove."""
    a, b = old.select(key, F.col(text).alias("was"), F.lit(1).alias("in_old")), new.select(key, F.col(text).alias("now"), F.lit(1).alias("in_new"))
    state = F.when(F.col("in_new").isNull(), "remove").when(F.col("in_old").isNull() | ~F.col("was").eqNullSafe(F.col("now")), "embed").otherwise("reuse")
    return a.join(b, key, "full").select(key, state.alias("state"))


def version_history(observed: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """First and last sight of each distinct state of a key."""
    return observed.groupBy(key, F.sha2(F.col(value).cast("string"), 256).alias("checksum")).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("sights"))


def changes(observed: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value differs from the key's row before; the first row of a key is no change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return observed.withColumn("before", before).where(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col(value)))


def checklist_sync(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """States after a sync: absent todo items are dismissed, returning dismissed ones are todo again, done stays done."""
    w = wanted.select(key, F.lit(True).alias("wanted"))
    state = F.col("state")
    after = F.when(state.isNull(), "todo").when(state == "done", "done").when(F.col("wanted"), "todo").otherwise("dismissed")
    return current.select(key, "state").join(w, key, "full").select(key, after.alias("state"))

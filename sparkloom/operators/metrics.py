"""Retrieval metrics over ranked lists and gold lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Whether the first ``k`` hold a gold id."""
    return F.arrays_overlap(F.slice(retrieved, 1, k), gold)


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of distinct gold ids in the first ``k``; 0 without gold."""
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(F.size(gold) == 0, 0.0).otherwise(found / F.size(F.array_distinct(gold)))


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """One over the first gold's position; 0 if there is none."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(F.lit(1.0) / F.get(places, 0), F.lit(0.0))


def ranked_lists(ranked: DataFrame) -> DataFrame:
    """``(qid, id, rank)`` to ``(qid, retrieved)``; lists are as long as the top-k that made them."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return ranked.groupBy("qid").agg(F.transform(listed, lambda s: s["id"]).alias("retrieved"))


def standard_error(p: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.sqrt(p * (1 - p) / n))

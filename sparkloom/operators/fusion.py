"""Fusing and re-ranking of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import DIGITS, top_k


def reciprocal_rank_fusion(members: list[tuple[DataFrame, float]], k: int, rrf_k: int = 5, depth: int = 20) -> DataFrame:
    """Sum of weight / (rrf_k + rank) over the members' first max(depth, k) hits ``(qid, id, rank)``; members of weight 0 are left out."""
    reach = max(depth, k)
    parts = [m.where(F.col("rank") <= reach).select("qid", "id", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("part")) for m, w in members if w]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(fused, k)


def band_rerank(hits: DataFrame, k: int, tolerance: float = 0.03) -> DataFrame:
    """``(qid, id, score, rank, level, day)`` to bands of scores within ``tolerance`` of the band's first, by level, newest day, rank inside.

    The anchor is the band's first hit, so bands are a fold over the query's
    ordered hits: a ranked list of bounded depth, not a table.
    """
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", "id", "level", "day"))).alias("hits"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("band"), F.array().cast("array<struct<band:int,s:double,rank:int,id:bigint,level:int,day:bigint>>").alias("out"))

    def step(acc, h):
        score = -h["s"]
        delta = acc["anchor"] - score
        same = (delta == 0) | ((acc["anchor"] > 0) & (delta <= tolerance * acc["anchor"] + 1e-12))
        band = F.when(acc["anchor"].isNotNull() & same, acc["band"]).otherwise(acc["band"] + 1)
        anchor = F.when(acc["anchor"].isNotNull() & same, acc["anchor"]).otherwise(score)
        one = F.struct(band.alias("band"), h["s"].alias("s"), h["rank"].cast("int").alias("rank"), h["id"].cast("bigint").alias("id"), h["level"].cast("int").alias("level"), h["day"].cast("bigint").alias("day"))
        return F.struct(anchor.alias("anchor"), band.alias("band"), F.concat(acc["out"], F.array(one)).alias("out"))

    rows = listed.select("qid", F.explode(F.aggregate("hits", start, step, lambda acc: acc["out"])).alias("h")).select("qid", "h.*")
    order = Window.partitionBy("qid").orderBy("band", "level", F.col("day").desc(), "rank", "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("qid", "id", (-F.col("s")).alias("score"), "band", "place")


def union_max(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Highest finite score for each id of two score lists, first ``k``."""
    both = a.select("qid", "id", "score").unionByName(b.select("qid", "id", "score")).where(~F.isnan("score") & F.col("score").isNotNull())
    return top_k(both.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def fill_to_budget(kept: DataFrame, ranking: DataFrame, budget: int) -> DataFrame:
    """Existing picks first, then the ranking's others, up to ``budget``."""
    both = kept.select("qid", "id", F.lit(0).alias("tier"), "rank").unionByName(ranking.select("qid", "id", F.lit(1).alias("tier"), "rank"))
    once = both.groupBy("qid", "id").agg(F.min(F.struct("tier", "rank")).alias("p"))
    order = Window.partitionBy("qid").orderBy("p", "id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget).select("qid", "id", F.col("p.tier").alias("tier"), "place")


__all__ = ["DIGITS", "band_rerank", "fill_to_budget", "reciprocal_rank_fusion", "union_max"]

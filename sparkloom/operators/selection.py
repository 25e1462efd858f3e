"""Choosing from ranked lists: reserved slots, linked pairs, coverage, replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_rows
from .shared import ship

ship(__name__)


def reserve_by_intent(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(qid, id, rank, intent)``: the best hit of each wanted intent has a place in the first ``k``; the fused order stays."""
    asked = hits.join(wanted.select("qid", "intent", F.lit(True).alias("asked")), ["qid", "intent"], "left")
    first = F.row_number().over(Window.partitionBy("qid", "intent").orderBy("rank")) == 1
    marked = asked.withColumn("kept", F.coalesce(F.col("asked"), F.lit(False)) & first)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("kept"), "rank"))
    chosen = marked.withColumn("place", place).where(F.col("place") <= k)
    return chosen.withColumn("out", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).select("qid", "id", "kept", "out")


def best_linked_pair(hits: DataFrame, links: DataFrame, near: int = 3, far: int = 10) -> DataFrame:
    """``(qid, a, b)``: the linked pair with the lowest worse rank, then rank sum, then ids; one within ``near``, both within ``far``."""
    a = hits.where(F.col("rank") <= far).select("qid", F.col("id").alias("a"), F.col("rank").alias("ra"))
    b = hits.where(F.col("rank") <= far).select("qid", F.col("id").alias("b"), F.col("rank").alias("rb"))
    pairs = a.join(links, "a").join(b, ["qid", "b"]).where((F.col("ra") < F.col("rb")) & (F.least("ra", "rb") <= near))
    best = F.min(F.struct(F.greatest("ra", "rb").alias("worse"), (F.col("ra") + F.col("rb")).alias("total"), "a", "b")).alias("p")
    return pairs.groupBy("qid").agg(best).select("qid", "p.a", "p.b")


def replace_third(ranked: DataFrame, other: DataFrame) -> DataFrame:
    """The first two of one ranking, then the best of the other that is not among them."""
    seed = ranked.where("rank <= 2").select("qid", "id", F.col("rank").cast("long").alias("place"))
    left = other.join(seed.select("qid", "id"), ["qid", "id"], "left_anti")
    third = left.groupBy("qid").agg(F.min_by("id", F.struct("rank", "id")).alias("id")).select("qid", "id", F.lit(3).cast("long").alias("place"))
    return seed.unionByName(third)


def exact_fusion(a: DataFrame, b: DataFrame, weight: int, rrf_k: int, k: int) -> DataFrame:
    """Reciprocal-rank fusion in whole numbers: 1/(c+r) + w/(c+s) as one fraction over a common denominator.

    Ranks go to ``depth`` 20, so numerators over the product of both denominators stay small; ties go
    by the first ranking's place, then id.
    """
    both = a.select("qid", "id", F.col("rank").alias("r")).join(b.select("qid", "id", F.col("rank").alias("s")), ["qid", "id"], "full")
    far = F.lit(10**6)
    r, s = F.coalesce("r", far) + rrf_k, F.coalesce("s", far) + rrf_k
    top = F.when(F.col("r").isNotNull(), s).otherwise(F.lit(0)) + F.when(F.col("s").isNotNull(), r * weight).otherwise(F.lit(0))
    score = top.cast("decimal(28,0)") / (r * s).cast("decimal(28,0)")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.coalesce("r", far), "id"))
    return both.withColumn("score", score).withColumn("place", place).where(F.col("place") <= k).select("qid", "id", "place")


COVER = "place int, id long, score double"


def _greedy(row: dict):
    """Picks of one query: in each step the item with the highest score plus weighted share of query terms not yet covered."""
    left, covered = list(row["items"]), set()
    for place in range(1, row["k"] + 1):
        if not left:
            return
        gains = [x["score"] + row["weight"] * len(set(x["terms"]) - covered) / max(1, row["n_terms"]) for x in left]
        best = left.pop(max(range(len(left)), key=lambda i: (gains[i], -i)))
        covered.update(best["terms"])
        yield place, best["id"], best["score"]


def cover_query(hits: DataFrame, terms: DataFrame, sizes: DataFrame, k: int, weight: float, least: float | None = None, support: DataFrame | None = None) -> DataFrame:
    """``(qid, place, id, score)``: up to ``k`` hits of each query by score and by what they add to the cover of its terms.

    ``hits`` has qid, id, score, parent; ``terms`` the query terms that a hit
    holds (qid, id, term); ``sizes`` the number of a query's different terms
    (qid, n_terms). Hits below ``least`` or not in ``support`` (qid, id) go first,
    then all but the best of each parent (by score, then id); a null parent is
    one. Ties go to the better rank. Without ``weight`` the order stays. A query's
    hits, a stated number of candidates, are one row.
    """
    ranked = hits if least is None else hits.where(F.col("score") >= least)
    if support is not None:
        ranked = ranked.join(support.select("qid", "id").distinct(), ["qid", "id"], "left_semi")
    best = F.row_number().over(Window.partitionBy("qid", "parent").orderBy(F.desc("score"), "id"))
    first = ranked.withColumn("_nr", best).where("_nr = 1").select("qid", "id", "score")
    held = terms.join(first, ["qid", "id"], "left_semi").groupBy("qid", "id").agg(F.collect_set("term").alias("terms"))
    none = F.array().cast(held.schema["terms"].dataType)
    each = first.join(held, ["qid", "id"], "left").select("qid", F.struct((-F.col("score")).alias("down"), "id", "score", F.coalesce("terms", none).alias("terms")).alias("item"))
    listed = each.groupBy("qid").agg(F.array_sort(F.collect_list("item")).alias("items")).join(sizes.select("qid", "n_terms"), "qid")
    row = F.struct(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["terms"].alias("terms"))).alias("items"), "n_terms", F.lit(k).alias("k"), F.lit(float(weight)).alias("weight"))
    return fold_rows(listed.select("qid", row.alias("row")), ["qid"], "row", _greedy, COVER)

"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes the whole table that the one before has kept, written as
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, kneser_ney, mixing, parity_join, sharding
from sparkloom.llm.common import marked_rows, release, row_key, row_mark, settle
from sparkloom.llm.queries import SHARDS
from sparkloom.session import table

#: SQL can't express the stages: the first is a trained model. tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (10) rejects go.

    Each row is judged by its own content, whatever rows share its id; ids only
    find labels, so rows without one are no training text. Null and empty texts
    stay, equal rows stay or go together. Empty tables stay empty; columns of
    any name come back as they are.
    """
    judged = kneser_ney.judge_quality(docs, table(spark, sf_dir, "labels"), mark=row_mark(docs))
    gone = settle(judged.where("not keep").select(row_key().alias("key"), "mark").distinct(), "gone")
    return marked_rows(docs, gone, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (9) stays: five words, similarity 0.8.

    It is the row with the smallest id (null last), then the smallest hash of
    its content; of rows equal in all columns one. Rows are told apart by id and
    content, so unlike texts under one id both stay, and rows without an id go
    like others. Texts without words stay. Empty tables stay empty; columns of
    any name come back as they are.
    """
    rows = parity_join.jaccard_rows(docs, 5, 80, mark=row_mark(docs)).where("n_shingles > 0")
    rows = settle(rows.select(row_key().alias("key"), "mark", F.expr("mark = first_mark").alias("same"), "first_key"), "groups")
    first = F.col("same") & (F.col("key") == F.col("first_key"))
    gone = rows.where(~first).select("key", "mark").distinct()
    twice = settle(rows.where(first).groupBy("key", "mark").count().where("count > 1").select("key", "mark"), "twice")
    kept = marked_rows(docs, settle(gone.union(twice), "gone"), "left_anti")
    if twice.isEmpty():
        return kept
    return kept.union(marked_rows(docs, twice, "left_semi").dropDuplicates())


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark (8) go.

    Rows are told apart by id and content: a leak goes whatever its id, other
    rows of that id stay. Null and empty texts stay. Empty tables stay empty;
    columns of any name come back as they are.
    """
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), mark=row_mark(docs))
    gone = settle(leaks.select(row_key().alias("key"), "mark").distinct(), "gone")
    return marked_rows(docs, gone, "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources (1) takes it.

    Texts without words are taken 0 times. Null sources are one source, equal
    rows are rows of their own, null ids rank by an empty key. Empty tables
    stay empty; columns of any name come back as they are.
    """
    return mixing.take_copies(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its slot and shard (5); columns of these two names are replaced.

    Null ids share one slot, equal ids too. Empty tables stay empty.
    """
    return sharding.place(docs, SHARDS)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("mixing sources", mixture), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)
        docs = after
    return docs

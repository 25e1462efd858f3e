"""A validated plan of document changes applied to a snapshot: relational rows by closure, search rows by stream, nothing lost silently."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .audit import renumber
from .shared import release, settle

#: Operations, kinds of documents, names of corpora and versions, the plan's keys, columns that are no extra fields.
OPERATIONS = ("replace", "delete")
KINDS = ("law", "decree", "rule", "case", "guide")
IDENTIFIER = re.compile(r"[A-Za-z0-9._-]{1,64}")
HEADER = {"schema", "parent_snapshot", "corpus", "version", "observed_at"}
SCHEMA = "change-plan-v1"
CORE = ("chunk_id", "doc_id", "chunk_index", "text", "metadata")
STREAM_OF = {"case": "cases", "guide": "guides"}

TEXTS = "map<string,string>"
CHUNKS = f"array<struct<chunk_id:string,text:string,metadata:{TEXTS}>>"
#: Changes as a table, one a document; streams of search rows; both of a snapshot.
CHANGE = f"operation string, document_id string, doc_type string, chunks {CHUNKS}, metadata map<string,{TEXTS}>, fields map<string,{TEXTS}>"
STREAM = f"stream string, position long, chunk_id string, doc_id string, doc_type string, text string, metadata {TEXTS}, fields {TEXTS}"


def check_header(header: dict, parent: dict | None = None) -> dict:
    """The plan's header; ValueError names what is wrong with it, also against the ``parent`` snapshot's corpus and version."""
    if set(header) != HEADER or header["schema"] != SCHEMA:
        raise ValueError("plan: wrong keys or schema")
    for name in ("corpus", "version"):
        if not isinstance(header[name], str) or not IDENTIFIER.fullmatch(header[name]):
            raise ValueError(f"{name}: use 1 to 64 letters, digits, dots, underscores and hyphens")
    if datetime.fromisoformat(header["observed_at"].replace("Z", "+00:00")).tzinfo is None:
        raise ValueError("observed_at needs a time zone")
    if parent and (parent["corpus"] != header["corpus"] or parent["version"] == header["version"]):
        raise ValueError("a plan makes a new version of its parent's corpus")
    return header


def _map(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.expr(f"cast(map() as {kind})"))


def plan_faults(changes: DataFrame) -> DataFrame:
    """``(document_id, fault)``: what is wrong with each change by itself or with its repetition; no rows for a good plan."""
    twice = F.count("*").over(Window.partitionBy("document_id")) > 1
    extra = F.col("chunks").isNotNull() | F.col("metadata").isNotNull() | F.col("fields").isNotNull()
    fault = (
        F.when(F.coalesce(F.col("document_id"), F.lit("")) == "", "a change needs a document id")
        .when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "the operation is neither replace nor delete")
        .when(~F.coalesce(F.col("doc_type").isin(*KINDS), F.lit(False)), "the kind of document is not known")
        .when(twice, "the document is changed twice")
        .when((F.col("operation") == "delete") & extra, "a delete carries no records, metadata or fields")
        .when((F.col("operation") == "replace") & (F.coalesce(F.size("chunks"), F.lit(0)) <= 0), "a replacement needs all records of the document")
    )
    return changes.select("document_id", fault.alias("fault")).where("fault is not null").distinct()


def _first_fault(faults: DataFrame) -> None:
    bad = faults.orderBy("document_id", "fault").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['document_id']}: {bad[0]['fault']}")


def _new_rows(changes: DataFrame) -> DataFrame:
    """Search rows that replacements bring: generated metadata with the plan's own, and the plan's fields."""
    rows = changes.where("operation = 'replace'").select("document_id", "doc_type", "metadata", "fields", F.posexplode("chunks").alias("place", "chunk"))
    own = F.coalesce(F.col("chunk.metadata"), F.expr(f"cast(map() as {TEXTS})"))
    given = F.coalesce(F.try_element_at(_map("metadata", f"map<string,{TEXTS}>"), F.col("chunk.chunk_id")), F.expr(f"cast(map() as {TEXTS})"))
    top = F.coalesce(F.try_element_at(_map("fields", f"map<string,{TEXTS}>"), F.col("chunk.chunk_id")), F.expr(f"cast(map() as {TEXTS})"))
    rows = rows.select("document_id", "doc_type", "place", "chunk.chunk_id", "chunk.text", own.alias("own"), given.alias("given"), top.alias("top"))
    added = F.map_filter("given", lambda k, v: ~F.map_contains_key(F.col("own"), k))
    clash = F.exists(F.map_keys("given"), lambda k: F.map_contains_key(F.col("own"), k) & ~F.try_element_at(F.col("own"), k).eqNullSafe(F.try_element_at(F.col("given"), k)))
    return rows.select("document_id", "doc_type", "place", "chunk_id", "text", F.map_concat(F.col("own"), added).alias("metadata"), F.col("top").alias("fields"), clash.alias("clash"))


def _lost(before: str, now: Column) -> Column:
    return F.array_sort(F.array_except(F.coalesce(F.col(before), F.array().cast("array<string>")), F.map_keys(now)))


def _prior(streams: DataFrame) -> DataFrame:
    """What a snapshot has of each document: kinds, streams, names of metadata and of extra fields."""
    names = lambda c: F.array_distinct(F.flatten(F.collect_set(F.map_keys(c))))
    return streams.groupBy(F.col("doc_id").alias("document_id")).agg(F.min("doc_type").alias("kind"), F.collect_set("stream").alias("streams"), names("metadata").alias("keys"), names("fields").alias("tops"))


def stream_faults(streams: DataFrame, changes: DataFrame, known: list[str]) -> DataFrame:
    """``(document_id, fault)``: why a change does not fit the snapshot; the first reason of each document."""
    prior = _prior(streams)
    named = changes.select("document_id", "operation", "doc_type", "metadata", "fields", "chunks").join(prior, "document_id", "left")
    ids = F.transform(F.coalesce("chunks", F.array().cast(CHUNKS)), lambda c: c["chunk_id"])
    stray = lambda c: F.size(F.array_except(F.map_keys(_map(c, f"map<string,{TEXTS}>")), ids)) > 0
    whole = (
        F.when(F.col("kind") != F.col("doc_type"), "the snapshot has the document as another kind")
        .when((F.col("operation") == "delete") & F.col("kind").isNull(), "the document to delete is not in the parent snapshot")
        .when((F.col("operation") == "replace") & stray("metadata"), "metadata is given for a chunk that the document does not have")
        .when((F.col("operation") == "replace") & stray("fields"), "fields are given for a chunk that the document does not have")
        .when((F.col("operation") == "replace") & (F.size("streams") > 1), "the document's stream is not clear")
        .when((F.col("operation") == "replace") & ~_stream(known).isin(*known), "the document's stream is not clear")
    )
    first = named.select("document_id", F.lit(0).alias("at"), F.lit("").alias("chunk_id"), whole.alias("fault"))
    rows = _new_rows(changes).join(prior.select("document_id", "keys", "tops"), "document_id", "left")
    keys, tops = _lost("keys", F.col("metadata")), _lost("tops", F.col("fields"))
    inner = (
        F.when(F.col("clash"), F.concat(F.lit("metadata made from the source can't be overwritten in "), "chunk_id"))
        .when(F.size(keys) > 0, F.concat(F.lit("give new values of metadata for "), "chunk_id", F.lit(": "), F.array_join(keys, ", ")))
        .when(F.exists(F.map_keys("fields"), lambda k: k.isin(*CORE)), F.concat(F.lit("fields have names of their own in "), "chunk_id"))
        .when(F.size(tops) > 0, F.concat(F.lit("give new values of fields for "), "chunk_id", F.lit(": "), F.array_join(tops, ", ")))
    )
    every = first.union(rows.select("document_id", F.lit(1).alias("at"), "chunk_id", inner.alias("fault"))).where("fault is not null")
    return every.groupBy("document_id").agg(F.min(F.struct("at", "chunk_id", "fault"))["fault"].alias("fault"))


def _stream(known: list[str]) -> Column:
    """The stream a document is in, else that of its kind; a snapshot of one stream takes all."""
    default = F.lit("laws")
    for kind, name in STREAM_OF.items():
        default = F.when(F.col("doc_type") == kind, name).otherwise(default)
    if len(known) == 1:
        default = F.lit(known[0])
    return F.when(F.coalesce(F.size("streams"), F.lit(0)) == 1, F.col("streams")[0]).otherwise(default)


def apply_to_streams(streams: DataFrame, changes: DataFrame, known: list[str]) -> DataFrame:
    """The snapshot's search rows after the plan, with new positions in each stream.

    Rows of changed documents go. A replacement's rows come behind its stream's
    others, by document and place. Metadata and fields that the document had must
    all be given again, and none that its source makes may be overwritten:
    ValueError names document and reason, and nothing is applied. Documents are
    joined by id; positions are counted in blocks, so no stream is one task.
    """
    _first_fault(plan_faults(changes))
    _first_fault(stream_faults(streams, changes, known))
    kept = streams.join(changes.select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")
    target = changes.where("operation = 'replace'").join(_prior(streams).select("document_id", "streams"), "document_id", "left").select("document_id", _stream(known).alias("stream"))
    made = _new_rows(changes).join(target, "document_id")
    new = made.select("stream", F.lit(None).cast("long").alias("position"), "chunk_id", F.col("document_id").alias("doc_id"), "doc_type", "text", "metadata", "fields", "place")
    old = kept.select("stream", "position", "chunk_id", "doc_id", "doc_type", "text", "metadata", "fields", F.lit(0).alias("place"))
    rows = old.unionByName(new).withColumn("late", F.col("position").isNull())
    return renumber(rows, "stream", ["late", "position", "doc_id", "place", "chunk_id"]).drop("place", "late")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes below ``roots`` (node) by ``edges`` (parent, child), roots included, each once; cycles end.

    A join a level; a level is written and keeps only what was not seen before.
    """
    level = settle(roots.select("node").where("node is not null").distinct(), "level")
    levels, seen = [level], level
    while not level.isEmpty():
        below = edges.join(level, F.col("parent") == F.col("node")).select(F.col("child").alias("node")).where("node is not null").distinct()
        level = settle(below.join(seen, "node", "left_anti"), "level")
        levels.append(level)
        seen = seen.union(level)
    out = settle(seen, "closure")
    release(*levels)
    return out


def replace_closure(nodes: DataFrame, edges: DataFrame, roots: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without all that hangs on ``roots``, and with the new ones.

    ``nodes`` has node and any columns, ``edges`` parent and child. Edges go with
    either end. New nodes may stand where old ones went, not beside them.
    ValueError if a node comes twice, or an edge has an end that no node is.
    """
    gone = closure(edges, roots)
    left = nodes.join(gone, "node", "left_anti").unionByName(new_nodes)
    below = edges.join(gone.withColumnRenamed("node", "child"), "child", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti")
    links = below.select("parent", "child").unionByName(new_edges.select("parent", "child"))
    twice = left.groupBy("node").count().where("count > 1").orderBy("node").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['node']}: the row is there already")
    ends = links.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    loose = ends.join(left, "node", "left_anti").orderBy("node").limit(1).collect()
    if loose:
        raise ValueError(f"{loose[0]['node']}: a row refers to it, but it is gone")
    return left, links


def replace_tables(tables: dict[str, DataFrame], keys: dict[str, str], refers: dict[str, dict[str, str]], roots: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``replace_closure`` of tables that refer to each other by key: each without all rows that hang on ``roots``, and with its ``new`` ones.

    ``tables`` has parents before children, ``keys`` the key column of those that
    have one, ``refers`` for each child its columns and the tables they refer to.
    ``roots`` has rows (by key) to begin with, ``new`` whole rows. New rows may
    stand where old ones went, not beside them: ValueError if a key comes twice.
    A row that stays and refers to none that stays fails the query. Tables that
    refer to themselves need ``replace_closure``.

    A table is shuffled once for each reference, with the columns that are read;
    one that others refer to is written once, with a mark on what goes.
    """
    marks: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for name, rows in tables.items():
        given = rows.withColumn("_gone", F.lit(False))
        if name in roots:
            own = roots[name].select(F.col(keys[name]).alias("_root")).distinct()
            given = given.join(own, F.col(keys[name]) == F.col("_root"), "left").withColumn("_gone", F.col("_root").isNotNull()).drop("_root")
        given = given.withColumn("_new", F.lit(False))
        if name in new:
            given = given.unionByName(new[name].select(*rows.columns, F.lit(False).alias("_gone"), F.lit(True).alias("_new")))
        for column, parent in refers.get(name, {}).items():
            given = given.join(marks[parent], F.col(column) == F.col("_key"), "left")
            hangs = ~F.col("_new") & F.coalesce("_goes", F.lit(False))
            fault = F.raise_error(F.concat(F.lit(f"{parent} "), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(f": a row of {name} refers to it, but it is gone"))).cast("boolean")
            gone = F.when(F.col("_gone") | hangs, True).when(F.coalesce("_stays", F.lit(False)), False).otherwise(fault)
            given = given.withColumn("_gone", gone).drop("_key", "_goes", "_stays")
        if name in keys:
            given = settle(given, name)
            twice = settle(given.where("not _gone").groupBy(keys[name]).count().where("count > 1"), "twice")
            first = twice.orderBy(keys[name]).limit(1).collect()
            release(twice)
            if first:
                raise ValueError(f"{name} {first[0][keys[name]]}: the row is there already")
            marks[name] = given.groupBy(F.col(keys[name]).alias("_key")).agg(F.bool_or("_gone").alias("_goes"), F.bool_or(~F.col("_gone")).alias("_stays"))
        out[name] = given.where("not _gone").drop("_gone", "_new")
    return out


def snapshot_changes(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A plan's changes as a table, from their JSON form."""
    return spark.createDataFrame([tuple(r.get(c) for c in ("operation", "document_id", "doc_type", "chunks", "metadata", "fields")) for r in rows], CHANGE)

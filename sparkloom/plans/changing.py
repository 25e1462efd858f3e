"""Queries: change plans over documents as a snapshot of search rows, and closure deletion over the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes
from ..session import table as t
from .registry import query

#: Four documents are one: a document has up to four chunks, its kind by its number, a stream by its kind; some have notes.
_DOC, _CHUNK = "concat('d', lpad(cast(doc_id div 4 as string), 12, '0'))", "concat('c', lpad(cast(doc_id as string), 12, '0'))"
_KIND = "element_at(array('law', 'case', 'guide'), cast(doc_id div 4 % 3 + 1 as int))"
_STREAM = "element_at(array('laws', 'cases', 'guides'), cast(doc_id div 4 % 3 + 1 as int))"


def snapshot(docs):
    meta = F.expr("map_filter(map('source', source, 'lang', lang, 'note', case when doc_id div 4 % 2 = 0 then 'kept' end), (k, v) -> v is not null)")
    fields = F.expr("case when doc_id div 4 % 5 = 0 then map('topic', source) else cast(map() as map<string,string>) end")
    rows = docs.where("doc_id is not null").select(F.expr(_STREAM).alias("stream"), F.col("doc_id").alias("position"), F.expr(_CHUNK).alias("chunk_id"), F.expr(_DOC).alias("doc_id"), F.expr(_KIND).alias("doc_type"), "text", meta.alias("metadata"), fields.alias("fields"))
    return rows


def plan_of(docs):
    """Of ten documents one is replaced by half of its chunks in reverse, one deleted; notes and topics are given again."""
    rows = docs.where("doc_id is not null and doc_id div 4 % 10 in (3, 6)").select("*", F.expr(_DOC).alias("document_id"), F.expr(_KIND).alias("doc_type"), F.expr("if(doc_id div 4 % 10 = 3, 'replace', 'delete')").alias("operation"))
    chunk = F.struct(F.expr(_CHUNK).alias("chunk_id"), F.concat("text", F.lit("!")).alias("text"), F.expr("map_filter(map('source', source, 'lang', lang), (k, v) -> v is not null)").alias("metadata"))
    own = F.when(F.expr("operation = 'replace' and doc_id % 2 = 0"), F.struct(F.col("doc_id"), chunk.alias("chunk")))
    listed = F.array_sort(F.collect_list(own), lambda a, b: F.signum(b["doc_id"] - a["doc_id"]).cast("int"))
    made = rows.groupBy("operation", "document_id", "doc_type").agg(listed.alias("own"), F.min(F.expr("doc_id div 4")).alias("nr"))
    ids = F.transform("own", lambda o: o["chunk"]["chunk_id"])
    note = F.expr("case when nr % 2 = 0 then map('note', 'new') end")
    topic = F.expr("case when nr % 5 = 0 then map('topic', 'new') end")
    replaces = F.col("operation") == "replace"

    def given(value):
        return F.when(replaces & value.isNotNull(), F.map_from_arrays(ids, F.transform(ids, lambda i: value)))

    return made.select("operation", "document_id", "doc_type", F.when(replaces, F.transform("own", lambda o: o["chunk"])).alias("chunks"), given(note).alias("metadata"), given(topic).alias("fields"))


@query(
    "mrg07_applied_changes",
    """with s as (select *, doc_id // 4 as nr, 'd' || lpad((doc_id // 4)::varchar, 12, '0') as did, 'c' || lpad(doc_id::varchar, 12, '0') as cid from documents where doc_id is not null),
r as (
  select nr, did, cid, md5(text) as h, source, lang, case when nr % 2 = 0 then 'kept' end as note, case when nr % 5 = 0 then source end as topic, 0 as late, doc_id as o from s where nr % 10 not in (3, 6)
  union all select nr, did, cid, md5(text || '!'), source, lang, case when nr % 2 = 0 then 'new' end, case when nr % 5 = 0 then 'new' end, 1, nr * 4 + 3 - doc_id % 4 from s where nr % 10 = 3 and doc_id % 2 = 0)
select ['laws', 'cases', 'guides'][(nr % 3 + 1)::int] as stream, row_number() over (partition by nr % 3 order by late, o) - 1 as position, cid as chunk_id, did as doc_id, ['law', 'case', 'guide'][(nr % 3 + 1)::int] as doc_type, h, source, lang, note, topic from r""",
)
def _(spark, sf):
    """A plan of replacements and deletions applied to all documents as search rows."""
    docs = t(spark, sf, "documents")
    after = changes.apply_to_streams(snapshot(docs), plan_of(docs), ["laws", "cases", "guides"])
    own = [F.try_element_at(F.col("metadata"), F.lit(k)).alias(k) for k in ("source", "lang", "note")]
    return after.select("stream", "position", "chunk_id", "doc_id", "doc_type", F.md5("text").alias("h"), *own, F.try_element_at(F.col("fields"), F.lit("topic")).alias("topic"))


@query(
    "mrg07_closure_replacement",
    """with gone as (select c_custkey from customer where c_custkey % 7 = 2),
o as (select o_orderkey, o_custkey from orders where o_custkey not in (from gone)),
l as (select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (from gone)))
select 'customer' as kind, count(*)::bigint as n_rows, sum(c_custkey)::bigint as key_sum from customer where c_custkey % 7 <> 2 or c_custkey % 2 = 0
union all select 'order', count(*)::bigint, sum(o_orderkey)::bigint from o union all select 'line', count(*)::bigint, sum(l_orderkey)::bigint from l""",
)
def _(spark, sf):
    """Of seven customers one goes with its orders and their lines; every other of those comes back alone."""
    tables = {"customer": t(spark, sf, "customer").select("c_custkey"), "order": t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "line": t(spark, sf, "lineitem").select("l_orderkey")}
    replaced = tables["customer"].where("c_custkey % 7 = 2")
    keys, refers = {"customer": "c_custkey", "order": "o_orderkey"}, {"order": {"o_custkey": "customer"}, "line": {"l_orderkey": "order"}}
    left = changes.replace_tables(tables, keys, refers, {"customer": replaced}, {"customer": replaced.where("c_custkey % 2 = 0")})
    counts = [rows.agg(F.count("*").alias("n_rows"), F.sum(rows.columns[0]).alias("key_sum")).select(F.lit(kind).alias("kind"), "n_rows", "key_sum") for kind, rows in left.items()]
    return reduce(DataFrame.union, counts)


@query(
    "mrg10_plan_faults",
    """select distinct case when doc_id % 11 = 0 then '' when doc_id % 11 = 6 and doc_id >= 11 then 'twice-' || doc_id % 3 else 'd' || doc_id end as document_id, case doc_id % 11 when 0 then 'a change needs a document id' when 1 then 'the operation is neither replace nor delete'
  when 2 then 'the kind of document is not known' when 3 then 'a delete carries no records, metadata or fields' when 4 then 'a replacement needs all records of the document' else 'the document is changed twice' end as fault
from documents where doc_id % 11 < 5 or (doc_id % 11 = 6 and doc_id >= 11)""",
)
def _(spark, sf):
    """A change for each document, of eleven kinds, six of them wrong."""
    kind = F.col("doc_id") % 11
    doc = F.when(kind == 0, "").when((kind == 6) & (F.col("doc_id") >= 11), F.concat(F.lit("twice-"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    operation = F.when(kind == 1, "move").when(kind.isin(3, 7), "delete").otherwise("replace")
    chunk = F.array(F.struct(F.lit("c").alias("chunk_id"), F.col("text").alias("text"), F.expr(f"cast(map() as {changes.TEXTS})").alias("metadata")))
    chunks = F.when(kind == 7, None).when(kind == 4, F.array().cast(changes.CHUNKS)).otherwise(chunk)
    none = F.lit(None).cast(f"map<string,{changes.TEXTS}>")
    plan = t(spark, sf, "documents").where("doc_id is not null").select(operation.alias("operation"), doc.alias("document_id"), F.when(kind == 2, "novel").otherwise("law").alias("doc_type"), chunks.alias("chunks"), none.alias("metadata"), none.alias("fields"))
    return changes.plan_faults(plan)

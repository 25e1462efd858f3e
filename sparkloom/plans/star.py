"""Queries whose shape is a join, an aggregate, an audit or a merge, on the star schema and the event and text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audit, merge
from ..operators.predicates import matches
from ..operators.shared import settle
from ..session import table as t
from .registry import query

# ---- joins ---------------------------------------------------------------------


@query("join01_five_way_export", """select l_orderkey, l_linenumber, c_name, n_name, r_name, coalesce(nullif(s_name, ''), c_name) as supplier
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
left join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey where l_returnflag = 'R'""")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    rows = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, F.expr("o_orderkey = l_orderkey")).join(c, F.expr("c_custkey = o_custkey"))
    rows = rows.join(t(spark, sf, "nation"), F.expr("n_nationkey = c_nationkey")).join(t(spark, sf, "region"), F.expr("r_regionkey = n_regionkey"))
    rows = rows.join(t(spark, sf, "supplier"), F.expr("s_suppkey = l_suppkey and s_nationkey = c_nationkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name", F.expr("coalesce(nullif(s_name, ''), c_name)").alias("supplier"))


@query("join02_three_way_ordered", "select c_custkey, c_name, n_name, c_acctbal from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' and c_acctbal > 0 order by c_acctbal desc, c_name, c_custkey")
def _(spark, sf):
    rows = t(spark, sf, "customer").where("c_acctbal > 0").join(t(spark, sf, "nation"), F.expr("n_nationkey = c_nationkey")).join(t(spark, sf, "region").where("r_name = 'ASIA'"), F.expr("r_regionkey = n_regionkey"))
    return rows.select("c_custkey", "c_name", "n_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_name", "c_custkey")


@query("join03_supplier_export", "select s_suppkey, s_name, n_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where s_acctbal >= 0")
def _(spark, sf):
    return t(spark, sf, "supplier").where("s_acctbal >= 0").join(t(spark, sf, "nation"), F.expr("n_nationkey = s_nationkey")).join(t(spark, sf, "region"), F.expr("r_regionkey = n_regionkey")).select("s_suppkey", "s_name", "n_name")


@query("join04_child_lists", "select o_orderkey, o_custkey, list((l_linenumber, l_partkey) order by l_linenumber, l_partkey)[1][2] as first_part, count(l_orderkey)::bigint as n_lines, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) as parts from orders left join lineitem on l_orderkey = o_orderkey group by all")
def _(spark, sf):
    kids = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("kids"))
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(kids, "o_orderkey", "left")
    return rows.select("o_orderkey", "o_custkey", F.col("kids")[0]["l_partkey"].alias("first_part"), F.coalesce(F.size("kids"), F.lit(0)).cast("long").alias("n_lines"), F.array_join(F.transform("kids", lambda k: k["l_partkey"].cast("string")), ",").alias("parts"))


@query("join05_composite_key", "select a.l_orderkey, a.l_linenumber, b.l_quantity from lineitem a join (select * from lineitem where l_shipdate < timestamp '1998-01-01') b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber")
def _(spark, sf):
    line = t(spark, sf, "lineitem")
    old = line.where("l_shipdate < timestamp '1998-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")
    return line.select("l_orderkey", "l_linenumber").join(old, ["l_orderkey", "l_linenumber"])


@query("join06_lineage", "select l_orderkey, l_linenumber, o_custkey, c_name, n_name, r_name from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey where l_partkey = 7")
def _(spark, sf):
    rows = t(spark, sf, "lineitem").where("l_partkey = 7").select("l_orderkey", "l_linenumber").join(t(spark, sf, "orders"), F.expr("o_orderkey = l_orderkey"), "left").join(t(spark, sf, "customer"), F.expr("c_custkey = o_custkey"), "left")
    return rows.join(t(spark, sf, "nation"), F.expr("n_nationkey = c_nationkey"), "left").join(t(spark, sf, "region"), F.expr("r_regionkey = n_regionkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "n_name", "r_name")


OLD = "old as (select doc_id, case when doc_id % 7 = 0 then text || '!' else text end as text, lang, source from documents where doc_id % 11 <> 0), new as (select doc_id, text, lang, source from documents where doc_id % 13 <> 0)"


def _old_new(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    old = docs.where("doc_id % 11 <> 0").withColumn("text", F.expr("case when doc_id % 7 = 0 then concat(text, '!') else text end"))
    return old, docs.where("doc_id % 13 <> 0")


@query("join07_reconcile", f"with {OLD} select coalesce(o.doc_id, n.doc_id) as doc_id, case when n.doc_id is null then 'missing' when o.doc_id is null then 'extra' else 'differs' end as state, case when o.doc_id is not null and n.doc_id is not null then 'text' else '' end as fields from old o full join new n on o.doc_id = n.doc_id where o.doc_id is null or n.doc_id is null or o.text is distinct from n.text")
def _(spark, sf):
    return audit.reconcile(*_old_new(spark, sf), "doc_id", ["text", "lang", "source"])


@query("join08_closure", "with recursive e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 1), r(id, depth) as (select 3::bigint, 0 union select e.child, r.depth + 1 from r join e on e.parent = r.id) select id, depth::bigint as depth from r")
def _(spark, sf):
    """Everything below key 3: a join a level, until a level has no key that was not seen before; so a cycle ends too."""
    edges = t(spark, sf, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    level = spark.range(1).select(F.lit(3).cast("long").alias("id"), F.lit(0).cast("long").alias("depth"))
    found = level
    while True:
        below = edges.join(level, F.col("parent") == F.col("id")).select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"))
        level = settle(below.dropDuplicates(["id"]).join(found.select("id"), "id", "left_anti"), "level")
        if level.isEmpty():
            return found
        found = found.union(level)


@query("join09_theta_self_join", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and floor(a.s_acctbal / 1000) = floor(b.s_acctbal / 1000) and a.s_suppkey <> b.s_suppkey")
def _(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("band"))
    a, b = s.select(F.col("s_suppkey").alias("a"), "s_nationkey", "band"), s.select(F.col("s_suppkey").alias("b"), "s_nationkey", "band")
    return a.join(b, ["s_nationkey", "band"]).where("a <> b").select("a", "b")


@query("join10_reference_graph", "with e as (select distinct l_suppkey as a, l_partkey % 100 as b from lineitem where l_partkey % 100 between 1 and 99 and exists (select 1 from supplier where s_suppkey = l_partkey % 100) and l_suppkey <> l_partkey % 100) select a, b from e union select b, a from e")
def _(spark, sf):
    ends = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("b"))
    edges = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).where("b between 1 and 99 and a <> b").distinct().join(ends, "b", "left_semi").select("a", "b")
    return edges.union(edges.select("b", "a")).distinct()


@query("join12_anti_either_key", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') and not exists (select 1 from supplier where s_name = replace(c_name, 'Customer', 'Supplier'))")
def _(spark, sf):
    """An anti-join on either of two keys as two anti-joins: an OR would be a nested loop."""
    c = t(spark, sf, "customer").withColumn("other", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")))
    return c.join(t(spark, sf, "orders").where("o_orderstatus = 'P'"), F.expr("o_custkey = c_custkey"), "left_anti").join(t(spark, sf, "supplier"), F.expr("s_name = other"), "left_anti").select("c_custkey")


@query("join15_missing_grouped", "select l.doc_id % 10 as bucket, count(distinct l.doc_id)::bigint as n, min(l.doc_id) as first_id from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and d.n_chars > 1000) group by 1")
def _(spark, sf):
    missing = t(spark, sf, "labels").join(t(spark, sf, "documents").where("n_chars > 1000"), "doc_id", "left_anti")
    return missing.groupBy((F.col("doc_id") % 10).alias("bucket")).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first_id"))


#: Pairs of a task, and suppliers that are sent to every task at once.
PAIRS, SENT = 16_000_000, 500_000


@query("join22_optional_key_match", "select a.c_custkey, b.s_suppkey from customer a join supplier b on lower(regexp_replace(a.c_mktsegment, '[^A-Za-z]', '', 'g')) <> '' and a.c_nationkey = b.s_nationkey and (b.s_acctbal < 0 or floor(a.c_acctbal / 1000) = floor(b.s_acctbal / 1000))")
def _(spark, sf):
    """Suppliers below zero meet all customers of their nation, others those of their band: joins on equality that make no pair but those of the result, in tasks of some million pairs."""
    a = t(spark, sf, "customer").where(F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")) != "").select("c_custkey", "c_nationkey", F.expr("floor(c_acctbal / 1000)").alias("c_band"))
    b = t(spark, sf, "supplier").where("s_acctbal is not null").select("s_suppkey", "s_nationkey", F.expr("floor(s_acctbal / 1000)").alias("s_band"), F.expr("s_acctbal < 0").alias("below"))
    fits = {True: F.expr("c_nationkey = s_nationkey"), False: F.expr("c_nationkey = s_nationkey and c_band = s_band")}
    sizes = a.groupBy("c_nationkey", "c_band").agg(F.count("*").alias("n")), b.groupBy("s_nationkey", "s_band", "below").agg(F.count("*").alias("m"))
    pairs = sizes[0].join(sizes[1], F.expr("c_nationkey = s_nationkey and (below or c_band = s_band)")).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    order = ["c_nationkey", "c_band", "c_custkey"]
    dealt = a.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((pairs or 0) / PAIRS) + 1), *order).sortWithinPartitions(*order)
    slices = 1 + b.count() // SENT
    part = F.pmod(F.xxhash64("s_suppkey"), F.lit(slices))
    found = [dealt.join(F.broadcast(b.where(F.col("below") == below).where(part == k)), on).select("c_custkey", "s_suppkey") for below, on in fits.items() for k in range(slices)]
    return reduce(DataFrame.union, found)


@query("join23_resolve_to_one", "select o_custkey % 50 as candidate, count(distinct o_orderkey)::bigint as n, case when count(distinct o_orderkey) = 1 then min(o_orderkey) end as resolved, case when count(distinct o_orderkey) = 1 then 'resolved' else 'many' end as state from orders where o_orderpriority = '1-URGENT' group by 1")
def _(spark, sf):
    n = F.count_distinct("o_orderkey")
    return t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy((F.col("o_custkey") % 50).alias("candidate")).agg(n.alias("n"), F.when(n == 1, F.min("o_orderkey")).alias("resolved"), F.when(n == 1, "resolved").otherwise("many").alias("state"))


@query("join24_k_of_n_identity", "select a.c_custkey, b.c_custkey as other from customer a join customer b on b.c_custkey = a.c_custkey + 1 where (a.c_nationkey = b.c_nationkey)::int + (a.c_mktsegment = b.c_mktsegment)::int + (sign(a.c_acctbal) = sign(b.c_acctbal))::int >= 2")
def _(spark, sf):
    a = t(spark, sf, "customer")
    b = a.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_custkey").alias("other"), *[F.col(c).alias(f"b_{c}") for c in ("c_nationkey", "c_mktsegment", "c_acctbal")])
    same = F.expr("cast(c_nationkey = b_c_nationkey as int) + cast(c_mktsegment = b_c_mktsegment as int) + cast(sign(c_acctbal) = sign(b_c_acctbal) as int)")
    return a.join(b, "c_custkey").where(same >= 2).select("c_custkey", "other")


@query("join25_subset_equality", "select (select count(*) from (select * from nation except all select * from (select * from nation where n_regionkey >= 0)))::bigint as left_over, (select count(*) from ((select * from nation where n_regionkey < 3) except all select * from nation))::bigint as right_over")
def _(spark, sf):
    n = t(spark, sf, "nation")
    a = n.exceptAll(n.where("n_regionkey >= 0")).agg(F.count("*").alias("left_over"))
    return a.crossJoin(n.where("n_regionkey < 3").exceptAll(n).agg(F.count("*").alias("right_over")))


@query("join26_orphans", "select count(*)::bigint as orphans from customer left join orders on o_custkey = c_custkey where o_custkey is null")
def _(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders"), F.expr("o_custkey = c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query("join27_align", "select l.doc_id, l.quality, row_number() over (order by coalesce(d.lang, ''), l.doc_id)::bigint - 1 as place from labels l join documents d using (doc_id)")
def _(spark, sf):
    """Labels in the order of a reference that has the same keys: their documents by language and id."""
    labels = t(spark, sf, "labels").select("doc_id", "quality")
    reference = t(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return audit.align(labels, reference, "doc_id", ["lang", "doc_id"])


@query("agg01_duplicates", "select l_partkey, l_suppkey, l_quantity, l_returnflag, count(*)::bigint as n from lineitem group by all having count(*) > 1")
def _(spark, sf):
    return audit.duplicates(t(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])


@query("agg02_uniqueness", "select 'documents' as name, (count(*) - count(distinct doc_id))::bigint as repeated, (count(*) - count(distinct (lang, source, text)))::bigint as repeated_text from documents union all select 'pages', (count(*) - count(distinct page_id))::bigint, (count(*) - count(distinct (url, html)))::bigint from pages")
def _(spark, sf):
    d, p = t(spark, sf, "documents"), t(spark, sf, "pages")
    a = d.agg((F.count("*") - F.count_distinct("doc_id")).alias("repeated"), (F.count("*") - F.count_distinct("lang", "source", "text")).alias("repeated_text")).select(F.lit("documents").alias("name"), "*")
    return a.union(p.agg(F.count("*") - F.count_distinct("page_id"), F.count("*") - F.count_distinct("url", "html")).select(F.lit("pages"), "*"))


@query("agg03_consistency", "select text, count(distinct source)::bigint + max((source is null)::int) as kinds from documents group by text having count(distinct source) + max((source is null)::int) > 1")
def _(spark, sf):
    return audit.inconsistent(t(spark, sf, "documents"), "text", "source")


RULES = [("empty_text", "trim(text) = ''"), ("short", "n_chars < 50"), ("unknown_language", "lang not in ('en', 'fr', 'de')"), ("source_shape", "source not like 'src1%'"), ("size_differs", "n_chars <> length(text)")]


@query("agg04_structure_rules", "select rule, count(*)::bigint as n, min(doc_id) as first_id from (" + " union all ".join(f"select '{n}' as rule, doc_id from documents where {e}" for n, e in RULES) + ") group by rule")
def _(spark, sf):
    found = F.array_compact(F.array(*[F.when(F.expr(e), n) for n, e in RULES]))
    return t(spark, sf, "documents").select("doc_id", F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("agg06_standard_error", "select event_type, round(sqrt(avg((value > 50)::int) * (1 - avg((value > 50)::int)) / count(*)), 6) as se from events group by 1")
def _(spark, sf):
    p = F.avg((F.col("value") > 50).cast("int"))
    return t(spark, sf, "events").groupBy("event_type").agg(F.round(F.sqrt(p * (1 - p) / F.count("*")), 6).alias("se"))


@query("agg13_agg14_latency", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as most, count_if(value > 50)::bigint as passed, count_if(value is null)::bigint as unseen from events group by 1")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("most"), F.count_if(F.col("value") > 50).alias("passed"), F.count_if(F.col("value").isNull()).alias("unseen"))


@query("agg15_status_matrix", "select o_orderpriority, count_if(o_orderstatus = 'O')::bigint as n_open, count_if(o_orderstatus = 'F')::bigint as n_done, round(avg((o_orderstatus = 'P')::int), 6) as partial_rate from orders group by 1")
def _(spark, sf):
    s = F.col("o_orderstatus")
    return t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "O").alias("n_open"), F.count_if(s == "F").alias("n_done"), F.round(F.avg((s == "P").cast("int")), 6).alias("partial_rate"))


@query("agg16_metric_map", "select event_type, k, round(avg(v), 6) as mean from (select event_type, unnest(['value', 'day']) as k, unnest([value, day(ts)::double]) as v from events) group by all")
def _(spark, sf):
    m = F.create_map(F.lit("value"), F.col("value"), F.lit("day"), F.dayofmonth("ts").cast("double"))
    return t(spark, sf, "events").select("event_type", F.explode(m).alias("k", "v")).groupBy("event_type", "k").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("agg17_agg18_rollup", "select l_returnflag, l_linestatus, k, count(*)::bigint as n, count_if(l_linenumber <= k)::bigint as hits, round(sum(case when l_linenumber <= k then 1.0::double / l_linenumber else 0 end), 4) as rr, round(count_if(l_linenumber <= k)::double / nullif(count_if(l_quantity > 10), 0), 6) as ratio from lineitem cross join (values (1), (3), (5)) c(k) group by all")
def _(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k"))
    hit = F.col("l_linenumber") <= F.col("k")
    return rows.groupBy("l_returnflag", "l_linestatus", "k").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.sum(F.when(hit, 1.0 / F.col("l_linenumber")).otherwise(0.0)), 4).alias("rr"), F.round(F.try_divide(F.count_if(hit).cast("double"), F.count_if(F.col("l_quantity") > 10)), 6).alias("ratio"))


@query("agg19_pivot", "select p_brand, count_if(l_returnflag = 'A')::bigint as a, count_if(l_returnflag = 'N')::bigint as n, count_if(l_returnflag = 'R')::bigint as r, count(*)::bigint as total, count(distinct l_orderkey)::bigint as orders from lineitem join part on p_partkey = l_partkey group by 1")
def _(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part").select("p_partkey", "p_brand"), F.expr("p_partkey = l_partkey"))
    flag = F.col("l_returnflag")
    return rows.groupBy("p_brand").agg(*[F.count_if(flag == x.upper()).alias(x) for x in "anr"], F.count("*").alias("total"), F.count_distinct("l_orderkey").alias("orders"))


@query("agg20_two_level_counts", "select l_returnflag, l_linestatus, count(*)::bigint as n from lineitem group by all")
def _(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("agg21_agg32_strata", "select o_orderpriority, n_lines, count(*)::bigint as n, bool_or(late) as any_late, bool_and(late) as all_late from (select o_orderkey, o_orderpriority, count(*)::bigint as n_lines, bool_or(l_shipdate > o_orderdate + interval 60 day) as late from orders join lineitem on l_orderkey = o_orderkey group by all) group by all")
def _(spark, sf):
    rows = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.expr("l_orderkey = o_orderkey"))
    per = rows.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("n_lines"), F.bool_or(F.expr("l_shipdate > o_orderdate + interval 60 day")).alias("late"))
    return per.groupBy("o_orderpriority", "n_lines").agg(F.count("*").alias("n"), F.bool_or("late").alias("any_late"), F.bool_and("late").alias("all_late"))


@query("agg26_reason_counts", "select split_part(m, ': ', -1) as reason, count(*)::bigint as n from (select 'row ' || coalesce(doc_id::varchar, '') || ': ' || coalesce(source, '') || ': ' || case when text is null then 'no text' when length(text) < 200 then 'short' when lang is null then 'no language' else 'taken as ' || lang end as m from documents) group by 1")
def _(spark, sf):
    """Messages of a scan, counted by the reason behind their last colon."""
    why = F.when(F.col("text").isNull(), "no text").when(F.length("text") < 200, "short").when(F.col("lang").isNull(), "no language").otherwise(F.concat(F.lit("taken as "), "lang"))
    message = F.concat(F.lit("row "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(": "), F.coalesce("source", F.lit("")), F.lit(": "), why)
    return t(spark, sf, "documents").groupBy(F.substring_index(message, ": ", -1).alias("reason")).agg(F.count("*").alias("n"))


def _digest_sql(name: str, cols: list[str]) -> str:
    parts = ", ".join(f"coalesce(strlen({c}::varchar) || '=' || {c}::varchar, '~')" for c in sorted(cols))
    words = ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::bigint)::varchar" for k in range(8))
    return f"select count(*)::bigint as n, sha256(concat_ws(',', {words})) as digest from (select sha256(concat({parts})) as h from {name})"


_DOCS = ["doc_id", "lang", "n_chars", "source", "text"]


@query("agg27_digest", _digest_sql("documents", _DOCS))
def _(spark, sf):
    return audit.digest(t(spark, sf, "documents"))


@query(
    "agg28_agg29_index_content_hash",
    """select count(*)::bigint as n, sha256(concat_ws(',', """
    + ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::bigint)::varchar" for k in range(8))
    + """)) as digest from (
  select sha256(strlen(r) || ':' || r || list_aggregate(list_transform(embedding, lambda c: printf('%.8e', c::double)), 'string_agg', ',')) as h
  from (select *, '[' || coalesce(vec_id::varchar, 'null') || ',' || coalesce(label::varchar, 'null') || ']' as r from embeddings))""",
)
def _(spark, sf):
    """All records and vectors of an index as one digest, after their dimension and values were checked."""
    rows = t(spark, sf, "embeddings").select(F.array("vec_id", "label").alias("record"), "embedding")
    return audit.index_hash(rows, F.to_json("record"), "embedding", 64)


@query("mrg11_verify_digests", "with a as (" + _digest_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus"]) + "), b as (" + _digest_sql("(select o_orderkey, o_custkey, case when o_orderkey = 1 then 'X' else o_orderstatus end as o_orderstatus from orders)", ["o_orderkey", "o_custkey", "o_orderstatus"]) + ") select 'same' as name, a.n, true as equal from a union all select 'changed', b.n, a.digest = b.digest from a, b")
def _(spark, sf):
    """A manifest of one digest against the table in another order, and against the table with one value changed."""
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    want = audit.digest(rows).first()["digest"]
    other = rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, "X").otherwise(F.col("o_orderstatus")))
    named = lambda df, name: audit.digest(df).select(F.lit(name).alias("name"), "n", (F.col("digest") == want).alias("equal"))
    return named(rows.repartition("o_custkey"), "same").union(named(other, "changed"))


@query("agg30_next_version", "select c_custkey, coalesce(max(year(o_orderdate)), 0)::bigint + 1 as next_version from customer left join orders on o_custkey = c_custkey group by 1")
def _(spark, sf):
    latest = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.year("o_orderdate")).alias("v"))
    return t(spark, sf, "customer").select("c_custkey").join(latest, "c_custkey", "left").select("c_custkey", (F.coalesce("v", F.lit(0)) + 1).cast("long").alias("next_version"))


@query("agg31_mrg15_fact_conflicts", "select user_id, event_type, count(distinct floor(value / 20))::bigint as kinds, case when count(distinct floor(value / 20)) > 1 then 'conflict' else 'active' end as state from events where user_id is not null group by all")
def _(spark, sf):
    kinds = F.count_distinct(F.floor(F.col("value") / 20))
    return t(spark, sf, "events").where("user_id is not null").groupBy("user_id", "event_type").agg(kinds.alias("kinds"), F.when(kinds > 1, "conflict").otherwise("active").alias("state"))


@query("agg35_agg37_gates", "select event_type, round(count_if(value > 20)::double / count(*), 6) as rate, count_if(value > 20)::double / count(*) >= 0.5 as rate_ok, quantile_cont(value, 0.95) <= 300 as p95_ok from events group by 1")
def _(spark, sf):
    rate = F.count_if(F.col("value") > 20) / F.count("*")
    return t(spark, sf, "events").groupBy("event_type").agg(F.round(rate, 6).alias("rate"), (rate >= 0.5).alias("rate_ok"), (F.percentile("value", 0.95) <= 300).alias("p95_ok"))


@query("agg36_transitions", "with p as (select doc_id, quality = 1 as a, toxic = 1 as b from labels) select doc_id % 5 as mode, count_if(not a and b)::bigint as up, count_if(a and not b)::bigint as down, (count_if(not a and b) - count_if(a and not b))::bigint as net from p group by 1")
def _(spark, sf):
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return t(spark, sf, "labels").groupBy((F.col("doc_id") % 5).alias("mode")).agg(F.count_if(~a & b).alias("up"), F.count_if(a & ~b).alias("down"), (F.count_if(~a & b) - F.count_if(a & ~b)).alias("net"))


# ---- filters and projections ---------------------------------------------------


@query("flt01_metadata_predicate", "select doc_id from documents where lang is not distinct from 'en' and not coalesce(source in ('src1', 'src2'), false) and (n_chars is distinct from 10 or coalesce(source in ('src3'), false))")
def _(spark, sf):
    where = {"$and": [{"lang": "en"}, {"source": {"$nin": ["src1", "src2"]}}, {"$or": [{"n_chars": {"$ne": 10}}, {"source": {"$in": ["src3"]}}]}]}
    return t(spark, sf, "documents").where(matches(where)).select("doc_id")


@query("flt02_corpus_filter", "select doc_id, source from documents where lang in ('en', 'de') and not coalesce(source in ('src4'), false)")
def _(spark, sf):
    return t(spark, sf, "documents").where(matches({"$and": [{"lang": {"$in": ["en", "de"]}}, {"source": {"$nin": ["src4"]}}]})).select("doc_id", "source")


def _exclusions(spark, sf, word, sources):
    """Each question with each document, and whether the document leaves its pool: all of ``sources`` do unless the question has ``word``; a null source stays."""
    asked = t(spark, sf, "benchmark").select("item_id", F.coalesce(F.contains("text", F.lit(word)), F.lit(False)).alias("asked"))
    out = t(spark, sf, "documents").select("doc_id", F.coalesce(F.col("source").isin(sources), F.lit(False)).alias("out"))
    return out.crossJoin(asked).select("item_id", "doc_id", (~F.col("asked") & F.col("out")).alias("excluded"))


_EXCLUSIONS = "select item_id, doc_id, not coalesce(contains(q, '{}'), false) and coalesce(source in ({}), false) as excluded from (select item_id, text as q from benchmark), documents"


@query("flt03_query_dependent_exclusion", _EXCLUSIONS.format("the", "'src1', 'src5'"))
def _(spark, sf):
    """Two sources leave the whole pool of a question unless it has the word that asks for them."""
    return _exclusions(spark, sf, "the", ["src1", "src5"])


@query("flt04_any_word", "select doc_id from documents where contains(text, 'idiot') or contains(text, 'License')")
def _(spark, sf):
    return t(spark, sf, "documents").where(F.exists(F.array(F.lit("idiot"), F.lit("License")), lambda w: F.contains(F.col("text"), w))).select("doc_id")


@query("flt06_regex_predicate", "select doc_id from documents where regexp_matches(text, '[0-9]{3}\\.[0-9]{1,3}\\.')")
def _(spark, sf):
    return t(spark, sf, "documents").where(F.rlike("text", F.lit(r"[0-9]{3}\.[0-9]{1,3}\."))).select("doc_id")


@query("flt07_guarded_exclusion", _EXCLUSIONS.format("of", "'src2'"))
def _(spark, sf):
    """One source leaves the whole pool of each question that the guard does not let through."""
    return _exclusions(spark, sf, "of", ["src2"])


@query("flt08_split_by_type", "select coalesce(lang, 'none') as kind, count(*)::bigint as n, sum(n_chars)::bigint as chars from documents group by 1")
def _(spark, sf):
    return t(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("flt09_filter_counts", "select count(*)::bigint as n_in, count_if(lang = 'en')::bigint as n_out, count_if(lang is distinct from 'en')::bigint as dropped from documents")
def _(spark, sf):
    keep = F.col("lang").eqNullSafe("en")
    return t(spark, sf, "documents").agg(F.count("*").alias("n_in"), F.count_if(keep).alias("n_out"), F.count_if(~keep).alias("dropped"))


@query("flt10_rul19_scope_decision", "select doc_id, case when contains(text, 'idiot') then 'exclude' when regexp_matches(text, '(?i)license') then 'include' when n_chars < 200 then 'review' else 'include' end as decision, case when contains(text, 'idiot') then 'word' when regexp_matches(text, '(?i)license') then 'mark' when n_chars < 200 then 'short' else 'default' end as reason from documents")
def _(spark, sf):
    bad, good, short = F.contains("text", F.lit("idiot")), F.rlike("text", F.lit("(?i)license")), F.col("n_chars") < 200
    pick = lambda a, b, c, d: F.when(bad, a).when(good, b).when(short, c).otherwise(d)
    return t(spark, sf, "documents").select("doc_id", pick("exclude", "include", "review", "include").alias("decision"), pick("word", "mark", "short", "default").alias("reason"))


@query("flt12_present_gold_only", "select bucket, list(doc_id order by doc_id) as gold from (select l.doc_id % 20 as bucket, l.doc_id from labels l join documents d using (doc_id) where d.lang = 'en') group by bucket")
def _(spark, sf):
    there = t(spark, sf, "labels").join(t(spark, sf, "documents").where("lang = 'en'"), "doc_id", "left_semi")
    return there.groupBy((F.col("doc_id") % 20).alias("bucket")).agg(F.array_sort(F.collect_list("doc_id")).alias("gold"))


@query("prj02_citation", "select doc_id, case lang when 'en' then source || ' no. ' || doc_id when 'de' then 'Nr. ' || doc_id || ' ' || source else source end as citation from documents")
def _(spark, sf):
    lang, i = F.col("lang"), F.col("doc_id").cast("string")
    return t(spark, sf, "documents").select("doc_id", F.when(lang == "en", F.concat("source", F.lit(" no. "), i)).when(lang == "de", F.concat(F.lit("Nr. "), i, F.lit(" "), "source")).otherwise(F.col("source")).alias("citation"))


@query("prj03_clean_metadata", "select doc_id, coalesce(lang, '') || '|' || coalesce(source, '') as joined, coalesce(n_chars::varchar, '') as size from documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), "|").alias("joined"), F.coalesce(F.col("n_chars").cast("string"), F.lit("")).alias("size"))


@query("prj05_record_from_json", "select event_id, coalesce(json_extract_string(props, '$.k'), '') as k, event_type from events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), "event_type")


@query("prj06_prj07_prj08_chunk_fields", "select doc_id, '[' || source || ' | ' || lang || '] ' || trim(text) as body, regexp_replace(source || '-' || lang || '-' || doc_id, '\\s+', '', 'g') as chunk_id, greatest(1, length(text) // 2)::bigint as tokens from documents")
def _(spark, sf):
    from ..functions.text import token_estimate

    return t(spark, sf, "documents").select("doc_id", F.concat(F.lit("["), "source", F.lit(" | "), "lang", F.lit("] "), F.trim("text")).alias("body"), F.regexp_replace(F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string")), r"\s+", "").alias("chunk_id"), token_estimate(F.col("text")).alias("tokens"))


# ---- merges --------------------------------------------------------------------


@query("mrg01_snk07_scoped_merge", f"with {OLD}, inp as (select * from new where lang in ('en', 'fr')) select doc_id, lang, md5(text) as h from inp union all select doc_id, lang, md5(text) from old where doc_id not in (select doc_id from inp) and lang not in (select lang from inp)")
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return merge.scoped_merge(old, new.where("lang in ('en', 'fr')"), "doc_id", "lang").select("doc_id", "lang", F.md5("text").alias("h"))


@query("mrg02_mrg03_sync_counts", f"with {OLD} select state, count(*)::bigint as n from (select case when n.doc_id is null then 'remove' when o.doc_id is null or o.text is distinct from n.text then 'embed' else 'reuse' end as state from old o full join new n on o.doc_id = n.doc_id) group by 1")
def _(spark, sf):
    return merge.sync_states(*_old_new(spark, sf), "doc_id", "text").groupBy("state").agg(F.count("*").alias("n"))


@query("mrg04_sequence_numbers", "select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as seq from lineitem")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("seq"))


@query("mrg08_version_history", "select user_id, sha256(event_type) as checksum, min(ts) as first_seen, max(ts) as last_seen, count(*)::bigint as sights from events group by user_id, event_type")
def _(spark, sf):
    return merge.version_history(t(spark, sf, "events"), "user_id", "event_type", "ts")


@query("mrg14_change_alerts", "select event_id, user_id, before, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) where before is not null and before <> event_type")
def _(spark, sf):
    return merge.changes(t(spark, sf, "events"), "user_id", "event_type", "event_id").select("event_id", "user_id", "before", "event_type")


@query("mrg16_mrg17_checklist_sync", "with c as (select p_partkey as code, case p_size % 3 when 0 then 'todo' when 1 then 'done' else 'dismissed' end as state from part where p_partkey % 2 = 0), w as (select p_partkey as code from part where p_partkey % 3 = 0) select coalesce(c.code, w.code) as code, case when c.state is null then 'todo' when c.state = 'done' then 'done' when w.code is not null then 'todo' else 'dismissed' end as state from c full join w on c.code = w.code")
def _(spark, sf):
    p = t(spark, sf, "part").withColumn("code", F.col("p_partkey"))
    state = F.when(F.col("p_size") % 3 == 0, "todo").when(F.col("p_size") % 3 == 1, "done").otherwise("dismissed")
    return merge.checklist_sync(p.where("p_partkey % 2 = 0").select("code", state.alias("state")), p.where("p_partkey % 3 = 0"), "code")


@query("mrg19_resume_checkpoint", "select user_id, event_type, arg_max(value, event_id) as last_value, max(event_id) as last_id from events group by all")
def _(spark, sf):
    """The last row of each key in each version of the code (event_type); a resumed run takes those of its own version."""
    return t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("last_value"), F.max("event_id").alias("last_id"))


@query("mrg20_reconcile_readings", "select user_id, case when count(distinct floor(value / 50)) = 1 and count(distinct event_type) >= 2 then 'confirmed' else 'review' end as state from events group by 1")
def _(spark, sf):
    ok = (F.count_distinct(F.floor(F.col("value") / 50)) == 1) & (F.count_distinct("event_type") >= 2)
    return t(spark, sf, "events").groupBy("user_id").agg(F.when(ok, "confirmed").otherwise("review").alias("state"))


@query("rnk24_first_per_rule", "select l_returnflag, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber) as r from lineitem) where r = 1")
def _(spark, sf):
    first = F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("f")
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(first).select("l_returnflag", "f.l_orderkey", "f.l_linenumber")


@query("rnk30_latest_match", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_totalprice)) as latest from orders where o_orderstatus = 'O' group by 1")
def _(spark, sf):
    return t(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_totalprice")).alias("latest"))


@query("rnk23_first_pages", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn, role) as r from conversations) where r <= 4")
def _(spark, sf):
    """The first four pages of every session (turns of a conversation), by page and then by id."""
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return t(spark, sf, "conversations").withColumn("r", first).where("r <= 4").select("conv_id", "turn", "role")


@query("rnk25_parse_and_dedupe", "with g as (select source, lang, count(distinct n_chars % 3) as kinds, max((doc_id, n_chars)) as best from documents group by all) select source, lang, kinds::bigint as kinds, best[1] as doc_id from g")
def _(spark, sf):
    g = t(spark, sf, "documents").groupBy("source", "lang").agg(F.count_distinct(F.col("n_chars") % 3).alias("kinds"), F.max(F.struct("doc_id", "n_chars")).alias("best"))
    return g.select("source", "lang", "kinds", F.col("best.doc_id").alias("doc_id"))

"""Queries: evaluation reports, sectioning of lines, stitched windows, rule tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import table as t
from .registry import query
from .retrieval import BM25, GOLD, LEXICAL, bm25_ranked, corpus_of, gold_lists
from .texts import LINES

TOP = f"{LEXICAL}, {BM25.format(n='a', k1=1.5, b=0.75, k=20)}"


@query("str05_sections", f"""with l as (select page_id, unnest({LINES}) as line, generate_subscripts({LINES}, 1) as pos from pages),
s as (select *, sum((length(line) < 40)::int) over (partition by page_id order by pos) as section from l)
select page_id, section::bigint as section, count(*)::bigint as n_lines, arg_min(line, pos) as head from s group by all""")
def _(spark, sf):
    rows = t(spark, sf, "pages").select("page_id", F.posexplode(tx.html_lines(F.col("html"))).alias("pos", "line"))
    section = F.sum((F.length("line") < 40).cast("int")).over(Window.partitionBy("page_id").orderBy("pos"))
    return rows.withColumn("section", section).groupBy("page_id", "section").agg(F.count("*").alias("n_lines"), F.min_by("line", "pos").alias("head"))


@query("str24_status_by_severity", "select source, case when bool_or(contains(text, 'idiot')) then 'high' when bool_or(n_chars < 100) then 'medium' else 'none' end as status from documents group by 1")
def _(spark, sf):
    status = F.when(F.bool_or(F.contains("text", F.lit("idiot"))), "high").when(F.bool_or(F.col("n_chars") < 100), "medium").otherwise("none")
    return t(spark, sf, "documents").groupBy("source").agg(status.alias("status"))


@query("str19_spaced_keyword", r"select doc_id, substr(text, greatest(1, instr(text, 'License') - 10), 30) as evidence from documents where regexp_matches(text, 'L\s*i\s*c\s*e\s*n\s*s\s*e')")
def _(spark, sf):
    at = F.greatest(F.lit(1), F.instr("text", "License") - 10)
    return t(spark, sf, "documents").where(F.rlike("text", F.lit(r"\s*".join("License")))).select("doc_id", F.substring(F.col("text"), at, F.lit(30)).alias("evidence"))


@query("txt30_whole_windows")
def _(spark, sf):
    """Windows of a fixed stride within one row, over all documents; no text is no window, a null text gives null."""
    docs = t(spark, sf, "documents")
    n = F.greatest(F.lit(1), F.ceil((F.coalesce(F.length("text"), F.lit(0)) - 20) / 60.0).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 60 + 1, F.lit(80)))
    own = F.transform(windows, lambda w, i: F.when(i == 0, w).otherwise(F.substring(w, F.lit(21), F.lit(80))))
    return docs.select("doc_id", (F.array_join(own, "") == F.col("text")).alias("equal"))


@query("txt26_txt22_body_intents", "select doc_id, list_concat(case when contains(text, 'the') and contains(text, 'of') then ['a'] else [] end, case when regexp_matches(text, '[0-9]{4}') then ['b'] else [] end) as intents from documents")
def _(spark, sf):
    has = lambda w: F.contains("text", F.lit(w))
    rules = F.array(F.when(has("the") & has("of"), "a"), F.when(F.rlike("text", F.lit("[0-9]{4}")), "b"))
    return t(spark, sf, "documents").select("doc_id", F.array_compact(rules).alias("intents"))


@query("agg08_agg10_first_gold_rank", f"""with {TOP}, {GOLD}, g as (select qid, unnest(gold) as id from gold),
r as (select g.qid, min(a.rank) as rank from g left join a_r a on a.qid = g.qid and a.id = g.id group by 1)
select count(*)::bigint as n, count_if(rank <= 1)::bigint as hit1, count_if(rank <= 3)::bigint as hit3, count_if(rank <= 5)::bigint as hit5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr from r""")
def _(spark, sf):
    corpus = corpus_of(spark, sf)
    g = gold_lists(spark, sf, corpus).select("qid", F.explode("gold").alias("id"))
    r = g.join(bm25_ranked(spark, sf, 20, corpus=corpus).select("qid", "id", "rank"), ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return r.agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in (1, 3, 5)], F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query("agg11_gold_ranks_map", f"""with {TOP}, {GOLD}, g as (select qid, unnest(gold) as id from gold)
select g.qid, string_agg(g.id || ':' || coalesce(a.rank::varchar, '-'), ',' order by g.id) as ranks from g left join a_r a on a.qid = g.qid and a.id = g.id group by 1""")
def _(spark, sf):
    corpus = corpus_of(spark, sf)
    g = gold_lists(spark, sf, corpus).select("qid", F.explode("gold").alias("id"))
    rows = g.join(bm25_ranked(spark, sf, 20, corpus=corpus).select("qid", "id", "rank"), ["qid", "id"], "left")
    one = F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce(F.col("rank").cast("string"), F.lit("-")))
    listed = F.array_sort(F.collect_list(F.struct("id", one.alias("one"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(listed, lambda s: s["one"]), ",").alias("ranks"))


@query("set14_set15_target_state", f"""with {TOP}, {GOLD}, r as (select qid, list(id order by rank) as got from a_r where rank <= 5 group by qid)
select g.qid, len(list_intersect(g.gold, coalesce(r.got, [])))::bigint as hits, list_sort(list_filter(g.gold, lambda x: not list_contains(coalesce(r.got, []), x))) as missing,
case when len(list_intersect(g.gold, coalesce(r.got, []))) = 0 then 'zero' when len(list_intersect(g.gold, coalesce(r.got, []))) = len(g.gold) then 'complete' else 'partial' end as shape from gold g left join r using (qid)""")
def _(spark, sf):
    corpus = corpus_of(spark, sf)
    got = bm25_ranked(spark, sf, 20, corpus=corpus).where("rank <= 5").groupBy("qid").agg(F.collect_set("id").alias("got"))
    rows = gold_lists(spark, sf, corpus).join(got, "qid", "left").withColumn("got", F.coalesce("got", F.array().cast("array<bigint>")))
    hits = F.size(F.array_intersect("gold", "got"))
    shape = F.when(hits == 0, "zero").when(hits == F.size("gold"), "complete").otherwise("partial")
    return rows.select("qid", hits.cast("long").alias("hits"), F.array_sort(F.array_except("gold", "got")).alias("missing"), shape.alias("shape"))


@query("agg22_agg34_before_after", "with p as (select o_custkey % 8 as grp, o_orderkey, o_totalprice > 150000 as before, o_orderstatus = 'F' as after from orders) select grp, count_if(before)::bigint as complete_before, count_if(after)::bigint as complete_after, count_if(before and not after)::bigint as losses, count_if(after and not before)::bigint as gains from p group by 1")
def _(spark, sf):
    a, b = F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F"
    return t(spark, sf, "orders").groupBy((F.col("o_custkey") % 8).alias("grp")).agg(F.count_if(a).alias("complete_before"), F.count_if(b).alias("complete_after"), F.count_if(a & ~b).alias("losses"), F.count_if(b & ~a).alias("gains"))


@query("join19_paired_impact", "with m as (select user_id, max(value) filter (event_type = 'click') as a, max(value) filter (event_type = 'view') as b from events group by 1) select case when a is null and b is null then 'neither' when a is null then 'only view' when b is null then 'only click' else 'both' end as category, sign(coalesce(a, 0) - coalesce(b, 0))::int as direction, count(*)::bigint as n from m group by all")
def _(spark, sf):
    m = t(spark, sf, "events").groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == e, F.col("value"))).alias(e) for e in ("click", "view")])
    a, b = F.col("click"), F.col("view")
    category = F.when(a.isNull() & b.isNull(), "neither").when(a.isNull(), "only view").when(b.isNull(), "only click").otherwise("both")
    return m.groupBy(category.alias("category"), F.signum(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))).cast("int").alias("direction")).agg(F.count("*").alias("n"))


@query("join21_carry_forward", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def _(spark, sf):
    kept = t(spark, sf, "orders").join(t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), F.expr("c_custkey = o_custkey"), "left_semi")
    return kept.join(t(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.expr("l_orderkey = o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("agg38_semantic_equality", "select a.doc_id, coalesce(md5(a.text) = md5(b.text), false) as equal from documents a left join documents b on b.doc_id = a.doc_id + 1 and b.lang <> 'es'")
def _(spark, sf):
    d = t(spark, sf, "documents")
    b = d.where("lang <> 'es'").select((F.col("doc_id") - 1).alias("doc_id"), F.md5("text").alias("other"))
    return d.select("doc_id", F.md5("text").alias("own")).join(b, "doc_id", "left").select("doc_id", F.coalesce(F.col("own") == F.col("other"), F.lit(False)).alias("equal"))

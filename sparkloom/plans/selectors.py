"""Queries: selectors on ranked lists, paired reports, sweeps, and the JSON round trip."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import lexical, selection
from ..operators.shared import shared_folder
from ..session import table as t
from ..sources import jsonl
from .registry import query
from .retrieval import BM25, GOLD, LEXICAL, asked, bm25_pair, bm25_ranked, corpus_of, gold_lists

TOP = f"{LEXICAL}, {BM25.format(n='a', k1=1.5, b=0.75, k=20)}, {BM25.format(n='c', k1=1.5, b=0.25, k=20)}"


def _facts(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")


@query("rnk04_exact_fusion", f"""with {TOP}, f as (
  select coalesce(a.qid, c.qid) as qid, coalesce(a.id, c.id) as id, a.rank as r, c.rank as s from a_r a full join c_r c on a.qid = c.qid and a.id = c.id),
g as (select *, ((case when r is not null then coalesce(s, 1000000) + 5 else 0 end + case when s is not null then (coalesce(r, 1000000) + 5) * 2 else 0 end)::double / ((coalesce(r, 1000000) + 5) * (coalesce(s, 1000000) + 5))::double) as score from f)
select qid, id, place from (select *, row_number() over (partition by qid order by round(score, 12) desc, coalesce(r, 1000000), id) as place from g) where place <= 5""")
def _(spark, sf):
    out = selection.exact_fusion(*bm25_pair(spark, sf), 2, 5, 5)
    return out.select("qid", "id", F.col("place").cast("long").alias("place"))


@query("rnk07_level", "select doc_id, case when source = 'src1' then 0 when source like '%1%' then 1 when source like '%2%' or source like '%3%' then 2 else 3 end as level from documents")
def _(spark, sf):
    s = F.col("source")
    return t(spark, sf, "documents").select("doc_id", F.when(s == "src1", 0).when(s.contains("1"), 1).when(s.contains("2") | s.contains("3"), 2).otherwise(3).alias("level"))


@query("rnk09_rnk17_replace_third", f"""with {TOP}, seed as (select qid, id, rank as place from a_r where rank <= 2),
o as (select c.qid, c.id, row_number() over (partition by c.qid order by c.rank, c.id) as r from c_r c where not exists (select 1 from seed s where s.qid = c.qid and s.id = c.id))
select qid, id, place from seed union all select qid, id, 3 from o where r = 1""")
def _(spark, sf):
    return selection.replace_third(*bm25_pair(spark, sf))


@query("rnk15_rnk16_linked_pair", f"""with {TOP}, h as (select a_r.*, d.source from a_r join documents d on d.doc_id = id where rank <= 10),
p as (select x.qid, x.id as a, y.id as b, greatest(x.rank, y.rank) as worse, x.rank + y.rank as total from h x join h y on x.qid = y.qid and x.source = y.source and x.rank < y.rank and x.rank <= 3)
select qid, a, b from (select *, row_number() over (partition by qid order by worse, total, a, b) as r from p) where r = 1""")
def _(spark, sf):
    hits = bm25_ranked(spark, sf, 20).where("rank <= 10").join(_facts(spark, sf).select("id", "source"), "id")
    # links among the ranked documents of one query only: at most ten a query
    a, b = hits.select("qid", "source", F.col("id").alias("a")), hits.select("qid", "source", F.col("id").alias("b"))
    links = a.join(b, ["qid", "source"]).where("a <> b").select("a", "b").distinct()
    return selection.best_linked_pair(hits, links)


@query("rnk18_reserved_intents", f"""with {TOP}, h as (select a_r.*, d.lang as intent from a_r join documents d on d.doc_id = id),
m as (select *, intent in ('de', 'fr') and row_number() over (partition by qid, intent order by rank) = 1 as kept from h),
ch as (select * from (select *, row_number() over (partition by qid order by kept desc, rank) as place from m) where place <= 4)
select qid, id, kept, row_number() over (partition by qid order by rank) as out from ch""")
def _(spark, sf):
    hits = bm25_ranked(spark, sf, 20).join(_facts(spark, sf).select("id", F.col("lang").alias("intent")), "id")
    wanted = t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array(F.lit("de"), F.lit("fr"))).alias("intent"))
    return selection.reserve_by_intent(hits, wanted, 4).select("qid", "id", "kept", F.col("out").cast("long").alias("out"))


@query("rnk11_rnk12_second_adds", f"""with {TOP}, h as (select a_r.qid, a_r.rank, a_r.id, d.text from a_r join documents d on d.doc_id = id where rank <= 2),
w as (select item_id as qid, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) >= 6)) as stems from benchmark)
select w.qid, x.id as first_id, case when len(list_filter(stems, lambda s: contains(lower(y.text), s) and not contains(lower(x.text), s))) > 0 then y.id end as second_id
from w join h x on x.qid = w.qid and x.rank = 1 left join h y on y.qid = w.qid and y.rank = 2""")
def _(spark, sf):
    hits = bm25_ranked(spark, sf, 20).where("rank <= 2").select("qid", "rank", "id").join(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), "id")
    stems = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) >= 6))
    asks = t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), stems.alias("stems"))
    x = hits.where("rank = 1").select("qid", F.col("id").alias("first_id"), F.col("text").alias("x"))
    y = hits.where("rank = 2").select("qid", F.col("id").alias("other"), F.col("text").alias("y"))
    adds = F.exists("stems", lambda s: F.contains(F.col("y"), s) & ~F.contains(F.col("x"), s))
    return asks.join(x, "qid").join(y, "qid", "left").select("qid", "first_id", F.when(adds, F.col("other")).alias("second_id"))


@query("rnk26_parents_once", f"""with {TOP}, p as (select qid, d.source as parent, min(rank) as rank from a_r join documents d on d.doc_id = id group by all)
select qid, parent, row_number() over (partition by qid order by rank) as place from p""")
def _(spark, sf):
    p = bm25_ranked(spark, sf, 20).join(_facts(spark, sf), "id").groupBy("qid", F.col("source").alias("parent")).agg(F.min("rank").alias("rank"))
    return p.select("qid", "parent", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long").alias("place"))


@query("rnk27_uncited_labels", f"""with {TOP}, p as (select qid, d.source as label, min(rank) as rank from a_r join documents d on d.doc_id = id where d.source not in ('src1', 'src2') group by all)
select qid, label, place from (select *, row_number() over (partition by qid order by rank) as place from p) where place <= 3""")
def _(spark, sf):
    p = bm25_ranked(spark, sf, 20).join(_facts(spark, sf).where("source not in ('src1', 'src2')"), "id").groupBy("qid", F.col("source").alias("label")).agg(F.min("rank").alias("rank"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long")).where("place <= 3").select("qid", "label", "place")


@query("rul20_lost_stage", f"""with {TOP}, {GOLD}, g as (select qid, unnest(gold) as id from gold)
select g.qid, g.id, case when a.rank <= 3 then 'found' when a.rank is not null then 'selection' when c.rank is not null then 'fusion' else 'candidates' end as stage, a.rank as rank_a, c.rank as rank_c
from g left join a_r a on a.qid = g.qid and a.id = g.id left join c_r c on c.qid = g.qid and c.id = g.id""")
def _(spark, sf):
    corpus = corpus_of(spark, sf)
    g = gold_lists(spark, sf, corpus).select("qid", F.explode("gold").alias("id"))
    a, c = bm25_pair(spark, sf, corpus=corpus)
    a = a.select("qid", "id", F.col("rank").cast("long").alias("rank_a"))
    c = c.select("qid", "id", F.col("rank").cast("long").alias("rank_c"))
    stage = F.when(F.col("rank_a") <= 3, "found").when(F.col("rank_a").isNotNull(), "selection").when(F.col("rank_c").isNotNull(), "fusion").otherwise("candidates")
    return g.join(a, ["qid", "id"], "left").join(c, ["qid", "id"], "left").select("qid", "id", stage.alias("stage"), "rank_a", "rank_c")


@query("join17_join28_flips", f"""with {TOP}, {GOLD}, g as (select qid, unnest(gold) as id from gold),
h as (select g.qid, k, bool_or(coalesce(a.rank <= k, false)) as x, bool_or(coalesce(c.rank <= k, false)) as y from g cross join (values (3), (5)) v(k) left join a_r a on a.qid = g.qid and a.id = g.id left join c_r c on c.qid = g.qid and c.id = g.id group by all)
select k, count(*)::bigint as n, coalesce(list(qid order by qid) filter (y and not x), []) as fixed, coalesce(list(qid order by qid) filter (x and not y), []) as broken from h group by k""")
def _(spark, sf):
    corpus = corpus_of(spark, sf)
    g = gold_lists(spark, sf, corpus).select("qid", F.explode("gold").alias("id"))
    a, c = bm25_pair(spark, sf, corpus=corpus)
    a = a.select("qid", "id", F.col("rank").alias("ra"))
    c = c.select("qid", "id", F.col("rank").alias("rc"))
    rows = g.join(a, ["qid", "id"], "left").join(c, ["qid", "id"], "left").withColumn("k", F.explode(F.array(F.lit(3), F.lit(5))))
    hit = lambda r: F.bool_or(F.coalesce(F.col(r) <= F.col("k"), F.lit(False)))
    h = rows.groupBy("qid", "k").agg(hit("ra").alias("x"), hit("rc").alias("y"))
    only = lambda w: F.array_sort(F.collect_list(F.when(F.expr(w), F.col("qid"))))
    return h.groupBy("k").agg(F.count("*").alias("n"), only("y and not x").alias("fixed"), only("x and not y").alias("broken"))


@query("udf09_udf10_sweep", f"""with {LEXICAL}, {GOLD}, cfg(cid, k1, b) as (values (1, 1.5::double, 0.75::double), (2, 1.5, 0.25), (3, 1.2, 0.5)),
s as (select cid, qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))), 6) as score
  from posts join qt using (term) join (select term, count(*) as df from posts group by term) using (term) cross join (select count(*) as n, avg(dl) as avg_dl from sizes) cross join cfg group by all having score > 0),
r as (select * from (select *, row_number() over (partition by cid, qid order by score desc, id) as rank from s) where rank <= 5)
select c.cid::bigint as cid, count(distinct r.qid)::bigint as hit from cfg c left join (select r.* from r join (select qid, unnest(gold) as id from gold) g on g.qid = r.qid and g.id = r.id) r on r.cid = c.cid group by 1""")
def _(spark, sf):
    """A whole parameter grid over one coded corpus: each setting is a scan of numbers."""
    corpus, queries = corpus_of(spark, sf), asked(spark, sf)
    grid = [(1, 1.5, 0.75), (2, 1.5, 0.25), (3, 1.2, 0.5)]
    top = reduce(DataFrame.union, [lexical.bm25_top(corpus, queries, 5, k1, b).withColumn("cid", F.lit(cid).cast("long")) for cid, k1, b in grid])
    good = top.join(gold_lists(spark, sf, corpus).select("qid", F.explode("gold").alias("id")), ["qid", "id"])
    cells = spark.createDataFrame([(cid,) for cid, _, _ in grid], "cid long")
    return cells.join(good.groupBy("cid").agg(F.count_distinct("qid").alias("hit")), "cid", "left").select("cid", F.coalesce("hit", F.lit(0)).alias("hit"))


@query("txt32_prompt_context", f"""with {TOP} select qid, string_agg('[' || rank || '] ' || d.source || ': ' || d.text, chr(10) order by rank) as context from a_r join documents d on d.doc_id = id where rank <= 3 group by qid""")
def _(spark, sf):
    hits = bm25_ranked(spark, sf, 20).where("rank <= 3").join(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text"), "id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(": "), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("context"))


@query("txt28_guide_topics", "select b.item_id, r.topic from benchmark b join (values ('articles', 'the '), ('links', 'and '), ('places', ' in ')) r(topic, mark) on contains(b.text, r.mark)")
def _(spark, sf):
    rules = spark.createDataFrame([("articles", "the "), ("links", "and "), ("places", " in ")], "topic string, mark string")
    return t(spark, sf, "benchmark").join(F.broadcast(rules), F.expr("contains(text, mark)")).select("item_id", "topic")


@query("txt29_query_stems", "select item_id, list_sort(list_distinct(list_filter(list_transform(string_split(lower(text), ' '), lambda w: regexp_replace(w, '(ing|ed|ly|es|s)?[.,]*$', '')), lambda w: length(w) >= 2 and w not in ('the', 'of')))) as stems from benchmark")
def _(spark, sf):
    stems = F.transform(F.split(F.lower("text"), " "), lambda w: F.regexp_replace(w, "(ing|ed|ly|es|s)?[.,]*$", ""))
    kept = F.filter(stems, lambda w: (F.length(w) >= 2) & ~w.isin("the", "of"))
    return t(spark, sf, "benchmark").select("item_id", F.array_sort(F.array_distinct(kept)).alias("stems"))


@query("str28_claim_binding", "with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as source from conversations), w as (select conv_id, turn, list_distinct(string_split(lower(text), ' ')) as a, list_distinct(string_split(lower(coalesce(source, '')), ' ')) as b from p) select conv_id, turn, round(len(list_intersect(a, b))::double / len(a), 6) as cover from w")
def _(spark, sf):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t(spark, sf, "conversations").withColumn("source", F.coalesce(before, F.lit("")))
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in ("text", "source"))
    return rows.select("conv_id", "turn", F.round(F.size(F.array_intersect(a, b)) / F.size(a), 6).alias("cover"))


@query("mrg18_append_absent", "with c as (select o_custkey as code, o_orderdate::date::varchar as day from orders where o_orderstatus = 'F'), w as (select o_custkey as code, o_orderdate::date::varchar as day from orders where o_orderstatus = 'P') select code, day from c union all select code, day from w where (code, day) not in (select code, day from c)")
def _(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").cast("string").alias("day"), "o_orderstatus")
    c, w = o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'P'").drop("o_orderstatus")
    return c.unionByName(w.join(c, ["code", "day"], "left_anti").select("code", "day"))


@query("agg24_agg25_group_recall", "with g as (select o_custkey as qid, o_orderkey % 4 as grp, list(distinct o_orderkey % 10) as members from orders group by all), s as (select o_custkey as qid, list(distinct l_partkey % 10) as got from orders join lineitem on l_orderkey = o_orderkey where l_linenumber = 1 group by 1) select g.qid, count(*)::bigint as n_groups, count_if(list_has_any(members, coalesce(got, [])))::bigint as found, bool_and(list_has_any(members, coalesce(got, []))) as complete from g left join s using (qid) group by 1")
def _(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), "o_orderkey")
    g = o.groupBy("qid", (F.col("o_orderkey") % 4).alias("grp")).agg(F.collect_set(F.col("o_orderkey") % 10).alias("members"))
    line = t(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    s = o.join(line, "o_orderkey").groupBy("qid").agg(F.collect_set(F.col("l_partkey") % 10).alias("got"))
    hit = F.coalesce(F.arrays_overlap("members", "got"), F.lit(False))
    return g.join(s, "qid", "left").groupBy("qid").agg(F.count("*").alias("n_groups"), F.count_if(hit).alias("found"), F.bool_and(hit).alias("complete"))


_STEP = """
g{n} as (select qid, id, score, terms, row_number() over (partition by qid order by round(score + 5.0 * len(list_filter(terms, lambda t: not list_contains(covered, t))) / greatest(1, n_terms), 9) desc, score desc, id) as r, covered, n_terms from c{m}),
p{n} as (select qid, {n} as place, id, score from g{n} where r = 1),
c{n} as (select g.qid, g.id, g.score, g.terms, list_distinct(g.covered || b.terms) as covered, g.n_terms from g{n} g join (select qid, terms from g{n} where r = 1) b using (qid) where g.r > 1)"""


@query(
    "rnk21_cover_query",
    f"""with {TOP}, {BM25.format(n="x", k1=1.5, b=0.25, k=20)},
h as (select a_r.qid, a_r.id, a_r.score, d.source as parent from a_r join documents d on d.doc_id = a_r.id join x_r on x_r.qid = a_r.qid and x_r.id = a_r.id),
f as (select * from (select *, row_number() over (partition by qid, parent order by score desc, id) as r from h) where r = 1),
z as (select qid, count(*) as n_terms from qt group by qid),
c0 as (select f.qid, f.id, f.score, list(qt.term) as terms, []::varchar[] as covered, any_value(n_terms) as n_terms from f join posts on posts.id = f.id join qt on qt.qid = f.qid and qt.term = posts.term join z on z.qid = f.qid group by f.qid, f.id, f.score),
{_STEP.format(n=1, m=0)}, {_STEP.format(n=2, m=1)}, {_STEP.format(n=3, m=2)}
select qid, place::int as place, id, score from (from p1 union all from p2 union all from p3)""",
)
def _(spark, sf):
    """Three documents a question that together hold most of its words: BM25 hits of two settings, one a source."""
    corpus = corpus_of(spark, sf, carry=("source",))
    near, wide = bm25_pair(spark, sf, corpus=corpus)
    parents = corpus.rows.select("id", F.col("source").alias("parent"))
    hits = near.select("qid", "id", "score").join(parents, "id")
    terms = corpus.rows.select("id", F.explode("terms").alias("term"))
    questions = asked(spark, sf).select("qid", "term")
    held = near.select("qid", "id").join(questions, "qid").join(terms, ["id", "term"], "left_semi")
    sizes = questions.groupBy("qid").agg(F.count("*").alias("n_terms"))
    return selection.cover_query(hits, held, sizes, 3, 5.0, support=wide)


CHUNK = "doc_id long, source string, text string"


@query("src01_src05_snk01_json_round_trip", "select doc_id, source, md5(text) as h, (case when lang = 'en' then 0 else 1 end) as input from documents")
def _(spark, sf):
    """Two exports as JSON Lines in the shared folder, scanned and merged again."""
    folder = shared_folder(spark)
    docs = t(spark, sf, "documents")
    paths = []
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for name, own in (("en", english), ("rest", ~english)):
        paths.append(f"{folder}/export-{name}-{uuid.uuid4().hex}")
        jsonl.export_ordered(docs.where(own).select("doc_id", "source", "text"), paths[-1], ["doc_id"], tasks=4)
    merged = jsonl.merge_inputs([jsonl.scan_all(spark, [p, p + "-absent"], CHUNK) for p in paths], "doc_id")
    return merged.select("doc_id", "source", F.md5("text").alias("h"), "input")

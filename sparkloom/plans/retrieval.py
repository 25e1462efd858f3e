"""Queries: tokenising, lexical and dense ranking, fusion, re-ranking, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, lexical, metrics
from ..operators.vectors import nearest
from ..session import table
from .registry import query

# ---- SQL shared by the oracles -------------------------------------------------

TOKENS = r"""
  list_concat(
    list_transform(regexp_extract_all({t}, '제\d+조(?:의\d+)?(?:제\d+항)?'), lambda a: '§' || a),
    flatten(list_transform(regexp_extract_all({t}, '[가-힣]+|[一-龥]+|[A-Za-z]+|[0-9]+'),
      lambda w: list_concat([w], case when length(w) > 2 then list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) else [] end))))"""

LEXICAL = f"""
dt as (select doc_id as id, lang, {TOKENS.format(t="text")} as toks from documents),
sizes as (select id, lang, len(toks) as dl from dt),
posts as (select id, lang, term, count(*) as tf, any_value(dl) as dl from (select id, lang, len(toks) as dl, unnest(toks) as term from dt) group by id, lang, term),
qt as (select qid, term, count(*) as qtf from (select item_id as qid, unnest({TOKENS.format(t="text")}) as term from benchmark) group by all)"""

BM25 = """
{n} as (
  select qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avg_dl))), 6) as score
  from posts join qt using (term) join (select term, count(*) as df from posts group by term) using (term)
    cross join (select count(*) as n, avg(dl) as avg_dl from sizes)
  group by qid, id having score > 0),
{n}_r as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from {n}) where rank <= {k})"""

TFIDF = """
idf as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf from posts cross join (select count(*)::double as n from sizes) group by term, n),
dw as (select id, term, (1 + ln(tf)) * idf as w from posts join idf using (term)),
qw as (select qid, term, (1 + ln(qtf)) * idf as v from qt join idf using (term)),
tfidf as (
  select qid, id, round(sum(w * v) / (any_value(qn) * any_value(dn)), 6) as score from dw join qw using (term)
    join (select id, sqrt(sum(w * w)) as dn from dw group by id) using (id) join (select qid, sqrt(sum(v * v)) as qn from qw group by qid) using (qid)
  group by qid, id having score > 0),
tfidf_r as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from tfidf) where rank <= 20)"""

GOLD = "gold as (select b.item_id as qid, list(d.doc_id order by d.doc_id) as gold from benchmark b join documents d on contains(d.text, b.text) group by 1)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus_of(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> lexical.Corpus:
    return lexical.index(_docs(spark, sf_dir), carry=carry)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_terms(table(spark, sf_dir, "benchmark"))


def bm25_ranked(spark: SparkSession, sf_dir: str, k: int = 10, k1: float = 1.5, b: float = 0.75, corpus: lexical.Corpus | None = None) -> DataFrame:
    return lexical.bm25_top(corpus or corpus_of(spark, sf_dir), asked(spark, sf_dir), k, k1, b)


def bm25_pair(spark: SparkSession, sf_dir: str, k: int = 20, other: int = 20, corpus: lexical.Corpus | None = None) -> tuple[DataFrame, DataFrame]:
    """The rankings with b 0.75 and 0.25, from one coded corpus."""
    corpus = corpus or corpus_of(spark, sf_dir)
    return bm25_ranked(spark, sf_dir, k, corpus=corpus), bm25_ranked(spark, sf_dir, other, b=0.25, corpus=corpus)


def both_ranked(spark: SparkSession, sf_dir: str, b: float) -> tuple[DataFrame, DataFrame]:
    """BM25 and TF-IDF rankings, from one coded corpus."""
    corpus = corpus_of(spark, sf_dir)
    return bm25_ranked(spark, sf_dir, 20, b=b, corpus=corpus), lexical.tfidf_top(corpus, asked(spark, sf_dir), 20)


def gold_lists(spark: SparkSession, sf_dir: str, corpus: lexical.Corpus | None = None) -> DataFrame:
    """``(qid, gold)``: documents that contain a benchmark text. The benchmark is asked of all documents as a stated query set."""
    found = lexical.containing(corpus or corpus_of(spark, sf_dir), _docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("item_id").alias("qid")).agg(F.array_sort(F.collect_list("id")).alias("gold"))


@query("txt01_tokenize", f"select doc_id, len(toks)::bigint as n_tokens, len(list_distinct(toks))::bigint as n_terms, toks[1] as first_token, toks[-1] as last_token from (select doc_id, {TOKENS.format(t='text')} as toks from documents)")
def _(spark, sf_dir):
    toks = _docs(spark, sf_dir).select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.get("t", F.lit(0)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


@query("txt02_bm25_statistics", f"with {LEXICAL} select term, count(*)::bigint as df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from posts cross join (select count(*) as n from sizes) group by term, n")
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(tx.tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.round(F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("txt03_bm25_search", f"with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.75, k=10)} select qid, id, score, rank from s_r")
def bm25_search(spark, sf_dir):
    return bm25_ranked(spark, sf_dir).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("txt04_txt05_tfidf_search", f"with {LEXICAL}, {TFIDF} select qid, id, score, rank from tfidf_r")
def _(spark, sf_dir):
    return lexical.tfidf_top(corpus_of(spark, sf_dir), asked(spark, sf_dir), 20).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


DENSE = """
v as (select vec_id, label, embedding::double[] as x from embeddings),
s as (select q.vec_id as qid, d.vec_id as id, round(list_cosine_similarity(q.x, d.x), 6) as score from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
dense_r as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from s where score > 0) where rank <= 20)"""


def dense_ranked(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Exact k-NN: every hundredth vector is the stated query set, asked of all vectors in blocks."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.where("id % 100 = 0"), k)


@query("txt06_cosine", "with v as (select vec_id, label, embedding::double[] as x from embeddings) select a.vec_id, b.vec_id as other, round(list_cosine_similarity(a.x, b.x), 6) as cosine from v a join v b on b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    other = v.select(F.col("vec_id").alias("other"), (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return v.join(other, "vec_id").select("vec_id", "other", F.round(lexical.cosine(F.col("embedding"), F.col("y")), 6).alias("cosine"))


@query("txt07_dense_search", f"with {DENSE} select qid, id, score, rank from dense_r")
def _(spark, sf_dir):
    return dense_ranked(spark, sf_dir).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("txt12_distinct_texts", "select text, count(*)::bigint as uses, min(doc_id) as first_id from documents group by text")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("text").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_id"))


@query("rnk02_reciprocal_rank_fusion", f"""with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.25, k=20)}, {TFIDF},
f as (select qid, id, round(sum(part), 9) as score from (select qid, id, 1.0::double / (5 + rank) as part from s_r union all select qid, id, 1.0::double / (5 + rank) from tfidf_r) group by all)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from f) where rank <= 10""")
def _(spark, sf_dir):
    fused = fusion.reciprocal_rank_fusion([(ranked, 1.0) for ranked in both_ranked(spark, sf_dir, 0.25)], 10)
    return fused.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("rnk03_weighted_fusion", f"""with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.75, k=20)}, {TFIDF},
f as (select qid, id, round(sum(part), 9) as score from (select qid, id, 1.0::double / (5 + rank) as part from s_r union all select qid, id, 2.0::double / (5 + rank) from tfidf_r) group by all)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from f) where rank <= 5""")
def _(spark, sf_dir):
    fused = fusion.reciprocal_rank_fusion(list(zip(both_ranked(spark, sf_dir, 0.75), (1.0, 2.0))), 5)
    return fused.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("rnk05_fused_union", f"""with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.25, k=20)}, {TFIDF}
select qid, id, round(sum(part), 9) as score, count(*)::bigint as members from (select qid, id, 1.0::double / (5 + rank) as part from s_r union all select qid, id, 1.0::double / (5 + rank) from tfidf_r) group by qid, id""")
def _(spark, sf_dir):
    parts = [m.select("qid", "id", (F.lit(1.0) / (5 + F.col("rank"))).alias("part")) for m in both_ranked(spark, sf_dir, 0.25)]
    return parts[0].unionByName(parts[1]).groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("members"))


@query("rnk06_band_rerank", f"""with recursive {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.75, k=20)},
h as (select r.qid, r.id, r.score, r.rank, case when d.source like '%1' then 0 when d.source like '%2' then 1 when d.source like '%3' then 2 else 3 end as level, d.n_chars as day from s_r r join documents d on d.doc_id = r.id),
w(qid, rank, anchor, band) as (
  select qid, rank, score, 1 from h where rank = 1
  union all
  select h.qid, h.rank, case when w.anchor - h.score = 0 or w.anchor > 0 and w.anchor - h.score <= 0.03 * w.anchor + 1e-12 then w.anchor else h.score end,
    case when w.anchor - h.score = 0 or w.anchor > 0 and w.anchor - h.score <= 0.03 * w.anchor + 1e-12 then w.band else w.band + 1 end
  from w join h on h.qid = w.qid and h.rank = w.rank + 1)
select qid, id, score, band::bigint as band, place from (
  select h.qid, h.id, h.score, w.band, row_number() over (partition by h.qid order by w.band, h.level, h.day desc, h.rank, h.id) as place from h join w using (qid, rank)) where place <= 10""")
def _(spark, sf_dir):
    hits = bm25_ranked(spark, sf_dir, 20)
    source = F.col("source")
    level = F.when(source.endswith("1"), 0).when(source.endswith("2"), 1).when(source.endswith("3"), 2).otherwise(3)
    facts = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), level.alias("level"), F.col("n_chars").alias("day"))
    out = fusion.band_rerank(hits.join(facts, "id"), 10)
    return out.select("qid", "id", "score", F.col("band").cast("long").alias("band"), F.col("place").cast("long").alias("place"))


@query("rnk08_partitioned_bm25", f"""with {LEXICAL},
st as (select lang, count(*) as n, avg(dl) as avg_dl from sizes group by lang), dfs as (select lang, term, count(*) as df from posts group by all),
s as (select qid, id, lang, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) as score
  from posts join qt using (term) join dfs using (lang, term) join st using (lang) group by qid, id, lang having score > 0),
p as (select * from s qualify row_number() over (partition by qid, lang order by score desc, id) <= 5)
select qid, id, lang, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from p) where rank <= 5""")
def _(spark, sf_dir):
    corpus, queries = corpus_of(spark, sf_dir, ("lang",)), asked(spark, sf_dir)
    # each partition has statistics of its own; partitions are few, as a parameter of the search
    langs = [r["lang"] for r in corpus.rows.select("lang").distinct().collect()]
    own = [lexical.bm25_top(corpus.where(F.col("lang").eqNullSafe(lang)), queries, 5).withColumn("lang", F.lit(lang)) for lang in langs]
    return lexical.top_k(reduce(DataFrame.union, own).drop("rank"), 5).select("qid", "id", "lang", "score", F.col("rank").cast("long").alias("rank"))


@query("rnk13_stable_partition", f"""with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.75, k=20)}
select qid, id, place from (select qid, id, row_number() over (partition by qid order by d.lang <> 'en', rank) as place from s_r join documents d on d.doc_id = id) where place <= 5""")
def _(spark, sf_dir):
    hits = bm25_ranked(spark, sf_dir, 20).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang"), "id")
    order = Window.partitionBy("qid").orderBy(F.col("lang") != "en", "rank")
    return hits.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5").select("qid", "id", "place")


@query("rnk10_best_per_topic", f"""with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.75, k=20)}
select qid, source as topic, id, score from (select s_r.*, d.source, row_number() over (partition by qid, d.source order by rank) as r from s_r join documents d on d.doc_id = id) where r = 1""")
def _(spark, sf_dir):
    hits = bm25_ranked(spark, sf_dir, 20).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("topic")), "id")
    order = Window.partitionBy("qid", "topic").orderBy("rank")
    return hits.withColumn("r", F.row_number().over(order)).where("r = 1").select("qid", "topic", "id", "score")


@query("rnk14_round_robin", f"""with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.75, k=20)},
q as (select qid, id, rank, d.lang, row_number() over (partition by qid, d.lang order by rank) as rn from s_r join documents d on d.doc_id = id)
select qid, id, row_number() over (partition by qid order by rn, lang) as place from q""")
def _(spark, sf_dir):
    hits = bm25_ranked(spark, sf_dir, 20).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang"), "id")
    rn = F.row_number().over(Window.partitionBy("qid", "lang").orderBy("rank"))
    return hits.withColumn("rn", rn).select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("rn", "lang")).cast("long").alias("place"))


@query("rnk19_union_max", f"""with {LEXICAL}, {BM25.format(n='a', k1=1.5, b=0.75, k=20)}, {BM25.format(n='c', k1=1.5, b=0.25, k=20)},
m as (select qid, id, max(score) as score from (select qid, id, score from a_r union all select qid, id, score from c_r) group by all)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from m) where rank <= 10""")
def _(spark, sf_dir):
    out = fusion.union_max(*bm25_pair(spark, sf_dir), 10)
    return out.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("rnk28_fill_to_budget", f"""with {LEXICAL}, {BM25.format(n='a', k1=1.5, b=0.75, k=3)}, {BM25.format(n='c', k1=1.5, b=0.25, k=20)},
m as (select qid, id, min((tier, rank)) as p from (select qid, id, 0 as tier, rank from a_r union all select qid, id, 1, rank from c_r) group by all)
select qid, id, p[1]::bigint as tier, place from (select *, row_number() over (partition by qid order by p, id) as place from m) where place <= 8""")
def _(spark, sf_dir):
    out = fusion.fill_to_budget(*bm25_pair(spark, sf_dir, 3), 8)
    return out.select("qid", "id", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"))


@query("prj01_evidence", f"""with {LEXICAL}, {BM25.format(n='s', k1=1.5, b=0.75, k=3)}
select qid, rank, id, d.source || ' ' || d.lang as citation, d.text as excerpt, round(score, 4) as score from s_r join documents d on d.doc_id = id""")
def _(spark, sf_dir):
    hits = bm25_ranked(spark, sf_dir, 3).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "lang", F.col("text").alias("excerpt")), "id")
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.concat_ws(" ", "source", "lang").alias("citation"), "excerpt", F.round("score", 4).alias("score"))


def _run(spark, sf_dir, k: int = 5, b: float = 0.75, corpus: lexical.Corpus | None = None) -> DataFrame:
    """One row a question: retrieved, gold (empty where it has none)."""
    corpus = corpus or corpus_of(spark, sf_dir)
    gold = gold_lists(spark, sf_dir, corpus)
    lists = metrics.ranked_lists(bm25_ranked(spark, sf_dir, k, b=b, corpus=corpus))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    none = F.array().cast("array<bigint>")
    return items.join(lists, "qid", "left").join(gold, "qid", "left").select("qid", F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("gold", none).alias("gold"))


RUN = f"""{LEXICAL}, {{bm}}, {GOLD},
{{n}}run as (select b.item_id as qid, coalesce(r.ids, []) as retrieved, coalesce(g.gold, []) as gold from benchmark b
  left join (select qid, list(id order by rank) as ids from {{n}}_r group by qid) r on r.qid = b.item_id left join gold g on g.qid = b.item_id)"""
RUN_A = RUN.format(bm=BM25.format(n="s", k1=1.5, b=0.75, k=5), n="s")


@query("set01_hit_at_k", f"with {RUN_A} select qid, list_has_any(retrieved[1:1], gold) as hit1, list_has_any(retrieved[1:3], gold) as hit3, list_has_any(retrieved[1:5], gold) as hit5 from srun")
def _(spark, sf_dir):
    r = _run(spark, sf_dir)
    return r.select("qid", *[metrics.hit_at(F.col("retrieved"), F.col("gold"), k).alias(f"hit{k}") for k in (1, 3, 5)])


@query("set02_recall_at_k", f"with {RUN_A} select qid, case when len(gold) = 0 then 0.0::double else round(len(list_intersect(retrieved[1:5], gold))::double / len(list_distinct(gold)), 6) end as recall from srun")
def _(spark, sf_dir):
    return _run(spark, sf_dir).select("qid", F.round(metrics.recall_at(F.col("retrieved"), F.col("gold"), 5), 6).alias("recall"))


@query("set03_reciprocal_rank", f"with {RUN_A} select qid, round(coalesce((select 1.0::double / min(i) from unnest(range(1, len(retrieved) + 1)) t(i) where list_contains(gold, retrieved[i])), 0), 6) as rr from srun")
def _(spark, sf_dir):
    return _run(spark, sf_dir).select("qid", F.round(metrics.reciprocal_rank(F.col("retrieved"), F.col("gold")), 6).alias("rr"))


RR = "coalesce(list_min(list_transform(range(1, len(retrieved) + 1), lambda i: case when list_contains(gold, retrieved[i]) then i end)), 0)"
SUMMARY = f"select count(*)::bigint as n, round(avg(list_has_any(retrieved, gold)::int), 4) as hit, round(avg(case when {RR} > 0 then 1.0::double / {RR} else 0 end), 4) as mrr, round(avg(case when len(gold) = 0 then 0 else len(list_intersect(retrieved, gold))::double / len(gold) end), 4) as recall, list(qid order by qid) filter (not list_has_any(retrieved, gold)) as failures from {{r}}"


def _summary(r: DataFrame) -> DataFrame:
    hit = metrics.hit_at(F.col("retrieved"), F.col("gold"), 5)
    return r.agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 4).alias("hit"), F.round(F.avg(metrics.reciprocal_rank(F.col("retrieved"), F.col("gold"))), 4).alias("mrr"), F.round(F.avg(metrics.recall_at(F.col("retrieved"), F.col("gold"), 5)), 4).alias("recall"), F.array_sort(F.collect_list(F.when(~hit, F.col("qid")))).alias("failures"))


@query("agg05_run_summary", f"with {RUN_A} {SUMMARY.format(r='srun')}")
def _(spark, sf_dir):
    return _summary(_run(spark, sf_dir))


@query("agg07_answerable_metrics", f"with {RUN_A} select count(*)::bigint as n, round(avg(list_has_any(retrieved[1:1], gold)::int), 4) as hit1, round(avg(list_has_any(retrieved[1:3], gold)::int), 4) as hit3, round(avg(list_has_any(retrieved, gold)::int), 4) as hit5, round(avg(case when {RR} > 0 then 1.0::double / {RR} else 0 end), 4) as mrr from srun where len(gold) > 0")
def _(spark, sf_dir):
    r = _run(spark, sf_dir).where(F.size("gold") > 0)
    return r.agg(F.count("*").alias("n"), *[F.round(F.avg(metrics.hit_at(F.col("retrieved"), F.col("gold"), k).cast("int")), 4).alias(f"hit{k}") for k in (1, 3, 5)], F.round(F.avg(metrics.reciprocal_rank(F.col("retrieved"), F.col("gold"))), 4).alias("mrr"))


@query("flt11_prepare_questions", f"with {GOLD} select b.item_id as qid, coalesce(len(g.gold), 0)::bigint as n_gold, case when g.gold is null then 'no gold in corpus' else 'scored' end as state from benchmark b left join gold g on g.qid = b.item_id")
def _(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return items.join(gold_lists(spark, sf_dir), "qid", "left").select("qid", F.coalesce(F.size("gold"), F.lit(0)).cast("long").alias("n_gold"), F.when(F.col("gold").isNull(), "no gold in corpus").otherwise("scored").alias("state"))


PAIRED = f"{LEXICAL}, {BM25.format(n='a', k1=1.5, b=0.75, k=3)}, {BM25.format(n='c', k1=1.5, b=0.25, k=3)}, {GOLD}, " + ", ".join(
    f"{n}run as (select b.item_id as qid, coalesce(r.ids, []) as retrieved, coalesce(g.gold, []) as gold from benchmark b left join (select qid, list(id order by rank) as ids from {n}_r group by qid) r on r.qid = b.item_id left join gold g on g.qid = b.item_id)" for n in "ac")


def _paired(spark, sf_dir):
    corpus = corpus_of(spark, sf_dir)
    a, c = _run(spark, sf_dir, 3, corpus=corpus), _run(spark, sf_dir, 3, b=0.25, corpus=corpus)
    return a.withColumnRenamed("retrieved", "before").join(c.select("qid", F.col("retrieved").alias("after")), "qid")


@query("join16_compare_runs", f"""with {PAIRED}, p as (select a.qid, list_has_any(a.retrieved, a.gold) as x, list_has_any(c.retrieved, c.gold) as y from arun a join crun c using (qid))
select count(*)::bigint as n_common, count_if(not x and y)::bigint as fixed, count_if(x and not y)::bigint as broken, (count_if(not x and y) - count_if(x and not y))::bigint as net,
round(avg(x::int), 4) as hit_before, round(avg(y::int), 4) as hit_after, round(sqrt(avg(x::int) * (1 - avg(x::int)) / count(*)), 4) as se_before from p""")
def _(spark, sf_dir):
    p = _paired(spark, sf_dir).select(F.arrays_overlap("before", "gold").alias("x"), F.arrays_overlap("after", "gold").alias("y"))
    x, y = F.col("x"), F.col("y")
    p0 = F.avg(x.cast("int"))
    return p.agg(F.count("*").alias("n_common"), F.count_if(~x & y).alias("fixed"), F.count_if(x & ~y).alias("broken"), (F.count_if(~x & y) - F.count_if(x & ~y)).alias("net"), F.round(p0, 4).alias("hit_before"), F.round(F.avg(y.cast("int")), 4).alias("hit_after"), F.round(metrics.standard_error(p0, F.count("*")), 4).alias("se_before"))


@query("join18_rank_moves", f"""with {LEXICAL}, {BM25.format(n='a', k1=1.5, b=0.75, k=5)}, {BM25.format(n='c', k1=1.5, b=0.25, k=5)}
select coalesce(a.qid, c.qid) as qid, coalesce(a.id, c.id) as id, a.rank as before, c.rank as after,
case when a.id is null then 'entered' when c.id is null then 'left' when a.rank <> c.rank then 'moved' else 'same' end as state from a_r a full join c_r c on a.qid = c.qid and a.id = c.id""")
def _(spark, sf_dir):
    a, c = bm25_pair(spark, sf_dir, 5, 5)
    a = a.select("qid", "id", F.col("rank").cast("long").alias("before"))
    c = c.select("qid", "id", F.col("rank").cast("long").alias("after"))
    state = F.when(F.col("before").isNull(), "entered").when(F.col("after").isNull(), "left").when(F.col("before") != F.col("after"), "moved").otherwise("same")
    return a.join(c, ["qid", "id"], "full").select("qid", "id", "before", "after", state.alias("state"))


@query("set10_rank_changes", f"""with {PAIRED}
select a.qid, list_sort(list_filter(a.retrieved, lambda x: list_contains(a.gold, x) and not list_contains(c.retrieved, x))) as lost, list_sort(list_filter(c.retrieved, lambda x: list_contains(a.gold, x) and not list_contains(a.retrieved, x))) as gained from arun a join crun c using (qid)""")
def _(spark, sf_dir):
    p = _paired(spark, sf_dir)
    return p.select("qid", F.array_sort(F.array_except(F.array_intersect("before", "gold"), "after")).alias("lost"), F.array_sort(F.array_except(F.array_intersect("after", "gold"), "before")).alias("gained"))


@query("join13_gold_missing", "select l.doc_id from labels l left join documents d using (doc_id) where d.doc_id is null or d.lang <> 'en'")
def _(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).where("lang = 'en'"), "doc_id", "left_anti").select("doc_id")

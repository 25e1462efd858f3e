"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import cap_filters, decontaminate, html_text, kneser_ney, merkle, mixing, parity_join, product_codes, quality_trees, sharding, suffix_dedup, toxicity, url_cascade

Query = Callable[[SparkSession, str], DataFrame]

#: Production shards of the sharding query and stage.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), length=100)


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARDS)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "score", "overlap")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "keep")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.encode_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_toxicity_chain": op2_toxicity_chain,
        "op3_url_filter": op3_url_filter,
        "op4_repeated_bytes": op4_repeated_bytes,
        "op5_shard_documents": op5_shard_documents,
        "op6_html_text": op6_html_text,
        "op7_near_vectors": op7_near_vectors,
        "op8_benchmark_leaks": op8_benchmark_leaks,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_quality_perplexity": op10_quality_perplexity,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_quality_trees": op12_quality_trees,
        "op13_vector_codes": op13_vector_codes,
    }


OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w, source_size * 3 as cap from per),
o as (
  select *, sum(source_size) over () as total,
    sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as w_rest,
    coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_done from w),
c as (select *, cap * w_rest <= (total - cap_done) * w as capped from o),
t as (
  select source, source_size, case when capped then cap::double
    else (w * (total - coalesce(sum(case when capped then cap end) over (), 0)))::double / sum(case when not capped then w end) over () end as target from c),
r as (
  select s.doc_id, s.source, s.size, t.source_size, t.target,
    case when s.size > 0 then least(3.0::double, t.target / t.source_size) else 0 end as rate,
    (('0x' || substr(md5('7:' || coalesce(s.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from sized s join t on s.source is not distinct from t.source),
p as (select *, floor(rate)::bigint as copies, rate - floor(rate) as p from r),
k as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as rk, sum(size * copies) over (partition by source) as sure from p),
b as (
  select *, coalesce(sum(case when rk is not null then size end) over (partition by source order by rk, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from k)
select doc_id, size, source_size::bigint as source_size, target,
  ((copies + case when rk is not null and before + size / 2 <= target - sure then 1 else 0 end) * size)::bigint as taken from b
"""

OP3_SQL = r"""
with u as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '') as rest from pages),
h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from u),
rules(rh, rp, rv) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as v
  from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
l(lh) as (values ('ads-track.example.org'), ('cheap-pills.example.com'), ('free-bets.example.com'), ('spam-farm.example.org'),
  ('ads-track.example.net'), ('cheap-pills.example.net'), ('free-bets.example.net'), ('spam-farm.example.net')),
b as (select distinct page_id from h join l on host = lh or ends_with(host, '.' || lh))
select h.page_id, h.host, h.path, m.rule, coalesce(m.v, case when b.page_id is not null then 'block' else 'allow' end) as verdict
from h left join m using (page_id) left join b using (page_id)
"""


OP9_SQL = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
l as (
  select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles from l),
s as (select doc_id, unnest(sh) as sh from l),
p as (select x.doc_id as a, y.doc_id as b, count(*) as both_have from s x join s y using (sh) where x.doc_id <> y.doc_id group by all),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * both_have >= 85 * (x.n_shingles + y.n_shingles - both_have)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select n.doc_id, n.n_shingles, least(n.doc_id, min(r.b)) as component_id from n left join r on r.a = n.doc_id group by n.doc_id, n.n_shingles
"""


OP7_SQL = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as x from embeddings),
u as (
  select *, label is not null and x is not null and len(x) > 0 and list_aggregate(list_transform(x, lambda c: case when c is null or not isfinite(c) then 1 else 0 end), 'sum') = 0
    and list_aggregate(list_transform(x, lambda c: abs(coalesce(c, 0))), 'max') > 0 as able from v),
e as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where a.able and b.able and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.93),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
n as (select a, count(*) as n_links from e group by a),
c as (select a, min(b) as low from r group by a)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, least(v.vec_id, coalesce(low, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(low, v.vec_id)) as kept
from v left join n on n.a = v.vec_id left join c on c.a = v.vec_id
"""


def _merkle_levels(name: str, height: int = 9) -> str:
    """SQL of a hash tree over ``name``0 (g, i, h): nodes, their siblings left and right; enough levels for 8 ** height nodes."""
    out = []
    for k in range(height):
        out.append(f"""{name}s{k} as (
  select *, count(*) over (partition by g) > 1 as more,
    coalesce(string_agg(h, '') over (partition by g, i // 8 order by i rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by g, i // 8 order by i rows between 1 following and unbounded following), '') as r from {name}{k}),
{name}{k + 1} as (select g, i // 8 as i, case when any_value(more) then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {name}s{k} group by all)""")
    return ",\n".join(out)


def _merkle_proof(name: str, height: int = 9) -> str:
    """SQL of the proof steps of each node of ``name``0: a list of the siblings' sides, level by level."""
    parts = " || ".join(f"case when a{k}.more then [{{'l': a{k}.l, 'r': a{k}.r}}] else [] end" for k in range(height))
    joins = " ".join(f"join {name}s{k} a{k} on a{k}.g = a0.g and a{k}.i = a0.i // {8**k}" for k in range(1, height))
    return f"{name}p as (select a0.g, a0.i, {parts} as path from {name}s0 a0 {joins})"


OP11_SQL = rf"""
with c as (
  select *, row_number() over () as nr, case when text is null or doc_id is null then false else
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint), lambda acc, b: list_reduce(list_transform(range(8), lambda z: z::ubigint),
      lambda v, z: xor(v >> 1, (v & 1::ubigint) * 3988292384::ubigint), xor(acc, b)), 4294967295::ubigint), 4294967295::ubigint) % 3 = 0 end as tampered from documents),
f as (
  select nr, doc_id, lang, tampered, sha256(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when tampered then sha256(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as touched from c),
d as (
  select *, dense_rank() over (order by lang is not null, encode(lang)) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf, nr) - 1 as i from f),
t0 as (select g, i, leaf as h from d),
{_merkle_levels("t")},
{_merkle_proof("t")},
u0 as (select 0 as g, g as i, h from t9),
{_merkle_levels("u")},
{_merkle_proof("u")},
e as (
  select doc_id, leaf, touched, u0.h as subroot, u9.h as root, tp.path || up.path as path
  from d join tp on tp.g = d.g and tp.i = d.i join u0 on u0.i = d.g join up on up.i = d.g cross join u9),
v as (
  select *, list_reduce(list_transform(path, lambda p: p), lambda acc, p: {{'l': '', 'r': sha256(p.l || acc.r || p.r)}}, {{'l': '', 'r': coalesce(touched, leaf)}}).r as folded_root from e)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) as proof_sha256, folded_root, folded_root = root as verified from v
"""


def _code_rounds() -> str:
    """SQL of two rounds of assignment and update."""
    return ",\n".join(
        f"""a{k} as (select v.nr, v.p, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': b.e}}) as m from v join b{k} b using (p) group by all),
w{k} as (select p, m.e as e, c, sum(x[c]) as s, count(*) as n from a{k} join v using (nr, p), unnest(range(1, len(x) + 1)) t(c) group by all),
u{k} as (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by c) as x from w{k} group by all),
b{k + 1} as (select p, e, coalesce(u{k}.x, b{k}.x) as x from b{k} left join u{k} using (p, e))"""
        for k in range(2)
    )


OP13_SQL = rf"""
with sound as (
  select *, row_number() over (order by vec_id nulls last, embedding) as nr from embeddings
  where embedding is not null and len(embedding) > 0 and len(embedding) % 16 = 0
    and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)),
r as (select nr, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from sound),
v as (select nr, p, x[(p * len(x) // 16 + 1):((p + 1) * len(x) // 16)] as x from r, unnest(range(16)) t(p)),
b0 as (select p, nr - 1 as e, x from v where nr <= 64),
{_code_rounds()},
a2 as (select v.nr, v.p, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': b.e}}) as m from v join b2 b using (p) group by all),
o as (select nr, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from a2 group by nr),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from o join r using (nr) cross join h
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op3_url_filter": OP3_SQL, "op7_near_vectors": OP7_SQL, "op9_ngram_jaccard": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_vector_codes": OP13_SQL}

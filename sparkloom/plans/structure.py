"""Queries: numbered units, packed lines, overlapping windows and their stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..session import table as t
from .registry import query

#: Lines of documents as numbered articles: by place plain, circled paragraph, item, subitem, indented subitem, item.
ARTICLE = """list_transform(string_split(text, chr(10)), lambda l, k: case (k - 1) % 6 when 1 then chr((9312 + ((k - 1) // 6) % 20)::int) || ' ' || l when 2 then ((k - 1) % 9 + 1)::varchar || '. ' || l
  when 3 then '가. ' || l when 4 then '  나. ' || l when 5 then '10.' || l else l end)"""


def numbered(docs):
    """The same text in Spark: every line of a document, numbered by its place."""
    lines = F.split("text", "\n")
    signs = F.array(*[F.lit(chr(9312 + k)) for k in range(20)])

    def mark(line, k):
        return (
            F.when(k % 6 == 1, F.concat(F.element_at(signs, (F.floor(k / 6) % 20 + 1).cast("int")), F.lit(" "), line))
            .when(k % 6 == 2, F.concat((k % 9 + 1).cast("string"), F.lit(". "), line))
            .when(k % 6 == 3, F.concat(F.lit("가. "), line))
            .when(k % 6 == 4, F.concat(F.lit("  나. "), line))
            .when(k % 6 == 5, F.concat(F.lit("10."), line))
            .otherwise(line)
        )

    return docs.select("doc_id", F.array_join(F.transform(lines, mark), "\n").alias("text"))


@query(
    "str07_structure_units",
    rf"""with a as (select doc_id, {ARTICLE} as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as k, len(ls) as n from a),
m as (select *, line || case when k < n then chr(10) else '' end as piece,
  regexp_extract(line, '^[ \t]*([\x{{2460}}-\x{{2473}}])', 1) as p, regexp_extract(line, '^[ \t]*([0-9]{{1,3}})\.[ \t]', 1) as i, regexp_extract(line, '^[ \t]*([가나다라마바사아자차카타파하])\.[ \t]', 1) as s from l),
u as (select *, sum((k = 1 or p <> '' or i <> '' or s <> '')::int) over (partition by doc_id order by k) as ordinal from m),
g as (select doc_id, ordinal, string_agg(piece, '' order by k) as content, arg_min(p, k) as p, arg_min(i, k) as i, arg_min(s, k) as s from u group by all),
f as (select *, max(case when p <> '' then ordinal end) over w as par, max(case when i <> '' then ordinal end) over w as itm,
  coalesce(sum(length(content)) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as start from g window w as (partition by doc_id order by ordinal)),
k as (select *, coalesce(itm, 0) > coalesce(par, 0) as under from f)
select doc_id, 'u' || ordinal as unit_key,
  case when i <> '' and par is not null then 'u' || par when s <> '' and p = '' and i = '' and under then 'u' || itm else 'root' end as parent_key,
  case when p <> '' then 'paragraph' when i <> '' then 'item' when s <> '' and under then 'subitem' else 'text' end as unit_type,
  case when p <> '' then (ord(p) - 9311)::varchar when i <> '' then i when s <> '' and under then s else '' end as unit_number,
  ordinal::int as ordinal, start::bigint as start_offset, (start + length(content))::bigint as end_offset, md5(content) as content from k
union all select doc_id, 'root', null, 'article', '', 0, 0, length(array_to_string(ls, chr(10))), md5(array_to_string(ls, chr(10))) from a where ls is not null""",
)
def _(spark, sf):
    """Documents as numbered articles, parsed to units; contents as digests."""
    return folds.structure_units(numbered(t(spark, sf, "documents")), ["doc_id"]).withColumn("content", F.md5("content"))


@query(
    "str07_lossless_units",
    f"""select doc_id, length(array_to_string({ARTICLE}, chr(10)))::bigint as n_chars, true as lossless from documents where text is not null""",
)
def _(spark, sf):
    """Units joined by their order are the text; spans follow one another; parents come before."""
    parsed = folds.structure_units(numbered(t(spark, sf, "documents")), ["doc_id"])
    parts = F.array_sort(F.collect_list(F.when(F.col("ordinal") > 0, F.struct("ordinal", "start_offset", "end_offset", "content"))))
    joined = parsed.groupBy("doc_id").agg(F.max_by("content", -F.col("ordinal")).alias("text"), parts.alias("parts"))
    own = F.array_join(F.transform("parts", lambda p: p["content"]), "") == F.col("text")
    chained = F.forall(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.col("parts")[k]["start_offset"] == F.col("parts")[k - 1]["end_offset"])
    return joined.select("doc_id", F.length("text").cast("long").alias("n_chars"), (own & F.when(F.size("parts") > 1, chained).otherwise(True)).alias("lossless"))


@query(
    "str08_packed_lines",
    """with l as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from documents where text is not null),
f as (select doc_id, text, list_reduce(ls, lambda acc, x: case when acc.n > 0 and acc.size + length(x) > 600
  then {'n': 1::bigint, 'size': length(x)::bigint, 'out': acc.out || [acc.now], 'now': x}
  else {'n': acc.n + 1, 'size': acc.size + length(x), 'out': acc.out, 'now': case when acc.n > 0 then acc.now || chr(10) || x else x end} end,
  {'n': 0::bigint, 'size': 0::bigint, 'out': []::varchar[], 'now': ''}) as s from l),
c as (select doc_id, case when s.n > 0 then s.out || [s.now] else [trim(text)] end as cs from f)
select doc_id, (unnest(range(len(cs))))::int as chunk_index, md5(unnest(cs)) as body, length(unnest(cs))::bigint as n_chars from c""",
)
def _(spark, sf):
    """Lines of documents packed to 600 characters."""
    return folds.packed_lines(t(spark, sf, "documents"), ["doc_id"]).select("doc_id", "chunk_index", F.md5("body").alias("body"), F.length("body").cast("long").alias("n_chars"))




def _end(s: str) -> str:
    """SQL of a window's end: behind the last line end of its last 800 characters, else 1,800 on."""
    back = f"instr(reverse(substr(text, {s} + 1001, 800)), chr(10))"
    return f"case when n <= {s} + 1800 then n when {back} > 0 then {s} + 1801 - {back} else {s} + 1800 end"


WINDOWS = f"""recursive c(doc_id, text, n, k, s, e) as (
  select doc_id, text, n, 0, 0::bigint, {_end("0")} from (select doc_id, text, length(text)::bigint as n from documents where length(text) > 0)
  union all select doc_id, text, n, k + 1, s2, {_end("s2")} from (select *, greatest(s + 1, e - 300) as s2 from c where e < n))"""


@query("str09_overlapping_windows", f"with {WINDOWS} select doc_id, k::int as chunk_index, s as source_start, e as source_end, md5(substr(text, s + 1, e - s)) as body from c")
def _(spark, sf):
    """Windows of 1,800 characters over whole documents that break at line ends and overlap by 300."""
    return folds.window_rows(t(spark, sf, "documents"), ["doc_id"]).withColumn("body", F.md5("body"))


@query("txt30_stitched_windows", f"with {WINDOWS} select doc_id, md5(any_value(text)) as body, min(s) as source_start, max(e) as source_end, count(*)::bigint as n_windows, null::varchar as fault from c group by doc_id")
def _(spark, sf):
    """Windows that are rows, joined to the whole text of their document."""
    return folds.stitch(folds.window_rows(t(spark, sf, "documents"), ["doc_id"]), ["doc_id"]).withColumn("body", F.md5("body"))

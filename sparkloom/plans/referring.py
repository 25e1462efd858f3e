"""Queries: adopted articles, lists of paragraphs and quantities in whole documents with Korean clauses at their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references
from ..operators.folds import fold_rows
from ..operators.shared import ship
from ..session import table as t
from .registry import query

ship(references.__name__)

_K = "(doc_id % 9 + 1)"
#: Bodies of an article by the document's number: a list, a range, a range that is too wide, a quotation, prose, another article's heading.
BODIES = [
    f"concat('[민법 제10조(준용)]\\n제', {_K}, '조, 민법 제30조의2 및 제40조 제1항의 규정은 이 경우에 준용한다.\\n[본조신설 2020. 1. 2.]')",
    f"concat('[민법 제10조]\\n제', {_K}, '조 내지 제', {_K} + 3, '조의 규정은 이에 준용한다.')",
    f"concat('[민법 제10조]\\n제', {_K}, '조 내지 제', {_K} + 300, '조의 규정은 이에 준용한다.')",
    f"concat('[민법 제10조]\\n「상법」 제', {_K}, '조의 규정은 이에 준용한다.')",
    f"concat('[민법 제10조]\\n제', {_K}, '조에 따른다. 제3조의 규정은 이에 준용한다.')",
    f"concat('[민법 제11조]\\n제', {_K}, '조의 규정은 이에 준용한다.')",
]


@query(
    "join11_direct_references",
    f"""with d as (select doc_id, doc_id % 6 as kind, {_K} as k from documents where doc_id is not null),
r as (select doc_id, '민법-제' || k || '조' as target from d where kind = 0 union all select doc_id, '민법-제30조의2' from d where kind = 0 union all select doc_id, '민법-제40조' from d where kind = 0
  union all select doc_id, '민법-제' || unnest(range(k, k + 4)) || '조' from d where kind = 1)
select doc_id, target from r""",
)
def _(spark, sf):
    """Articles that the article of each document adopts; only clauses that are nothing else count."""
    body = F.element_at(F.array(*map(F.expr, BODIES)), (F.col("doc_id") % 6 + 1).cast("int"))
    chunks = t(spark, sf, "documents").where("doc_id is not null").select("doc_id", F.struct(F.lit("제10조").alias("article_no"), body.alias("text")).alias("row"))
    return fold_rows(chunks, ["doc_id"], "row", references.adopted, references.REFERENCE)


_LIST = f"concat(' 민법 제5조제', {_K}, '항, 제', {_K} + 20, '항 및 ', {_K} + 30, '항; 제6조의2 제', {_K}, '항부터 제', {_K} + 2, '항까지, 제7조 제9항 내지 ', {_K} - 1, '항')"


@query(
    "str32_paragraph_groups",
    f"""with d as (select doc_id, {_K} as k from documents where text is not null)
select doc_id, list_sort(list_distinct([k, k + 20, k + 30])) as paragraphs from d union all select doc_id, [k, k + 1, k + 2] from d union all select doc_id, case when k = 10 then [9] else [0, 9] end from d""",
)
def _(spark, sf):
    """Lists and ranges of paragraphs at the end of every document."""
    docs = t(spark, sf, "documents").where("text is not null").select("doc_id", F.concat("text", F.expr(_LIST)).alias("text"))
    return fold_rows(docs, ["doc_id"], "text", references.paragraph_groups, references.GROUP).select("doc_id", F.col("paragraphs").cast("array<bigint>").alias("paragraphs"))


@query(
    "num05_quantities",
    f"""select doc_id, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[\\s,]', '', 'g'), '[0-9]+(?:\\.[0-9]+)?%')) || list_distinct([{_K} || '억' || {_K} || '천만원', '30평', {_K} || '개월', '이천만원'])) as quantities from documents where text is not null""",
)
def _(spark, sf):
    """Quantities of every document: shares that its own text has, and those added to it."""
    tail = F.expr(f"concat(' 약 ', {_K}, '억 ', {_K}, '천만 원과 30 평, ', {_K}, ' 개월 만일 그렇다면 이천만원')")
    return t(spark, sf, "documents").where("text is not null").select("doc_id", F.array_sort(references.quantities(F.concat("text", tail))).alias("quantities"))

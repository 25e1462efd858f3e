"""Queries: canonical values in whole documents, to which amounts, shares, fractions, dates and periods are added by their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators.folds import fold_rows
from ..operators.shared import ship
from ..session import table as t
from .registry import query

ship(values.__name__)

#: Raw value and canonical form of each kind; the same strings work in Spark and DuckDB.
PLANTED = [
    ("money", "concat(doc_id % 900 + 100, ',500원')", "cast((doc_id % 900 + 100) * 1000 + 500 as string)"),
    ("money", "concat(doc_id % 9 + 1, '억 ', doc_id % 7 + 1, '천 ', doc_id % 5 + 1, '만 원')", "cast((doc_id % 9 + 1) * 100000000 + ((doc_id % 7 + 1) * 1000 + doc_id % 5 + 1) * 10000 as string)"),
    ("percent", "concat(doc_id % 9 + 1, '할')", "cast((doc_id % 9 + 1) * 10 as string)"),
    ("fraction", "concat(doc_id % 9 + 2, '분의 ', doc_id % 5 + 1)", "concat(doc_id % 5 + 1, '/', doc_id % 9 + 2)"),
    ("date", "concat(2000 + doc_id % 25, '년 ', doc_id % 12 + 1, '월 ', doc_id % 28 + 1, '일')", "concat(2000 + doc_id % 25, '-', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'))"),
    ("period", "concat(doc_id % 60 + 1, '개월')", "concat(doc_id % 60 + 1, '개월')"),
]
TAIL = "concat('; ', doc_id % 100, '.50%; ', " + ", '; ', ".join(raw for _, raw, _ in PLANTED) + ", ' 전세')"


@query(
    "dat08_num01_values",
    f"""with d as (select doc_id, text || {TAIL.replace(" as string)", " as varchar)")} as text from documents where text is not null),
v as ("""
    + " union all ".join(f"select doc_id, '{kind}' as kind, {raw} as raw, {canon.replace(' as string)', ' as varchar)')} as canonical from d" for kind, raw, canon in PLANTED)
    + r""" union all select doc_id, 'percent', raw, regexp_replace(regexp_replace(regexp_replace(raw, '\s*%$', ''), '(\.[0-9]*?)0+$', '\1'), '\.$', '')
  from (select doc_id, unnest(list_transform(regexp_extract_all(text, '(?:^|[^0-9.])[0-9]{1,6}(?:\.[0-9]{1,4})?\s*%'), lambda x: regexp_extract(x, '[0-9][^%]*%$'))) as raw from d))
select doc_id, kind, raw, regexp_replace(canonical, '^0+([0-9])', '\1') as canonical, count(*)::bigint as n from v group by all""",
)
def _(spark, sf):
    """Every value of every document, with how often it is there."""
    docs = t(spark, sf, "documents").where("text is not null").select("doc_id", F.concat("text", F.expr(TAIL)).alias("text"))
    found = fold_rows(docs, ["doc_id"], "text", values.values, values.VALUE)
    return found.groupBy("doc_id", "kind", "raw", "canonical").agg(F.count("*").alias("n"))


#: What an answer states and what its evidence has: the same kinds of values, of an id that is a little smaller for two of three answers.
_SOURCE = "(doc_id - doc_id % 3)"


def _at(expression: str, number: str) -> str:
    return expression.replace("doc_id", number)


def _canonical(number: str) -> str:
    """SQL list of kind and canonical form of all planted values; a share of a whole number of percents and a half among them."""
    share = f"['percent', cast({number} % 100 as varchar) || '.5']"
    return "[" + ", ".join([share, *(f"['{kind}', regexp_replace({_at(canon, number).replace(' as string)', ' as varchar)')}, '^0+([0-9])', '\\1')]" for kind, _, canon in PLANTED)]) + "]"


@query("rul07_unsupported_values", f"""select doc_id, unnest(list_distinct(list_filter({_canonical("doc_id")}, lambda v: not list_contains({_canonical(_SOURCE)}, v)))) as v from documents where text is not null""".replace("select doc_id, unnest", "select doc_id, v[1] as kind, v[2] as canonical from (select doc_id, unnest", 1) + ")")
def _(spark, sf):
    """Values of an answer that its evidence does not have, in whatever form either writes them; both hold the whole document."""
    docs = t(spark, sf, "documents").where("text is not null")
    found = lambda tail: fold_rows(docs.select("doc_id", F.concat("text", F.expr(tail)).alias("text")), ["doc_id"], "text", values.values, values.VALUE).select("doc_id", "kind", "canonical")
    return found(TAIL).distinct().join(found(_at(TAIL, _SOURCE)), ["doc_id", "kind", "canonical"], "left_anti")

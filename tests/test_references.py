"""Adopted articles, paragraph groups and quantities by written examples."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import references


@pytest.mark.parametrize(
    "body, found",
    [
        ("[민법 제10조(준용)]\n제3조 및 제5조의2의 규정은 이에 준용한다.", ["민법-제3조", "민법-제5조의2"]),
        ("[민법 제10조]\n제3조 내지\n제5조의 규정은 이에 준용한다.\n[본조신설 2020. 1. 2.]", ["민법-제3조", "민법-제4조", "민법-제5조"]),
        ("[민법 제10조]\n제5조 내지 제3조의 규정은 이에 준용한다.", []),
        ("[민법 제10조]\n제3조의2 내지 제5조의 규정은 이에 준용한다.", []),
        ("[민법 제10조]\n제3조 내지 제300조의 규정은 이에 준용한다.", []),
        ("[민법 제10조]\n「제3조」의 규정은 이에 준용한다.", []),
        ("[민법 제10조]\n앞글. 제3조의 규정은 이에 준용한다.", []),
        ("[민법 제11조]\n제3조의 규정은 이에 준용한다.", []),
        ("", []),
    ],
)
def test_adopted_articles(body, found):
    assert [x for (x,) in references.adopted({"article_no": "제10조", "text": body})] == found


def test_paragraph_groups():
    text = "제3조 제1항, 제2항 및 5항과 제4조의2 제7항부터 제9항까지 그리고 제5조제9항 내지 8항, 제6조 제1항~60항; 제2항"
    assert [(text[s:e], p) for s, e, p in references.paragraph_groups(text)] == [
        ("제3조 제1항, 제2항 및 5항", [1, 2, 5]),
        ("제4조의2 제7항부터 제9항까지", [7, 8, 9]),
        ("제5조제9항 내지 8항", [0, 9]),
        ("제6조 제1항~60항", [0, 1]),
    ]
    assert list(references.paragraph_groups("")) == []


def test_quantities(spark):
    rows = [("1,000 원과 3 개월, 2.5% 3억 5천만원", ["1000원", "3개월", "2.5%", "3억5천만원"]), ("만일 이사일", []), ("일억이천만원 5 만", ["일억이천만원", "5만"]), ("3개월 3개월", ["3개월"]), ("", []), (None, None)]
    got = spark.createDataFrame(list(enumerate(r[0] for r in rows)), "k int, t string").select("k", references.quantities(F.col("t")).alias("q")).collect()
    assert {r.k: r.q for r in got} == {k: want for k, (_, want) in enumerate(rows)}

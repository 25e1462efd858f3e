"""Queries: what questions ask for, over whole documents with a Korean question at their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import concepts as c
from ..functions.requests import requests_date_record
from ..session import table as t
from .registry import query

#: Questions, and whether they ask for the record: plain, other topic, referred back, waived, quoted, denied, an earlier question, in other words.
QUESTIONS = [
    ("확정일자 부여 기록을 조회하고 싶어요", True),
    ("확정일자의 뜻을 확인해 주세요", False),
    ("확정일자 기록은 어떻게 되나요. 그때 기록을 열람할 수 있나요", True),
    ("확정일자 기록은 묻지 않아요. 그때 기록을 열람할 수 있나요", False),
    ("「확정일자 기록 조회」라고 들었어요. 무엇인가요", False),
    ("확정일자 기록 확인이 아니라 대항력이 궁금해요", False),
    ("확정일자 기록 조회. 사용자 질문: 월세는 얼마인가요", False),
    ("확정 일자를 받았는지 확인하고 싶어요", True),
    ("확정일자 내역. 다른 이야기. 예전 기록을 찾아 주세요", False),
]


@query("txt20_date_record_requests", "select doc_id, doc_id % 9 in (" + ", ".join(str(k) for k, (_, asks) in enumerate(QUESTIONS) if asks) + ") as asks from documents where text is not null")
def _(spark, sf):
    docs = t(spark, sf, "documents").where("text is not null")
    asked = F.element_at(F.array(*[F.lit(q) for q, _ in QUESTIONS]), (F.col("doc_id") % len(QUESTIONS) + 1).cast("int"))
    return docs.select("doc_id", requests_date_record(F.concat("text", F.lit("\n"), asked)).alias("asks"))


#: Questions with the concepts of statutes and of civil law that they are about, by hand.
_LAW, _CIVIL = [x for _, x in c.LAW_RULES], [x for _, x in c.CIVIL_RULES]
ASKED = [
    ("집주인이 월세를 올려달라고 해요. 보증금을 돌려받을 수 있나요", [], []),
    ("확정일자는 어디서 받나요", [c.RECORD], []),
    ("확정일자를 안 받으면 어떻게 되나요", [c.EFFECT], []),
    ("공동 명의 집인데 대리인과 계약해도 되나요. 등기는 확인했어요", [], _CIVIL[:3]),
    ("계약을 해지한다고 내용증명을 보냈는데 반송됐어요", [], [c.NOTICE_TERM, c.SERVICE_TERM]),
    ("계약 해지 통보를 하지 않았어요. 보증금 받으려면 이사해야 하나요", [], [c.PERFORMANCE]),
    ("집주인 세금 체납이 걱정돼요. 전입신고는 했어요", [c.TAX_TERM, c.MOVE_TERM], []),
    ("국민임대 아파트 임대사업자와 계약 신고", [_LAW[0], c.PUBLIC_TERM], []),
    ("보일러 고장 수리비를 먼저 내고 싶어요", [], []),
    ("이전 대화: 체납. 사용자 질문: 중개수수료는 얼마인가요", [_LAW[1]], []),
    ("확정일자 부여 기록을 열람하고 싶어요", [c.RECORD, c.ACCESS], []),
    ("월세가 밀렸고 누수로 방을 못 쓰게 됐어요. 전세보증금 대출도 있어요", [], []),
    ("공공임대 상담. 사용자 추가 상황: 임대사업자와 계약했어요", [c.PRIVATE_TERM], []),
]
_ROW = "(doc_id % " + str(len(ASKED)) + " + 1)::int"
_TEXT = "text || chr(10) || [" + ", ".join(f"'{q}'" for q, _, _ in ASKED) + f"][{_ROW}]"


def _questions(spark, sf):
    docs = t(spark, sf, "documents").where("text is not null and doc_id is not null")
    asked = F.element_at(F.array(*[F.lit(q) for q, _, _ in ASKED]), (F.col("doc_id") % len(ASKED) + 1).cast("int"))
    return docs.select("doc_id", F.concat("text", F.lit("\n"), asked).alias("q"))


def _words(*tables: dict) -> str:
    """SQL of the terms of dictionaries, whose words ``q`` has, without those it has itself, sorted."""
    entries = ", ".join(f"{{'k': '{k}', 't': {terms}}}" for words in tables for k, terms in words.items())
    return f"list_sort(list_distinct(list_filter(flatten(list_transform(list_filter([{entries}], lambda e: contains(q, e.k)), lambda e: e.t)), lambda x: not contains(q, x))))"


_Q = f"from (select doc_id, {_TEXT} as q from documents where text is not null and doc_id is not null)"


@query("set13_expansion", f"select doc_id, {_words(c.TERMS)} as terms {_Q}")
def _(spark, sf):
    """Terms of statutes for the everyday words of each question, sorted."""
    return _questions(spark, sf).select("doc_id", F.array_sort(c.expand(F.col("q"))).alias("terms"))


@query("txt13_txt15_expand_law", f"select doc_id, case when {_ROW} = 3 then list_sort({_words(c.TERMS)} || {c.DATE_TERMS}) else {_words(c.TERMS)} end as terms {_Q}")
def _(spark, sf):
    """With terms of priority for the one question that asks what a missing fixed date means."""
    return _questions(spark, sf).select("doc_id", F.array_sort(c.expand_law(F.col("q"))).alias("terms"))


@query("txt14_expand_civil", f"select doc_id, {_words(c.TERMS, c.CIVIL_TERMS)} as terms {_Q}")
def _(spark, sf):
    """With the dictionary of civil law."""
    return _questions(spark, sf).select("doc_id", F.array_sort(c.expand_civil(F.col("q"))).alias("terms"))


def _by_hand(place: int) -> str:
    return "[" + ", ".join(f"{row[place]}::varchar[]" for row in ASKED) + f"][{_ROW}]"


@query("txt16_txt18_law_concepts", f"select doc_id, {_by_hand(1)} as concepts {_Q}")
def _(spark, sf):
    """Concepts of statutes, those of access where a record is to be looked up."""
    return _questions(spark, sf).select("doc_id", c.final_law_concepts(F.col("q")).alias("concepts"))


@query("txt17_txt19_civil_concepts", f"select doc_id, {_by_hand(2)} as concepts, md5(case when len({_by_hand(2)}) > 0 then q || chr(10) || '관련 검색 개념: ' || array_to_string({_by_hand(2)}, '; ') else q end) as asked {_Q}")
def _(spark, sf):
    """Concepts of civil law, and the question as vector search gets it, as a digest."""
    return _questions(spark, sf).select("doc_id", c.civil_concepts(F.col("q")).alias("concepts"), F.md5(c.dense_context_query(F.col("q"), True)).alias("asked"))

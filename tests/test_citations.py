"""The citation grammar on quoted, nested, joined and unresolved mentions, and spans that do not overlap."""

import pytest

from sparkloom.functions import citations as grammar
from sparkloom.operators import citations

EVIDENCE = "answer_id long, rank int, chunk_id string, doc_type string, citation string, text string, source_url string"


def kinds(text, titles=()):
    return [(m[0], text[m[1] : m[2]].strip(), *m[4:7]) for m in grammar.mentions({"text": text, "titles": list(titles)}) if m[0] in ("law", "article")]


@pytest.mark.parametrize("shape", ["{} {}", "**{} {}**", "**{}** **{}**", "__{}__ __{}__", "*{}* *{}*", "***{}*** ***{}***", "「{}」 **{}**"])
def test_emphasis_and_quotes_keep_offsets(shape):
    text = "근거: " + shape.format("민법", "제3조") + "에 따릅니다."
    (law,) = [m for m in grammar.mentions({"text": text, "titles": None}) if m[0] == "law"]
    assert law[4:7] == ("민법", 3, None) and "".join(c for c in text[law[1] : law[2]] if c not in "*_「」 ") == "민법제3조"
    assert len(grammar.view(text)) == len(text)


def test_names_leave_out_the_sentence_before_them():
    assert kinds("이 조문은 민법 제3조의2와 제4조, 및 주택임대차보호법 시행령 제 5 조.") == [("law", "이 조문은 민법 제3조의2", "민법", 3, 2), ("law", "및 주택임대차보호법 시행령 제 5 조", "주택임대차보호법시행령", 5, None), ("article", "제4조", "", 4, None)]
    assert kinds("제3항 민법 제7조") == [("law", "제3항 민법 제7조", "민법", 7, None)]
    assert kinds("법 제7조") == [("article", "제7조", "", 7, None)]
    far = "a " * 5000 + "민법 제7조"
    assert kinds(far)[0][2] == "aaaaa민법"


def test_only_the_evidence_title_is_hidden():
    title = {"name": "민법", "article": 255, "branch": None, "title": "(다른법제3조제5항관련)"}
    assert kinds("민법 제255조(다른법 제3조 제5항 관련)에", [title]) == [("law", "민법 제255조", "민법", 255, None)]
    for text in ("민법 제255조(다른법 제3조 제5항 관련 수정)", "민법 제255조. (다른법 제3조 제5항 관련)", "민법 제254조(다른법 제3조 제5항 관련)", "민법 제255조(다른법 제3조 제5항 관련", "민법 제255조(다른법 제3조 제5항 관련) 및 다른법 제3조"):
        assert any(k[2:4] == ("다른법", 3) for k in kinds(text, [title])), text


@pytest.mark.parametrize(
    "text, found",
    [
        ("국세청과 HUG의 안내에 따르면 된다.", ["국세청", "주택도시보증공사"]),
        ("국세청에서 제공하는 안내자료를 근거로", ["국세청"]),
        ("국세청에서 신청하고 안내를 받으세요", []),
        ("국세청 안내서를 받으세요", []),
        ("대법원 안내에 따르면", []),
        ("NTS 안내; 시험위원회 방문", ["국세청"]),
        ("국세청장 안내", []),
        ("국세청. 안내에 따르면", []),
    ],
)
def test_agencies_count_as_sources_only(text, found):
    assert [m[2] for m in grammar.agencies(grammar.view(text))] == found


def test_labels_and_links():
    assert grammar.label_identity("민법 제255조(특례(다른법 제3조 관련))") == ("민법", 255, None)
    for label in ("민법 제255조(제목) 및 다른법 제3조", "민법 제255조(제목", "민법 제1조 민법 제2조", "제3조", ""):
        assert grammar.label_identity(label) is None and grammar.link_of(label, "law") == ""
    assert grammar.link_of("주택임대차보호법 제3조의2(대항력)", "law").startswith("https://www.law.go.kr/법령/%EC%A3%BC")
    assert "q=2020%EB%8B%A412" in grammar.link_of("대법원 2020다12 판결", "case")


def evidence(spark, rows):
    return spark.createDataFrame(rows, EVIDENCE)


def test_mentions_resolve_against_their_own_evidence(spark):
    answers = spark.createDataFrame([(1, "민법 제3조와 구민법 제3조, 또 민법 제3조. 대법원 2020다12, 2021나5 판결. 다른법 제9조."), (2, "민법 제3조."), (3, None), (4, "")], "answer_id long, text string")
    rows = [
        (1, 1, "b", "law", "민법 제3조", "민법 제9조에", None),
        (1, 2, "a", "law", "민법 제3조(제목)", "", None),
        (1, 3, "c", "case", "서울고등법원 2020다12", "", None),
        (1, 4, "d", "case", "", "본문의 2021나5", None),
        (1, 5, "e", None, None, None, None),
        (3, 1, "f", "law", "민법 제3조", "", None),
    ]
    got = {(r.answer_id, r.kind, r.text): (r.supported, r.chunk_ids) for r in citations.citation_mentions(answers, evidence(spark, rows)).collect()}
    assert got == {
        (1, "law", "민법 제3조"): (True, ["a", "b"]),
        (1, "law", "다른법 제9조"): (False, []),
        (1, "case", "대법원 2020다12"): (False, []),
        (1, "case", "2021나5"): (True, ["d"]),
        (2, "law", "민법 제3조"): (False, []),
    }


def test_spans_do_not_overlap_and_fall_back_to_nothing(spark):
    text = "민법 제3조, 제5조와 다른법 제3조, 제8조. 2020다12 판결."
    answers = spark.createDataFrame([(1, text), (2, text)], "answer_id long, text string")
    rows = [
        (1, 2, "late", "law", "민법 제3조", "둘째", None),
        (1, 1, "first", "law", "민법 제3조", "① 본문. 민법 규정. " + "긴 글 " * 100, "https://own"),
        (1, 3, "five", "law", "상법 제5조", "상법 문장", ""),
        (1, 4, "eight", "law", "상법 제8조", "x", None),
        (1, 5, "eight2", "law", "세법 제8조", "x", None),
        (1, 6, "case", "case", "대법원 2020다12 판결", "", None),
        (2, 1, "blank", "law", "민법 제3조", " \n ", None),
    ]
    got = sorted(citations.citation_spans(answers, evidence(spark, rows)).collect(), key=lambda r: r.start_offset)
    assert [(r.answer_id, text[r.start_offset : r.end_offset], r.chunk_id, r.excerpt) for r in got] == [(1, "민법 제3조", "first", "민법 규정."), (1, "제5조", "five", "상법 문장"), (1, "2020다12", "case", "")]
    assert got[0].url == "https://own" and got[0].current_url.startswith("https://www.law") and got[1].url == got[1].current_url
    assert all(a.end_offset <= b.start_offset for a, b in zip(got, got[1:], strict=False))


def test_each_document_is_resolved_by_itself_and_in_one_pass(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(i % 60, f"text {i} " + "한 글자 word. " * (i % 3 * 2000)) for i in range(120)] + [(60, None), (None, "no key")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["str31_citation_spans"](spark, str(tmp_path))
    want = c.sql(entry.oracle_sql()["str31_citation_spans"]).select(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_excerpts_are_cut_at_borders():
    text = "첫 문장.\u2003둘째 문장 단어\n셋째 단어 문장① 넷째. 단어.단어 문장 " + "길다 " * 60
    assert grammar.excerpt(text, "단어 문장") == "둘째 문장 단어"
    assert grammar.excerpt(text, "넷째") == "① 넷째." and grammar.excerpt(text, "없는 말") == "첫 문장." and grammar.excerpt(" \n", "단어") == ""
    assert grammar.excerpt(text, "길다") == ("단어.단어 문장 " + "길다 " * 60)[:160].rstrip() + "…"

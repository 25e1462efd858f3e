"""Numbered units, packed lines, overlapping windows and stitching: round trips, examples, faults."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import structure
from sparkloom.operators import folds

PIECES = ["① ", "㉑ ", "㊿", "1. ", "12. ", "가. ", "나. ", "하.", " ", "\t", "\n", "\r\n", "words", "제3조", "2025. 1. 1.", "\x85", "𝒳"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_units_lose_nothing_and_parents_come_first(text):
    root, *rest = structure.units(text)
    assert root[7] == text and "".join(u[7] for u in rest) == text
    seen = {"root": 0}
    for k, u in enumerate(rest, 1):
        assert u[4] == k and text[u[5] : u[6]] == u[7] and u[1] in seen
        seen[u[0]] = k


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_packed_lines_keep_every_line_whole(text, target):
    lines = [x for x in (y.strip() for y in text.splitlines()) if x]
    chunks = list(structure.packed(text, target))
    assert [k for k, _ in chunks] == list(range(len(chunks)))
    assert "\n".join(c for _, c in chunks) == ("\n".join(lines) if lines else text.strip())
    for (_, a), (_, b) in zip(chunks, chunks[1:], strict=False):
        first = b.split("\n")[0]
        assert len(a.replace("\n", "")) + len(first) > target
        assert len(a.replace("\n", "")) <= target or "\n" not in a


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_windows_cover_and_break_at_lines(text):
    got = list(structure.windows(text, 12, 6, 3))
    assert ("".join(body[max(0, (got[k - 1][2] - s) if k else 0) :] for k, s, _, body in got)) == text
    for k, s, e, body in got:
        assert text[s:e] == body and e - s <= 12
        if e < len(text) and "\n" in text[s + 6 : e]:
            assert body.endswith("\n") and e - s > 6
        if k:
            assert s == max(got[k - 1][1] + 1, got[k - 1][2] - 3)


def test_a_new_paragraph_closes_open_items():
    got = [(u[2], u[3], u[1]) for u in structure.units("① a\n1. b\n가. c\n② d\n가. orphan\n3. item\nno. text")]
    assert got == [("article", "", None), ("paragraph", "1", "root"), ("item", "1", "u1"), ("subitem", "가", "u2"), ("paragraph", "2", "root"), ("text", "", "root"), ("item", "3", "u4")]
    assert [u[2] for u in structure.units("2025. 1. 1. is no item? it is")] == ["article", "text"]
    assert [u[2] for u in structure.units("")] == ["article", "text"]


def test_rows_fold_alone(spark):
    rows = [(1, "a", "① x\n1. y"), (1, "a", "① x\n1. y"), (None, "b", None), (2, None, ""), (3, "c", "line\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, unit_key2 string, text string")
    got = folds.structure_units(df, ["doc_id", "unit_key2"]).groupBy("doc_id", "unit_key2").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, "a", 6), (2, None, 2), (3, "c", 2)}
    packed = folds.packed_lines(df, ["doc_id"], target=50).where("doc_id = 3").agg(F.sum(F.length(F.regexp_replace("body", "\n", "")))).first()[0]
    assert packed == 12000
    assert folds.window_rows(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="overlap < least < size"):
        folds.window_rows(df, ["doc_id"], size=10, least=5, overlap=7)


def test_windows_are_stitched_and_faults_named(spark):
    dice = random.Random(1)
    texts = {k: "".join(dice.choice("ab\nc") for _ in range(dice.randrange(1, 400))) for k in range(30)}
    docs = spark.createDataFrame([(k, x) for k, x in texts.items()], "doc_id long, text string")
    rows = folds.window_rows(docs, ["doc_id"], size=40, least=20, overlap=8).withColumn("source", F.lit("one"))
    got = {r.doc_id: r for r in folds.stitch(rows.union(rows.where("chunk_index % 3 = 1")), ["doc_id"], ["source"]).collect()}
    assert all(got[k].body == x and got[k].source_start == 0 and got[k].source_end == len(x) and got[k].fault is None for k, x in texts.items())

    def fault(changed):
        return {r.doc_id: (r.fault, r.body is None) for r in folds.stitch(changed, ["doc_id"], ["source"]).collect()}

    long_ = [k for k, x in texts.items() if len(x) > 120]
    second = F.col("chunk_index") == 1
    assert {fault(rows.where(~second))[k] for k in long_} == {("gap", True)}
    swapped = F.translate("body", "abc", "bca")
    assert {fault(rows.withColumn("body", F.when(second, swapped).otherwise(F.col("body"))))[k] for k in long_} == {("overlap", True)}
    assert {fault(rows.withColumn("body", F.when(second, F.concat("body", F.lit("x"))).otherwise(F.col("body"))))[k] for k in long_} == {("length", True)}
    assert {fault(rows.withColumn("source", F.when(second, "two").otherwise(F.col("source"))))[k] for k in long_} == {("identity", True)}

"""Operators on small literal inputs, and registered queries against their SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import audit, fusion, lexical, merge, metrics
from sparkloom.operators.predicates import matches
from sparkloom.streaming import dialogue

SF = "/root/testdata/sf0.001"


def test_tokenizer(spark):
    row = spark.createDataFrame([("제3조의2 확정일자 abc 12 漢字",), ("",), (None,)], "t string").select(tx.tokenize(F.col("t")).alias("x")).collect()
    assert row[0].x == ["§제3조의2", "제", "3", "조의", "2", "확정일자", "확정", "정일", "일자", "abc", "ab", "bc", "12", "漢字"]
    assert row[1].x == [] and row[2].x == []


def test_masks_keep_order_and_borders(spark):
    texts = ["900101-1234567", "1900101-12345678", "010-1234-5678", "110-123-456789", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.mask_sensitive(F.col("t"))).collect()]
    assert got == ["900101-1******", "1900101-12345678", "010-****-5678", "****-****-****", "nothing"]


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, s string")
    ids = lambda w: [r.i for r in df.where(matches(w)).orderBy("i").collect()]
    assert ids({"s": "a"}) == [1] and ids({"s": {"$ne": "a"}}) == [2, 3] and ids({"s": {"$nin": ["a"]}}) == [2, 3]
    assert ids({"s": {"$in": ["a", "b"]}}) == [1, 2] and ids({"$or": [{"s": "b"}, {"s": None}]}) == [2, 3] and ids(None) == [1, 2, 3]


def test_ties_go_by_id_and_depth_joins_members(spark):
    scores = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 9, 2.0)], "qid long, id long, score double")
    assert [r.id for r in lexical.top_k(scores.repartition(5), 2).orderBy("rank").collect()] == [9, 3]
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "qid long, id long, rank int")
    got = fusion.reciprocal_rank_fusion([(a, 1.0), (b, 1.0)], 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(20, round(1 / 7 + 1 / 6, 9)), (10, round(1 / 6, 9)), (30, round(1 / 7, 9))]


def test_bands_reset_at_their_anchor(spark):
    rows = [(1, 1, 1.0, 1, 3, 0), (1, 2, 0.98, 2, 0, 0), (1, 3, 0.96, 3, 0, 5), (1, 4, 0.95, 4, 0, 9)]
    got = fusion.band_rerank(spark.createDataFrame(rows, "qid long, id long, score double, rank int, level int, day long"), 4).orderBy("place").collect()
    assert [(r.id, r.band) for r in got] == [(2, 1), (1, 1), (4, 2), (3, 2)]


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["c", "c", "z"]), (["a"], []), ([], ["a"])], "r array<string>, g array<string>")
    got = df.select(metrics.hit_at(F.col("r"), F.col("g"), 2).alias("h"), metrics.recall_at(F.col("r"), F.col("g"), 3).alias("c"), metrics.reciprocal_rank(F.col("r"), F.col("g")).alias("m")).collect()
    assert [(r.h, r.c, round(r.m, 4)) for r in got] == [(False, 0.5, 0.3333), (False, 0.0, 0.0), (False, 0.0, 0.0)]


def test_digest_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, s string")
    assert audit.digest(df).collect() == audit.digest(df.orderBy(F.desc("i")).repartition(3)).collect()
    assert audit.digest(df).first().digest != audit.digest(df.fillna("")).first().digest


def test_merge_prunes_touched_scopes_only(spark):
    old = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, kind string")
    new = spark.createDataFrame([(1, "x"), (4, "x")], "id int, kind string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(merge.scoped_merge(old, new, "id", "kind")) == [1, 3, 4]
    assert ids(merge.scoped_merge(old, new, "id", "kind", prune_all=True)) == [1, 4]
    assert ids(merge.scoped_merge(old, new.limit(0), "id", "kind", prune_all=True)) == [1, 2, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 12").select("conv_id", "turn", "role", "text")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    asked = dialogue.stream_conversations(stream).writeStream.outputMode("update").format("memory").queryName("talks").option("checkpointLocation", str(tmp_path / "c")).start()
    asked.processAllAvailable()
    asked.stop()
    got = {r.conv_id: (r.turns, r.epoch, r.last_user, r.history) for r in spark.table("talks").collect()}
    want = {r.conv_id: (r.turns, r.epoch, r.last_user, r.history) for r in dialogue.fold_conversations(rows).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["txt03_bm25_search", "rnk06_band_rerank", "join07_reconcile", "mrg01_snk07_scoped_merge", "stm01_dialogue_state"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = c.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: list(v) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v
    rows = lambda rs: sorted(repr([plain(v) for v in r]) for r in rs)
    assert rows(got.select(*cols).collect()) == rows(want.select(", ".join(cols)).fetchall())


@pytest.mark.parametrize(
    "name",
    [
        "str07_structure_units", "str07_lossless_units", "str08_packed_lines", "str09_overlapping_windows", "txt30_stitched_windows", "str29_citation_mentions", "str31_citation_spans",
        "mrg07_applied_changes", "mrg07_closure_replacement", "mrg10_plan_faults", "src11_strict_json", "src13_snk06_verified_release", "mrg12_active_release", "mrg13_promoted_release",
        "dat08_num01_values", "rul07_unsupported_values", "rnk21_cover_query", "txt20_date_record_requests", "stm13_clarifications", "stm03_invalidated_documents", "set13_expansion",
        "txt13_txt15_expand_law", "txt14_expand_civil", "txt16_txt18_law_concepts", "txt17_txt19_civil_concepts", "agg27_digest", "agg28_agg29_index_content_hash", "mrg11_verify_digests",
        "join27_align", "flt03_query_dependent_exclusion", "flt07_guarded_exclusion", "str04_extract_body", "rnk23_first_pages", "jsn02_digest",
    ],
)
def test_more_queries_match_sql(spark, name):
    test_queries_match_sql(spark, name)


@pytest.mark.parametrize("name", ["prj06_prj07_prj08_chunk_fields", "txt32_prompt_context", "prj01_evidence"])
def test_whole_texts_match_sql(spark, name):
    test_queries_match_sql(spark, name)


def test_coded_corpus_has_the_terms_of_the_tokeniser(spark):
    texts = ["제3조의2 확정일자 abc 12 漢字 abc", "", None, "제12조제3항과 제4조 Ｆ ABCdef123나다라", "ab " * 500 + "é漢字漢字漢字", "x\u0663 조의"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = docs.select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("t")).groupBy("doc_id", lexical.code(F.col("t")).alias("term")).agg(F.count("*").alias("tf"))
    corpus = lexical.index(docs).rows
    coded = corpus.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("id", "t.terms", "t.tfs")
    assert sorted(map(tuple, coded.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.id: r.dl for r in corpus.collect()} == {r.doc_id: r.n for r in docs.select("doc_id", F.size(tx.tokenize(F.col("text"))).alias("n")).collect()}


def test_windows_of_texts_of_any_length(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["", "short", "x" * 80, "abcdé" * 37, "long text " * 2000]
    spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)] + [(9, "y" * 3000, None)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.equal for r in entry.queries()["txt30_whole_windows"](spark, str(tmp_path)).collect()}
    assert got == {k: True for k in (0, 1, 2, 3, 4, 9)}


def test_concepts_of_nothing(spark):
    from sparkloom.functions import concepts

    row = spark.createDataFrame([(None,), ("",)], "q string").select(concepts.expand(F.col("q")).alias("a"), concepts.expand_civil(F.col("q")).alias("b"), concepts.final_law_concepts(F.col("q")).alias("c"), concepts.civil_concepts(F.col("q")).alias("d"), concepts.dense_context_query(F.col("q"), False).alias("e")).collect()
    assert tuple(row[0]) == (None,) * 5 and tuple(row[1]) == ([], [], [], [], "")


def _exclusions(spark, path, name):
    """Rows of an exclusion query over five documents (ids from 100 on, one without a source) and three questions (one without a text)."""
    import __spark_entry__ as entry

    spark.createDataFrame([(100, "src1"), (101, "src2"), (102, "src5"), (103, None), (104, "src3")], "doc_id long, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "the kind of"), (1, "plain"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {(r.item_id, r.doc_id, r.excluded) for r in entry.queries()[name](spark, str(path)).collect()}


def test_each_question_decides_on_each_document(spark, tmp_path):
    want = {(q, d, q > 0 and d in (100, 102)) for q in range(3) for d in range(100, 105)}
    assert _exclusions(spark, tmp_path, "flt03_query_dependent_exclusion") == want


def test_guarded_questions_decide_on_each_document(spark, tmp_path):
    want = {(q, d, q > 0 and d == 101) for q in range(3) for d in range(100, 105)}
    assert _exclusions(spark, tmp_path, "flt07_guarded_exclusion") == want


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1


def test_index_hash_frames_records_and_checks_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, v array<float>")
    hash_of = lambda rows: audit.index_hash(make(rows), F.col("id"), "v", 2).first().digest
    rows = [("a", [0.1, 2.0]), ("b", [3.0, -0.5])]
    assert hash_of(rows) == hash_of(rows[::-1]) != hash_of(rows + rows[:1])
    assert len({hash_of(r) for r in (rows, [("a0", [1.0, 2.0]), rows[1]], [("a", [0.1, 2.0000002])] + rows[1:], [("b", rows[0][1]), ("a", rows[1][1])])}) == 4
    for bad in (None, [1.0], [1.0, float("nan")], [1.0, float("inf")], [1.0, None]):
        with pytest.raises(Exception, match="vectors need 2 finite components"):
            hash_of([*rows, ("c", bad)])


def test_align_refuses_other_keys(spark):
    make = lambda *keys: spark.createDataFrame([(k, str(k)) for k in keys], "k long, v string")
    assert {(r.k, r.place) for r in audit.align(make(3, 1, 2), make(2, 3, 1).withColumn("o", -F.col("k")), "k", ["o"]).collect()} == {(3, 0), (2, 1), (1, 2)}
    for rows, reference, message in ((make(1, 1), make(1), "1: twice in the rows"), (make(1), make(1, 2, 2), "2: twice in the reference"), (make(1, 4), make(1), "4: not in the reference"), (make(1), make(1, 5), "5: not in the rows")):
        with pytest.raises(ValueError, match=message):
            audit.align(rows, reference, "k", ["k"])


def test_notice_bodies(spark):
    def body(*lines):
        df = spark.createDataFrame([(list(lines),)], "lines array<string>")
        r = df.select(tx.notice_body(F.col("lines"), "start", ["end", "stop"], "date", ["noise"], 6).alias("f")).first().f
        return r.body, r.published

    assert body("menu", "start end", "text one", "abc", "date 2024. 3. 9.", "noise 12", "the end", "tail") == ("start end\ntext one\ndate 2024. 3. 9.", "2024-03-09")
    assert body("start", "date", "x 2024-10-11 y", "more") == ("start\ndate\nx 2024-10-11 y\nmore", "2024-10-11")
    assert body("start", "date", "nothing", "2024-10-11", "5555", "6666", "7777") == ("start\ndate\nnothing\n2024-10-11\n5555\n6666", "")
    assert body("menu", "the end") == ("", "") and body() == ("", "")


def test_index_hash_rounds_halves_as_sql_does(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    vector = [k / 1024 for k in range(101, 225, 2)] + [-0.1494140625, -0.0]
    spark.createDataFrame([(1, vector, 3), (2, [float(k) for k in range(64)], None), (None, [2.0**-k for k in range(64)], 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "agg28_agg29_index_content_hash"
    assert [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select("n", "digest").collect()] == c.sql(entry.oracle_sql()[name]).fetchall()


def test_nearest_vectors_in_blocks_equal_all_pairs(spark, monkeypatch):
    import random

    from sparkloom.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "CHUNK", 7)
    draw = random.Random(3)
    rows = [(i, [draw.choice((-1.0, 0.5, 0.25, draw.random())) for _ in range(draw.choice((3, 3, 3, 4)))]) for i in range(900)]
    rows += [(i, [0.1, 0.2, 0.3]) for i in range(900, 960)] + [(960, None), (961, [0.1, None, 0.3]), (970, [0.0] * 3), (None, [1.0] * 3), (980, []), (20, [0.5, 0.5, 0.5])]
    v = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    asks = v.where("id % 10 = 0")
    scored = v.join(asks.select(F.col("id").alias("qid"), F.col("vector").alias("q")), F.col("id") != F.col("qid")).select("qid", "id", F.round(lexical.cosine(F.col("q"), F.col("vector")), 6).alias("score")).where("score > 0")
    want = lexical.top_k(scored, 20)
    assert sorted(map(tuple, vectors.nearest(v, asks, 20).collect())) == sorted(map(tuple, want.collect()))


def test_dense_search_has_no_fold_for_each_pair(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["txt07_dense_search"](spark, SF)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_optional_keys_are_joined_by_equality_alone(spark, tmp_path, monkeypatch):
    import duckdb

    import __spark_entry__ as entry
    from sparkloom.plans import star

    monkeypatch.setattr(star, "PAIRS", 40)
    monkeypatch.setattr(star, "SENT", 20)
    cents = [-1500.0, -1.0, 0.0, 999.99, 1000.0, 1999.0, None, 7000.5]
    spark.createDataFrame([(i, i % 3 if i % 11 else None, cents[i % 8], ("A b", "--", None, "x")[i % 5 % 4]) for i in range(200)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, i % 4 if i % 7 else None, cents[i * 5 % 8]) for i in range(70)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    c = duckdb.connect()
    for name in ("customer", "supplier"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = entry.queries()["join22_optional_key_match"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(entry.oracle_sql()["join22_optional_key_match"]).fetchall())
    assert " OR " not in got._jdf.queryExecution().optimizedPlan().toString()

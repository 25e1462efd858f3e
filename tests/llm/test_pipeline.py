"""Stages of the corpus pipeline against plain versions, on null ids, shared ids, repeated rows, empty tables and clashing names."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import decontaminate, html_text, kneser_ney, mixing, parity_join, sharding

from .test_rows import plain_sets, plain_targets, union

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, mark long, at string"


def say(tag, n=60):
    return " ".join(f"{tag}{k}" for k in range(n))


ROWS = [
    (1, say("a"), "s"), (2, say("b"), "s"), (5, say("b"), "s"), (5, say("c"), "s"), (9, say("d"), "t"), (9, say("e"), "t"),
    (None, say("f"), "t"), (7, say("f") + " tail", None), (None, say("g"), None), (None, say("g"), None), (11, None, "s"), (12, "", "s"), (12, "", "s"),
    (13, say("h"), "t"), (13, say("h"), "t"), (14, "two words", "t"), (None, None, "s"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x") for i, t, s in ROWS], SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    items = [(1, f"{say('q', 20)}. {say('r', 8)}."), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 0), (14, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_near_duplicates_keep_one_row_a_group(spark, docs, folder):
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns
    sets = plain_sets([(i, t) for i, t, _ in ROWS], 5)
    links = [(a, b) for a in range(len(ROWS)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = union(range(len(ROWS)), links)
    kept = rows_of(got)
    for root in set(groups.values()):
        members = [ROWS[k] for k in range(len(ROWS)) if groups[k] == root]
        assert sum(kept[m] for m in set(members)) == (1 if sets[root] else ROWS.count(members[0]))
        ids = [i for i, *_ in members if i is not None]
        if sets[root] and ids:
            assert any(kept[m] for m in members if m[0] == min(ids))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_null_id_is_a_bridge(spark):
    base = say("z", 100).split()
    near = [*base[:97], "x1", "x2", "x3"]
    far = ["y1", "y2", "y3", *near[3:]]
    df = spark.createDataFrame([(1, " ".join(base)), (None, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    sets = plain_sets([(0, r.text) for r in df.collect()], 4)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    bar = math.floor(100 * min(share(0, 1), share(1, 2)))
    assert share(0, 2) * 100 < bar
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(df, 4, bar).collect()}
    assert got == {1: 1, None: 1, 3: 1}


def test_leaks_go_whatever_their_id(spark, docs, folder):
    leak = f"{say('q', 20)} {say('r', 8)}"
    more = docs.limit(1).select(F.explode(F.array(F.lit(None).cast("long"), F.lit(1), F.lit(7))).alias("doc_id"), F.lit(leak).alias("text"), *[c for c in SCHEMA_NAMES if c not in ("doc_id", "text")])
    got = rows_of(corpus_pipeline.decontaminated(spark, docs.unionByName(more), folder))
    assert got == rows_of(docs)
    assert corpus_pipeline.decontaminated(spark, docs.limit(0), folder).count() == 0


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_quality_judges_rows(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = kneser_ney.judge_quality(docs, labels)
    want = Counter(r.doc_id for r in judged.where("keep").collect())
    got = corpus_pipeline.quality(spark, docs, folder)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert corpus_pipeline.quality(spark, docs.limit(0), folder).count() == 0


def test_mixture_repeats_rows(spark, docs, folder):
    got = corpus_pipeline.mixture(spark, docs, folder)
    taken = rows_of(got)
    words = Counter()
    for (_, t, s), n in taken.items():
        words[s] += n * len((t or "").split())
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    for s, target in plain_targets(sizes).items():
        assert abs(words[s] - target) <= 61
    plain = Counter()
    for r in mixing.mix_sources(docs).collect():
        plain[r.doc_id] += r.copies if r.size else 0
    assert sum(plain.values()) == sum(taken.values())
    assert corpus_pipeline.mixture(spark, docs.limit(0), folder).count() == 0


def test_hot_equal_rows_are_shared(spark):
    df = spark.createDataFrame([(None, "a b c", "z")] * 300 + [(k, "w " * 9, "y") for k in range(30)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 9 for r in got)
    assert mixing.take_copies(df).count() == mixing.mix_sources(df).agg(F.sum("copies")).first()[0]


def test_shards_keep_other_columns(spark, docs, folder):
    got = corpus_pipeline.shards(spark, docs.withColumn("_slot", F.lit(3)).withColumn("there", F.lit(4)), folder)
    assert got.columns == [*docs.columns, "_slot", "there", "slot", "shard"] and got.count() == len(ROWS)
    table = sharding.fill_table(corpus_pipeline.SHARDS, 65537)
    assert all(r.shard == table[r.slot] for r in got.collect())


def test_run_applies_all_stages(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert set(docs.columns) < set(got.columns) and {r.text for r in got.collect()} <= {t for _, t, _ in ROWS}


def test_search_equals_plain_bm25():
    import numpy as np

    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"t{int(k)}" for k in rng.zipf(1.2, n) % 700)
    items = [(i, f"{text(20)}. {text(8)}.") for i in range(150)]
    df = Counter(t for _, x in items for t in set(decontaminate.words_of(x)))
    lengths = [len(decontaminate.words_of(x)) for _, x in items]
    mean = sum(lengths) / len(lengths)
    docs = [decontaminate.words_of(f"{text(300)} {items[k][1]} {text(100)}") for k in range(20)] + [[]]
    found = []
    for part in (items, items[:70], items[70:]):
        own = {t: df[t] for _, x in part for t in decontaminate.words_of(x)}
        found.append({k: sorted(s for s, *_ in v) for k, v in decontaminate.Index(part, own, len(items), mean, 0.5, 64).search(docs).items()})
    want = {}
    for i, x in items:
        bag = Counter(decontaminate.words_of(x))
        raw = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * sum(bag.values()) / mean)) for t, f in bag.items()}
        for d, words in enumerate(docs):
            for p in range(max(1, -(-len(words) // 64))):
                score = sum(raw[t] for t in raw.keys() & set(words[p * 64 : p * 64 + 128])) / sum(raw.values())
                if score >= 0.5:
                    want.setdefault((d, i), []).append(score)
    for got in (found[0], found[1] | found[2]):
        assert got.keys() == want.keys()
        assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], sorted(want[k]), strict=True))


def test_ratios_choose_lines(monkeypatch):
    skip = "<article><h1>T</h1><p class=ad>buy<p>real content here</article>"
    assert html_text.main_text(skip) == "T\n\nreal content here"
    named = "<article class='related-work'><p id='notice-of-motion'>one two</p></article><article><p>three four</p></article>"
    assert html_text.main_text(named) == "one two\n\nthree four"
    links = "<article><p>" + "word " * 30 + "</p><ul><li>a</li></ul><ul><li><a href=x>Home page</a></li></ul></article>"
    assert html_text.main_text(links).split("\n\n")[1:] == ["a"]
    monkeypatch.setattr(html_text, "levels", lambda lines, sigma: __import__("numpy").zeros(len(lines)))
    assert html_text.main_text(named) == ""

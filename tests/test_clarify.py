"""Clarifying questions: the window form, the fold and the stream agree, with late and repeated turns."""

import random

from sparkloom.streaming import clarify

FIELDS = ["end_date", "deposit", "role"]


def turns(seed, conversations=6, length=30):
    dice = random.Random(seed)
    rows = []
    for c in range(conversations):
        for k in range(length):
            facts = [(f, "v") for f in FIELDS if dice.random() < 0.08]
            rows.append((c, k, dice.random() < 0.1, dice.random() < 0.05, facts, dice.choice([*FIELDS, None])))
    return rows


def plain(rows, most=2):
    out = []
    for c in {r[0] for r in rows}:
        state = clarify.empty()
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            state, asked = clarify.step(state, {"topic_changed": r[2], "deleted": r[3], "facts": [{"field": f} for f, _ in r[4]], "ask": r[5]}, most)
            if asked:
                out.append((c, r[1], *asked))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, clarify.EVENT)


def test_windows_equal_the_fold(spark):
    rows = turns(1)
    noise = [(None, 1, True, False, [], "role"), (0, None, True, False, [], "role"), (0, 900, True, False, [("Bad Field", "v")], "role"), (0, 901, None, None, None, "UPPER"), (0, 902, True, False, [("role", " ")], None)]
    for most in (1, 2, 3):
        got = clarify.clarifications(frame(spark, rows + rows[:40] + noise), most).collect()
        assert sorted(tuple(r) for r in got) == plain(rows, most)
    assert clarify.clarifications(frame(spark, []).limit(0)).count() == 0


def test_a_field_is_asked_for_twice_a_topic():
    ask = lambda state, **more: clarify.step(state, {"topic_changed": False, "deleted": False, "facts": [], "ask": "role"} | more)
    state, got = clarify.empty(), []
    for more in ({}, {}, {}, {"topic_changed": True}, {"facts": [{"field": "role"}]}, {}, {"deleted": True}, {"ask": None}):
        state, asked = ask(state, **more)
        got.append(asked)
    assert got == [(0, "role", True, 1), (0, "role", True, 2), (0, "role", False, None), (1, "role", True, 1), (1, "role", False, None), (1, "role", False, None), (0, "role", True, 1), None]


def test_stream_with_late_and_repeated_turns(spark, tmp_path):
    rows = turns(2, 4, 16)
    mixed = rows + random.Random(5).sample(rows, 20)
    random.Random(6).shuffle(mixed)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            frame(spark, mixed[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(clarify.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        kept: dict = {}

        def keep(batch, _):
            kept.update({(r.conv_id, r.turn): tuple(r) for r in batch.collect()})

        asked = clarify.stream_clarifications(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).start()
        asked.processAllAvailable()
        asked.stop()
    finally:
        spark.conf.set(store, before)
    assert sorted(kept.values()) == plain(rows)


def test_states_go_with_their_document(spark):
    states = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "conv_id long, document_id string, text string")
    gone = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "document_id string")
    assert sorted(map(tuple, clarify.without_document(states, gone).collect())) == [(1, None, None), (2, "b", "y"), (3, None, "z")]

"""Releases: a changed byte, a missing file, an extra row are refused; pointers and promotions fail without a trace; strict JSON."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import releases, strict_json

SCHEMA = "id long, text string, note string"


@pytest.fixture
def release(spark, tmp_path):
    rows = spark.range(60).select("id", F.concat(F.lit("text é "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 7 == 0, "n").alias("note"))
    path = f"{tmp_path}/one"
    manifest = releases.export_release({"laws": (rows, ["id"]), "none": (rows.limit(0), ["id"])}, path, "base", "v1", tasks=3, rows=9)
    return path, manifest, rows


def parts(path):
    return sorted(os.path.join(path, "streams/laws", f) for f in os.listdir(f"{path}/streams/laws") if f.startswith("part-"))


def plain_write(file, data):
    os.remove(os.path.join(os.path.dirname(file), "." + os.path.basename(file) + ".crc"))
    with open(file, "wb") as out:
        out.write(data)


def test_round_trip_in_order(spark, release):
    path, manifest, rows = release
    assert manifest["streams"]["laws"]["count"] == 60 and manifest["streams"]["none"]["count"] == 0
    lines = [json.loads(line) for f in parts(path) for line in open(f, encoding="utf-8")]
    assert [x["id"] for x in lines] == list(range(60)) and all(set(x) == {"id", "text", "note"} for x in lines) and len(parts(path)) >= 7
    got = releases.read_release(spark, path, {"laws": SCHEMA, "none": SCHEMA}, "base")
    assert sorted(map(tuple, got["laws"].collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    assert got["none"].count() == 0
    for schemas, corpus, message in (({"laws": SCHEMA}, "base", "has streams"), ({"laws": SCHEMA, "none": SCHEMA}, "other", "of corpus base")):
        with pytest.raises(ValueError, match=message):
            releases.read_release(spark, path, schemas, corpus)


def test_never_overwritten_and_nothing_left_of_a_failure(spark, release, tmp_path):
    path, _, rows = release
    with pytest.raises(FileExistsError):
        releases.export_release({"laws": (rows, ["id"])}, path, "base", "v2")
    with pytest.raises(ValueError, match="names of streams"):
        releases.export_release({"a/b": (rows, ["id"])}, f"{tmp_path}/two", "base", "v2")
    with pytest.raises(Exception, match="boom"):
        releases.export_release({"laws": (rows.withColumn("text", F.raise_error(F.lit("boom"))), ["id"])}, f"{tmp_path}/two", "base", "v2")
    assert os.listdir(tmp_path) == ["one"]


def test_changed_missing_and_extra_are_refused(spark, release):
    path = release[0]
    file = parts(path)[1]
    data = open(file, "rb").read()

    def refused(message):
        with pytest.raises(ValueError, match=message):
            releases.verify_release(spark, path)

    plain_write(file, data.replace(b"text", b"tExt", 1))
    refused("a file was changed: laws/part-")
    with open(file, "wb") as out:
        out.write(data + b'{"id":99,"text":"x","note":null}\n')
    refused("a file was changed: laws/part-")
    os.remove(file)
    refused("a file is missing: laws/part-")
    with open(file, "wb") as out:
        out.write(data)
    assert releases.verify_release(spark, path)["version"] == "v1"
    extra = os.path.join(os.path.dirname(file), "part-99999-extra.json")
    with open(extra, "wb") as out:
        out.write(b'{"id":99,"text":"x","note":null}\n')
    refused("a file is not in the manifest: laws/part-99999")
    os.remove(extra)
    manifest = open(f"{path}/manifest.json", "rb").read()
    plain_write(f"{path}/manifest.json", manifest.replace(b'"count":60', b'"count":61'))
    refused("the manifest was changed")
    with pytest.raises(ValueError, match="no release at"):
        releases.verify_release(spark, path + "-absent")


def test_pointer_moves_in_one_step_or_not_at_all(spark, release, tmp_path):
    path, _, rows = release
    second, pointer = f"{tmp_path}/second", f"{tmp_path}/active.json"
    releases.export_release({"laws": (rows.where("id > 3"), ["id"])}, second, "base", "v2", tasks=2)
    with pytest.raises(ValueError, match="no active release"):
        releases.active_release(spark, pointer)
    releases.activate(spark, path, pointer)
    assert releases.active_release(spark, pointer).endswith("/one")
    releases.activate(spark, second, pointer)
    assert releases.active_release(spark, pointer).endswith("/second")
    file = parts(path)[0]
    plain_write(file, b"{}\n")
    with pytest.raises(ValueError, match="a file was changed"):
        releases.activate(spark, path, pointer)
    with pytest.raises(ValueError, match="outside of releases"):
        releases.activate(spark, second, f"{second}/active.json")
    assert releases.active_release(spark, pointer).endswith("/second")
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".active-") and not f.endswith(".crc")]
    plain_write(f"{second}/manifest.json", open(f"{second}/manifest.json", "rb").read().replace(b"v2", b"v3"))
    with pytest.raises(ValueError, match="changed"):
        releases.active_release(spark, pointer)


def test_failed_promotions_leave_the_old_release(spark, tmp_path):
    def tree(name, **files):
        for scope, text in files.items():
            os.makedirs(f"{tmp_path}/{name}/{scope}")
            with open(f"{tmp_path}/{name}/{scope}/data", "w") as out:
                out.write(text)
        return f"{tmp_path}/{name}"

    def state():
        return {scope: open(f"{live}/{scope}/data").read() for scope in sorted(os.listdir(live))}

    live = tree("live", db="old db", index="old index")
    releases.promote(spark, tree("new", db="new db", docs="new docs"), live, ["db", "docs"], f"{tmp_path}/run1")
    assert state() == {"db": "new db", "docs": "new docs", "index": "old index"}
    assert open(f"{tmp_path}/run1/backup/db/data").read() == "old db"
    with pytest.raises(FileNotFoundError, match="bad/index is not there"):  # after db and the old index were moved
        releases.promote(spark, tree("bad", db="third db"), live, ["db", "index"], f"{tmp_path}/run2")
    assert state() == {"db": "new db", "docs": "new docs", "index": "old index"}

    def refuse(target):
        assert open(f"{target}/db/data").read() == "fourth db"
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        releases.promote(spark, tree("worse", db="fourth db", more="m"), live, ["db", "more"], f"{tmp_path}/run3", refuse)
    assert state() == {"db": "new db", "docs": "new docs", "index": "old index"}
    assert open(f"{tmp_path}/run3/failed/db/data").read() == "fourth db"


@pytest.mark.parametrize(
    "line, fault",
    [
        ('{"a": 1, "b": {"a": 2}}', None),
        ('{"a": 1, "b": [{"c": 1, "c": 2}]}', "repeated key: c"),
        ('{"a": 1, "\\u0061": 2}', "repeated key: a"),
        ("[1]", "not an object"),
        ("12", "not an object"),
        ("", "blank line"),
        ("  ", "blank line"),
        ('{"a": }', "malformed: Expecting value at 6"),
        ('{"a": 1} x', "malformed: Extra data at 9"),
        ('{"a": 1} {"b": 2}', "malformed: Extra data at 9"),
        ('{"a": 1}] x [', "malformed: Extra data at 8"),
        ('{"a": 1}, "b": {"c": 2}', "malformed: Extra data at 8"),
        ('{"a": "{\\"b\\": 1, \\"b\\": 2}"}', None),
    ],
)
def test_reasons(spark, line, fault):
    assert strict_json.reason_of(line) == fault
    got = strict_json.line_faults(spark.createDataFrame([(line,)], "value string")).collect()
    assert [r.fault for r in got] == ([fault] if fault else [])


def test_line_numbers_over_blocks(spark, tmp_path):
    bad = {"a.jsonl": {700: '{"id": 1, "x": {"k": 1, "k": 2}}', 1500: "no json"}, "b.jsonl": {}, "c.jsonl": {3: ""}}
    for name, lines in bad.items():
        with open(tmp_path / name, "w") as out:
            for k in range(1, 2001):
                out.write(lines.get(k, json.dumps({"id": k, "text": "t" * 40, "extra": k})) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = strict_json.numbered_faults(spark, [str(tmp_path)])
        assert [(f.rsplit("/", 1)[1], n, why.split(":")[0]) for f, n, why in got] == [("a.jsonl", 700, "repeated key"), ("a.jsonl", 1500, "malformed"), ("c.jsonl", 3, "blank line")]
        with pytest.raises(ValueError, match=r"a.jsonl:700: repeated key: k"):
            strict_json.read_strict(spark, [str(tmp_path)], "id long")
        assert strict_json.read_strict(spark, [str(tmp_path / "b.jsonl")], "id long, absent string").agg(F.sum("id"), F.count("absent")).first() == (2001000, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

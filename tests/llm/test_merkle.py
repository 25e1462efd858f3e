"""The Merkle manifest and its radix ranks against plain versions."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from sparkloom.llm import merkle
from sparkloom.operators.shared import settle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, rank int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r):
    return sha(*[frame(v) for v in (r[0], r[3], r[2], r[4], r[1])])


def climb(nodes):
    """Each node's siblings, level by level, and the last node."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for p, at in zip(paths, where, strict=True):
            own = runs[at // 8]
            p.append(("".join(own[: at % 8]), "".join(own[at % 8 + 1 :])))
        nodes, where = [sha(*run) for run in runs], [at // 8 for at in where]
    return paths, nodes[0]


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (own, *climb([leaf_of(r) for r in own]))
    over, root = climb([trees[x][2] for x in langs])
    out = []
    for lang, high in zip(langs, over, strict=True):
        own, paths, subroot = trees[lang]
        for r, path in zip(own, paths, strict=True):
            now = leaf_of(r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf_of((r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:]))
            for left, right in path + high:
                now = sha(left, now, right)
            out.append((r[0], leaf_of(r), subroot, root, sha(*[a + b for a, b in path + high]), now, now == root))
    return out


def rows_of(n, seed=3):
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        lang = dice.choice(["en"] * 6 + ["de", "", None, "é", "zz"])
        text = dice.choice([None, "", "Plain Text", "no capitals", "Ünïcode ÄB " * 3, "A long TEXT " * 2000])
        rows.append((dice.choice([k, k, k, k - 2**62, 7]), text, lang, dice.choice([None, "web"]), dice.choice([None, k]), "clash", 5))
    return rows + [(None, "X", "en", None, None, None, None)] * 3 + [(11, "Copy", "en", "web", 4, "h", 1)] * 40 + [(-(2**63), "Lo", "lone", None, 1, "", 0), (2**63 - 1, "Hi", "en", None, 1, "", 0)]


def compare(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain([r[:5] for r in rows])))


def test_manifest_of_odd_rows(spark):
    compare(spark, rows_of(700))


def test_manifest_of_few_rows(spark):
    compare(spark, [(1, "One", "en", None, None, None, None)])
    compare(spark, [(k, "One", "en", None, None, None, None) for k in range(9)])
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(k, "Some Words" if k % 2 else "some words", "en", None, None, None, None) for k in range(120)], SCHEMA)
    for r in merkle.manifest(docs).collect():
        assert r.verified == (r.doc_id % 2 == 0 or zlib.crc32(str(r.doc_id).encode()) % 3 != 0)


def test_ranks_split_hot_ids(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") * 1000003 - 10**9).alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tree"), F.col("id").alias("tie"))
    got = merkle.radix_ranks(settle(rows), "tree", F.concat(merkle.digits_of(F.col("doc_id")), merkle.digits_of(F.col("tie"))), bucket=7).collect()
    assert len(got) == 3000
    for tree in "ab":
        own = sorted((r for r in got if r.tree == tree), key=lambda r: (r.doc_id, r.tie))
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}


def test_more_than_one_step(spark):
    compare(spark, [(k, f"Text {k}", "en" if k % 3 else "de", None, k, None, None) for k in range(1700)])

"""Vector codes against plain k-means with whole searches."""

import hashlib
import math
import random

import numpy as np

from sparkloom.llm import product_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def plain(rows):
    """Rows are (vec_id, embedding, label): the same codes by comparing each part with all entries."""

    def sound(v):
        return v and len(v) % 16 == 0 and all(c is not None and math.isfinite(c) for c in v)

    kept = sorted((r for r in rows if sound(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if kept:
        kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // 16
    whole = [[math.floor(256 * float(np.float32(c))) for c in r[1]] for r in kept]
    parts = [[w[p * width : (p + 1) * width] for p in range(16)] for w in whole]
    books = [[v[p] for v in parts[:64]] for p in range(16)]

    def find(p, at):
        return min((sum((a - b) ** 2 for a, b in zip(at, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        took = [[[] for _ in books[p]] for p in range(16)]
        for v in parts:
            for p in range(16):
                took[p][find(p, v[p])[1]].append(v[p])
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[p][k] for k, own in enumerate(took[p])] for p in range(16)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[find(p, v[p]) for p in range(16)] for v in parts]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors, strict=True)]


def compare(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in product_codes.encode_vectors(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))
    return got


def test_codes_with_odd_rows(spark):
    dice = random.Random(5)
    rows = []
    for k in range(260):
        v = [dice.choice([-0.5, -0.25, 0.0, 0.125, 0.5, dice.gauss(0, 1)]) for _ in range(32)]
        rows.append((dice.choice([k, k, 9, None]), v, dice.choice([1, 1, 1, 2, None])))
    rows += [(500, None, 1), (501, [0.1] * 31 + [None], 1), (502, [float("nan")] * 32, 2), (503, [float("inf")] * 32, 2), (504, [], 1), (505, [1.0] * 16, 1), (506, [1.0] * 20, 1)]
    rows += [rows[3]] * 30 + [(507, [0.0] * 32, None), (508, [-0.0] * 32, None)]
    assert len(compare(spark, rows)) > 280


def test_few_rows_and_none(spark):
    compare(spark, [(2, [0.3] * 16, 1), (1, [0.3] * 16, None)])
    empty = product_codes.encode_vectors(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_huge_components_stay_in_range(spark):
    rows = [(k, [3e38 if k % 2 else -3e38] * 64, 1, "", 0) for k in range(4)]
    got = product_codes.encode_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.error for r in got} == {0} and len({r.code for r in got}) == 2


def test_tree_finds_the_lowest_of_equal_entries():
    dice = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 200):
        points = dice.integers(-3, 4, (n, 4))
        at = dice.integers(-5, 6, (3000, 4))
        index, best = product_codes.KdTree(points).nearest(at)
        far = ((at[:, None, :] - points[None]) ** 2).sum(2)
        assert (best == far.min(1)).all() and (index == far.argmin(1)).all()

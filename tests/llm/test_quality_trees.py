"""Quality trees: counts against plain ones, flat scoring against a walk, monotone features, held-out accuracy."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import quality_trees as q

DOCS = "doc_id long, text string, features string, score int"
LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def odd_texts():
    dice = random.Random(2)
    texts = [None, "", " \n\t ", "one", "a b c d e f g", "a " * 40, "x y " * 9, "a b c d e f g h\na b c d e f g h\r\n\n\n", "é ü \x1c \x85 𝒳𝒴 #*$%&|<>", "w" * 5000, "l\n" * 50 + " l \nl"]
    for _ in range(60):
        texts.append(dice.choice([" ", "\n", "\t", "\x0b"]).join(dice.choice(["a", "b", "Cc", "d#"]) for _ in range(dice.randrange(1, 120))))
    return texts


def good(dice):
    return " ".join("".join(dice.choice("etaoinshr") for _ in range(dice.randrange(2, 9))) for _ in range(dice.randrange(30, 120))) + "."


def bad(dice):
    return dice.choice([good(dice).upper(), good(dice).replace(" ", "### "), " | ".join(good(dice).split())])


def test_counts_are_those_of_plain_text():
    texts = odd_texts()
    counts, features = q.statistics([t or "" for t in texts])
    assert [tuple(r) for r in counts.tolist()] == [plain_counts(t) for t in texts]
    assert features.shape == (len(texts), len(q.FEATURES)) and np.isfinite(features).all()
    alone = np.concatenate([q.statistics([t or ""])[1] for t in texts])
    assert (alone == features).all()


def test_flat_nodes_score_like_a_walk_and_keep_signs():
    dice = np.random.default_rng(0)
    x = np.round(dice.normal(size=(900, 4)), 1)
    y = (x[:, 0] - x[:, 1] * 0.5 + np.sin(3 * x[:, 2]) + dice.normal(size=900) > 0).astype(float)
    trees = q.fit(x, y, [1, -1, 0, 0])

    def walk(row, k):
        while trees.left[k] != k:
            k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
        return trees.value[k]

    plain = np.array([1 / (1 + np.exp(-(trees.base + sum(walk(r, k) for k in trees.roots)))) for r in x])
    assert np.allclose(plain, trees.score(x), atol=1e-12)
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.85
    for f, sign in ((0, 1), (1, -1)):
        moved = np.repeat(x[:150], 25, 0)
        moved[:, f] = np.tile(np.linspace(-4, 4, 25), 150)
        assert (np.diff(trees.score(moved).reshape(150, 25), axis=1) * sign >= -1e-12).all()
        assert trees.score(moved).std() > 0.01


def test_held_out_documents(spark):
    dice = random.Random(4)
    rows = [(k, good(dice) if k % 3 else bad(dice), "clash", 1) for k in range(900)]
    rows += [(None, good(dice), "", 0), (None, None, None, None), (5, "too short", "", 0), (7, rows[7][1], "", 0), (7, bad(dice), "", 0)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(500)] + [(None, 1, 0), (4, None, 0), (4000, 1, 0)]
    out = q.judge_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id >= 500]
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in held if not r.base_failed]) > 0.98
    assert all(not r.kept for r in out if r.base_failed)
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out))) == sorted(
        map(repr, ((r[0], *(c := plain_counts(r[1])), c[0] < 20 or 100 * c[4] > 30 * c[0]) for r in rows))
    )


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], LABELS)
    dice = random.Random(1)
    docs = spark.createDataFrame([(1, good(dice), "", 1), (2, "short", "", 1)], DOCS)
    assert {(r.doc_id, r.kept) for r in q.judge_documents(docs, none).collect()} == {(1, True), (2, False)}
    assert q.judge_documents(docs.where(F.lit(False)), none).count() == 0

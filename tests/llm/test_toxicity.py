"""The classifier chain against a plain dense one, and texts that say nothing."""

import numpy as np
import pytest

from sparkloom.llm import toxicity


def plain_fit(x, y, use):
    """Logistic weights of dense rows by the same steps, one column a feature, the bias last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y[use].mean() + 1e-3) / (1 - y[use].mean() + 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x[use].T @ (p - y)[use] / use.sum() + 2e-5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def plain_chain(ids, x, ys, folds=3):
    fold = np.array([(int(i) * 2654435761 >> 8) % folds for i in ids])
    models = []
    for k in range(ys.shape[1]):
        y = ys[:, k].astype(float)
        models.append(plain_fit(x, y, np.ones(len(y), bool)))
        outer = np.zeros(len(y))
        for f in range(folds):
            w = plain_fit(x, y, fold != f)
            outer[fold == f] = (1 / (1 + np.exp(-(np.column_stack([x, np.ones(len(x))]) @ w))))[fold == f]
        x = np.column_stack([x, outer])
    return models


@pytest.mark.parametrize("categories", [2, 3])
def test_chain_equals_a_plain_one(categories):
    dice = np.random.default_rng(categories)
    x = (dice.random((90, 7)) < 0.4).astype(float)
    ys = np.stack([(x @ dice.normal(size=7) + dice.normal(size=90) > 0.5).astype(int) for _ in range(categories)], 1)
    ids = dice.permutation(1000)[:90]
    got = toxicity.fit_chain(ids, [np.flatnonzero(r).tolist() for r in x], ys, 7)
    for w, want in zip(got, plain_chain(ids, x, ys), strict=True):
        assert np.allclose(w, want, atol=1e-6)


def test_texts_without_features_are_not_toxic(spark):
    docs = spark.createDataFrame([(1, "vile words here"), (2, "kind words here"), (3, None), (4, ""), (5, " \n"), (6, "vile words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(docs, labels).collect()}
    assert not any(got[k] for k in (3, 4, 5))

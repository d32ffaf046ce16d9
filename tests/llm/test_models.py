"""Fitted models: optimality, gradients, compiled rules, repeated ids, awkward rows."""

import math

import numpy as np
import pytest

from cladeloom.llm import quality, toxicity

DOC = "doc_id bigint, text string"
LABEL = "doc_id bigint, quality int, toxic int"
HARD = [(1, None), (2, ""), (None, "no id"), (4, "vile vile word"), (4, "vile vile word"), (5, "w " * 50_000), (6, " \t\n")]


@pytest.fixture(scope="module")
def labelled(spark):
    draw = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [f"w{j}" for j in draw.integers(0, 40, 30)]
        if bad:
            words += ["vile"] * int(draw.integers(1, 6)) + ["###"] * 5
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return docs, labels, spark.createDataFrame(labels, LABEL)


def test_lasso_is_optimal():
    draw = np.random.default_rng(3)
    z = (draw.random((400, 25)) < 0.4).astype(float)
    y = (draw.random(400) < 1 / (1 + np.exp(2 - 3 * z[:, 0] + 2 * z[:, 1]))).astype(float)
    penalty = 0.01
    w, b = quality._lasso(z, y, penalty, steps=4000)
    residual = 1 / (1 + np.exp(-(z @ w + b))) - y
    slope = z.T @ residual / len(y)
    held = np.abs(w) > 1e-9
    assert 0 < held.sum() < 25 and abs(residual.mean()) < 1e-4
    assert np.allclose(slope[held], -penalty * np.sign(w[held]), atol=1e-4)
    assert (np.abs(slope[~held]) <= penalty + 1e-4).all()


def test_compiled_rules_equal_plain_evaluation(spark, labelled):
    docs, _, labels = labelled
    table = spark.createDataFrame(docs, DOC)
    model = quality.fit(table, labels)
    assert model.rules
    scores = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    for row in quality.with_statistics(table).collect():
        total = model.intercept
        for rule, weight in model.rules:
            if all((row[model.names[f]] > cut) == above for f, above, cut in rule):
                total += weight
        assert scores[row["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_one_row_of_an_id_is_fitted(spark, labelled):
    docs, _, labels = labelled
    once = spark.createDataFrame(docs, DOC)
    often = spark.createDataFrame(docs + [docs[0]] * 500 + [docs[1]] * 200, DOC)
    assert quality.fit(once, labels) == quality.fit(often, labels)
    one, many = toxicity.fit(once, labels), toxicity.fit(often, labels)
    assert one.thresholds == pytest.approx(many.thresholds) and one.weights == pytest.approx(many.weights)


def test_fitted_models_on_awkward_rows(spark, labelled):
    docs, _, labels = labelled
    table, hard = spark.createDataFrame(docs, DOC), spark.createDataFrame(HARD, DOC)
    good = quality.score(hard, quality.fit(table, labels)).collect()
    bad = toxicity.score(hard, toxicity.fit(table, labels)).collect()
    assert len(good) == len(bad) == len(HARD)
    score = {r["doc_id"]: r["score"] for r in good}
    assert all(0 <= s <= 1 for s in score.values()) and score[1] == score[2] == score[6]
    grade = {r["doc_id"]: r for r in bad}
    assert grade[1]["severity"] == grade[2]["severity"] == grade[6]["severity"]
    assert grade[4]["toxic"] and not grade[1]["toxic"] and not grade[5]["toxic"]


def test_gradient_of_the_ordinal_likelihood():
    draw = np.random.default_rng(8)
    n, width, ridge = 40, 6, 0.01
    at, k = np.repeat(np.arange(n), 3), draw.integers(0, width, 3 * n)
    x, grades = draw.random(3 * n) + 0.5, draw.integers(0, toxicity.GRADES, n)

    def loss(params):
        cuts = [-math.inf, params[width]]
        for gap in params[width + 1:]:
            cuts.append(cuts[-1] + math.exp(gap))
        cuts.append(math.inf)
        total = 0.0
        for i in range(n):
            score = sum(params[k[j]] * x[j] for j in range(3 * n) if at[j] == i)
            below = lambda cut: 1 / (1 + math.exp(score - cut)) if math.isfinite(cut) else float(cut > 0)  # noqa: B023, E731
            total -= math.log(below(cuts[grades[i] + 1]) - below(cuts[grades[i]]))
        return total / n + ridge / 2 * float(np.sum(params[:width] ** 2))

    params = draw.normal(size=width + toxicity.GRADES - 1) * 0.3
    found = toxicity.slope(params, at, k, x, grades, width, ridge)
    for j in range(len(params)):
        step = np.zeros_like(params)
        step[j] = 1e-5
        assert found[j] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-5, abs=1e-6)


def test_words_are_chosen_by_their_share_only(spark, labelled):
    """No word that tells is left out, however many there are."""
    docs, labels, table = labelled
    marked = [(i, t + (" " + " ".join(f"bad{j}" for j in range(3000)) if labels[i][2] else "")) for i, t in docs]
    model = toxicity.fit(spark.createDataFrame(marked, DOC), table)
    assert sum(w.startswith("bad") for w in model.weights) == 3000

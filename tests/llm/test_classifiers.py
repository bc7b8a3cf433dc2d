"""The ordinal regression and the quadratic discriminant against their formulas, written out plainly."""

import math

import numpy as np
import pytest

from quillmark.llm import quality, toxicity


def ordinal_loss(weights, cuts, rows, grade):
    total = 0.0
    for present, g in zip(rows, grade):
        score = sum(weights[k] for k in present)
        above = [1.0, *(1 / (1 + math.exp(-(score - c))) for c in cuts), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(rows) + toxicity.PENALTY / 2 * float(np.square(weights).sum())


def test_ordinal_fit_is_a_minimum_of_the_penalised_likelihood():
    rng = np.random.default_rng(3)
    rows = [sorted(set(rng.integers(0, 6, rng.integers(0, 4)).tolist())) for _ in range(400)]
    true = np.array([2.0, 1.0, 0.5, -0.5, 0.0, 1.5])
    score = np.array([true[r].sum() for r in rows]) + rng.logistic(size=400)
    grade = np.digitize(score, [1.0, 2.0, 3.0])
    owner, feature = np.repeat(np.arange(400), [len(r) for r in rows]), np.array([k for r in rows for k in r])
    model = toxicity._ordinal(owner, feature, grade, 6)
    weights, cuts = model["weights"], model["cuts"]
    assert list(cuts) == sorted(cuts) and np.abs(weights - true).max() < 0.7
    best = ordinal_loss(weights, cuts, rows, grade)
    for values in (weights, cuts):
        for k in range(len(values)):
            values[k] += 1e-3
            up = ordinal_loss(weights, cuts, rows, grade)
            values[k] -= 2e-3
            down = ordinal_loss(weights, cuts, rows, grade)
            values[k] += 1e-3
            assert abs(up - down) / 2e-3 < 2e-3 and min(up, down) > best - 1e-6


def test_severity_is_the_expected_grade(spark):
    model = {"words": {"bad": 0, "wor*": 1}, "weights": np.array([1.5, 0.7, *[0.1] * len(toxicity.SHARES)]), "cuts": np.array([0.5, 1.5, 2.5])}
    docs = spark.createDataFrame([(1, "bad day"), (2, "worse and worse"), (3, None), (4, "all is well " * 40 + "bad")], "doc_id long, text string")
    for row in toxicity.grade_toxicity(docs, model).collect():
        words = set((docs.where(f"doc_id = {row.doc_id}").first().text or "").split())
        tied = [w for w in words if w == "bad" or w.startswith("wor")]
        score = (1.5 if "bad" in words else 0) + (0.7 if any(w.startswith("wor") for w in words) else 0) + 0.1 * sum(bool(tied) and len(tied) >= s * len(words) for s in toxicity.SHARES)
        above = [1 / (1 + math.exp(c - score)) for c in (0.5, 1.5, 2.5)]
        exact = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert row.severity == pytest.approx(sum(k * p for k, p in enumerate(exact))) and row.grade == int(np.argmax(exact)) and row.toxic == (above[0] >= 0.5)


def test_posterior_is_that_of_plain_normal_densities():
    rng = np.random.default_rng(7)
    y = (rng.random(300) < 0.3).astype(int)
    x = rng.normal(size=(300, 4)) * [1, 2, 0.5, 3] + y[:, None] * [0.5, 1, 0, -1]
    x[y == 1, 0] += 0.8 * x[y == 1, 1]
    model = quality.fit_discriminant(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    share, within = [(y == k).mean() for k in (0, 1)], [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = share[0] * within[0] + share[1] * within[1]
    density = []
    for k in (0, 1):
        cov = (1 - quality.TO_POOLED) * within[k] + quality.TO_POOLED * pooled
        cov = (1 - quality.TO_DIAGONAL) * cov + quality.TO_DIAGONAL * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(4)
        away = z - z[y == k].mean(0)
        density.append(share[k] * np.exp(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)) / np.sqrt(np.linalg.det(2 * math.pi * cov)))
    assert np.allclose(quality.posterior(x, model), density[1] / (density[0] + density[1]), atol=1e-9)
    assert quality.posterior(x, None).tolist() == [0.5] * 300

"""Fitted models against slow solutions of their own equations, on given rows."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from tilewright.operators import models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for i in range(400):
        x = [rng.gauss(0, 1), rng.gauss(2, 3), rng.random()]
        risk = 0.8 * x[0] - 0.3 * x[1]
        time = round(5 * (-math.log(rng.random()) * math.exp(-risk)) ** 0.6 + 0.1, 1)
        out.append((i, *x, float(rng.random() < 1 / (1 + math.exp(-1.5 * x[0] + 0.4 * x[1] - 0.3))), time, rng.random() < 0.7, i % 4))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double, time double, event boolean, fold int").cache()


def scaled(rows):
    x = np.array([r[1:4] for r in rows])
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def test_logistic_regression(table, rows):
    """Newton's solution of the likelihood on the same scaled features."""
    x, y = np.column_stack([np.ones(len(rows)), scaled(rows)]), np.array([r[4] for r in rows])
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    model = models.fit_lr(table, FEATURES, tol=1e-12).stages[-1]
    assert [model.intercept, *model.coefficients] == pytest.approx(list(w), abs=1e-4)
    got = {r.id: r.score for r in models.predict_proba(models.fit_lr(table, FEATURES, tol=1e-12), table).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(list(1 / (1 + np.exp(-x @ w))), abs=1e-4)


def auroc(score, y):
    pairs = [(s, t) for s, u in zip(score, y, strict=True) if u == 1 for t, v in zip(score, y, strict=True) if v == 0]
    return sum(1.0 if s > t else 0.5 if s == t else 0.0 for s, t in pairs) / len(pairs)


def test_held_out_evaluation(table):
    """Figures of rows that the model hasn't seen, counted one by one."""
    train, held = table.where("fold <> 3"), table.where("fold = 3")
    for fit in (models.fit_lr, lambda d, f: models.fit_rf(d, f, trees=5, depth=3), lambda d, f: models.fit_svm_linear(d, f, maxIter=20)):
        m = fit(train, FEATURES)
        r = models.evaluate(m, held).first()
        scored = models.predict_proba(m, held).collect()
        assert r.auroc == pytest.approx(auroc([x.score for x in scored], [x.y_true for x in scored]), abs=1e-12) and r.auroc > 0.7
        assert r.accuracy == pytest.approx(np.mean([x.y_true == x.y_pred for x in scored]))


def test_lasso(table, rows):
    """Coordinate descent on the same scaled features."""
    x, y = scaled(rows), np.array([r[4] for r in rows])
    x, y = x - x.mean(axis=0), y - y.mean()
    for alpha in (0.01, 0.05, 0.12, 0.3):
        b = np.zeros(3)
        for _ in range(500):
            for j in range(3):
                rho = x[:, j] @ (y - x @ b + x[:, j] * b[j]) / len(y)
                b[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (x[:, j] @ x[:, j] / len(y))
        assert models.lasso_select(table, FEATURES, "label", alpha) == [f for f, v in zip(FEATURES, b, strict=True) if abs(v) > 1e-6]


def test_cox(table, rows):
    """The root of the partial likelihood's score, with Breslow ties."""
    x = np.array([r[1:4] for r in rows])
    time, event = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    w = np.zeros(3)
    for _ in range(30):
        e = np.exp(x @ w)
        g, h = np.zeros(3), np.zeros((3, 3))
        for i in np.flatnonzero(event):
            at = time >= time[i]
            s0, s1 = e[at].sum(), (e[at][:, None] * x[at]).sum(axis=0)
            g += x[i] - s1 / s0
            h += (x[at].T * e[at]) @ x[at] / s0 - np.outer(s1, s1) / s0**2
        w = w + np.linalg.solve(h, g)
    cox = models.Cox(FEATURES).fit(table)
    assert list(cox.coef) == pytest.approx(list(w), abs=1e-6)
    e, hazard = np.exp(x @ w), {}
    for t in sorted({r[5] for r in rows if r[6]}):
        hazard[t] = event[time == t].sum() / e[time >= t].sum()
    got = {r.time: r.hazard for r in cox.baseline(table).collect()}
    total = np.cumsum(list(hazard.values()))
    assert got == pytest.approx(dict(zip(hazard, total, strict=True)), abs=1e-6)
    at = {(r.id, r.time): r.survival for r in cox.survival_at(table, cox.baseline(table), [2.0, 6.0], "id").collect()}
    for i, t in list(at)[:40]:
        before = [v for u, v in hazard.items() if u <= t]
        assert at[i, t] == pytest.approx(math.exp(-sum(before) * e[i]), abs=1e-6)


def test_aft(table, rows):
    """The score of the Weibull likelihood is zero at the estimate."""
    m = models.fit_aft(table, FEATURES).stages[-1]
    x, sigma = np.array([r[1:4] for r in rows]), m.scale
    z = (np.log([r[5] for r in rows]) - m.intercept - x @ np.array(m.coefficients)) / sigma
    d = np.array([float(r[6]) for r in rows])
    slope = (np.exp(z) - d) / sigma
    assert abs(slope.mean()) < 2e-3 and np.abs((x * slope[:, None]).mean(axis=0)).max() < 5e-3
    assert abs(((np.exp(z) - d) * z - d).mean() / sigma) < 5e-3


def test_cv_search(table, rows):
    """Each candidate's mean over the folds, fitted and scored fold by fold."""
    lr = LogisticRegression(labelCol="label", maxIter=50)
    grid = [{lr.regParam: v} for v in (0.01, 5.0)]
    out = models.cv_search(table, FEATURES, grid, lr)
    want = []
    for v in (0.01, 5.0):
        each = []
        for k in range(4):
            m = models.fit_lr(table.where(f"fold <> {k}"), FEATURES, regParam=v)
            scored = models.predict_proba(m, table.where(f"fold = {k}")).collect()
            each.append(auroc([r.score for r in scored], [r.y_true for r in scored]))
        want.append(sum(each) / 4)
    assert out["mean"] == pytest.approx(want, abs=2e-3) and out["best"] == {"regParam": 0.01 if want[0] >= want[1] else 5.0}

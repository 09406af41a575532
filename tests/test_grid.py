"""Grids fitted together, against single fits, Spark's own solver and dense solutions."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from pricewire.operators import grid as G
from pricewire.operators import models as M

RNG = np.random.default_rng(5)
X = RNG.normal(size=(240, 3))
Y = (X @ np.array([1.0, -2.0, 0.5]) + 0.3 + RNG.normal(size=240) > 0).astype(float)
T = X @ np.array([2.0, 0.0, -1.0]) + 4 + RNG.normal(size=240) * 0.3


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, x.tolist(), float(y), float(t), i % 3) for i, (x, y, t) in enumerate(zip(X, Y, T))]
    return spark.createDataFrame(rows, "id long, features array<double>, label double, target double, fold int").cache()


def objective(w, x, y, C, loss):
    score = x @ w[:-1] + w[-1]
    return loss(score, y).mean() + w[:-1] @ w[:-1] / (2 * C * len(x))


def hinge(score, y):
    return np.maximum(0, 1 - np.where(y == 1, 1, -1) * score)


def tube(score, y, eps=0.1):
    return np.maximum(0, np.abs(score - y) - eps)


def dense(x, y, C, loss, steps=20000):
    """Subgradient descent with averaging on the unsmoothed objective (numerical slopes along each coordinate of the score)."""
    w, best = np.zeros(x.shape[1] + 1), None
    z = np.hstack([x, np.ones((len(x), 1))])
    for k in range(steps):
        score = z @ w
        slope = (loss(score + 1e-7, y) - loss(score - 1e-7, y)) / 2e-7
        g = z.T @ slope / len(x) + np.append(w[:-1], 0) / (C * len(x))
        w = w - g * 2.0 / (1 + k) ** 0.6
        f = objective(w, x, y, C, loss)
        best = f if best is None else min(best, f)
    return best


def test_logistic_points_equal_spark_s_single_fits(spark, data):
    with G.packed(data, F.col("features"), "label", fold="fold") as b:
        got = G.fit(b, [G.Point(0, "logistic", 0.1, 1.0), G.Point(0, "logistic", 10.0, 1.0), G.Point(0, "logistic", 1.0, 1.0, without=2)],
                    tolerance=1e-8, most=400)
    v = M.assemble(data, ["features"], "v")
    for w, (C, part) in zip(got, [(0.1, v), (10.0, v), (1.0, v.where("fold <> 2"))]):
        n = part.count()
        m = LogisticRegression(featuresCol="v", regParam=M.reg_param(C, n), standardization=False, tol=1e-10, maxIter=500).fit(part)
        assert np.allclose(w, [*m.coefficients.toArray(), m.intercept], atol=2e-3)


def test_hinge_and_tube_reach_the_dense_optimum(spark, data):
    with G.packed(data, F.col("features"), "label") as b:
        for C, w in zip((0.05, 4.0), G.fit(b, [G.Point(0, "hinge", c, 1.0) for c in (0.05, 4.0)])):
            assert objective(w, X, Y, C, hinge) <= dense(X, Y, C, hinge) + G.DELTAS[-1] / 2 + 1e-3
    with G.packed(data, F.col("features"), "target") as b:
        w = G.fit(b, [G.Point(0, "epsilon", 1.0, epsilon=0.1)])[0]
        assert objective(w, X, T, 1.0, tube) <= dense(X, T, 1.0, tube) + G.DELTAS[-1] / 2 + 1e-3
        s = G.scores(b, [G.Model((G.Point(0, "epsilon", 1.0),), (w,))])[0]
    p = X @ w[:-1] + w[-1]
    assert s["n"] == 240 and s["mse"] == pytest.approx(np.square(p - T).mean()) and s["r2"] == pytest.approx(np.corrcoef(p, T)[0, 1] ** 2)


def test_partial_gradients_added_by_spark(spark, data, monkeypatch):
    points = [G.Point(0, "hinge", 1.0, 1.0), G.Point(1, "squared", 2.0)]
    at = [np.array([0.1, -0.2, 0.3, 0.4]), np.array([0.5, -1.0])]
    monkeypatch.setattr(G, "TASK_BYTES", 1)
    with G.packed(data.repartition(5), F.col("features"), "label", [G.Columns((0, 1, 2)), G.Columns((1,))]) as b:
        assert b.parts > 1
        direct = G.evaluate(b, points, at, 0.5)
        monkeypatch.setattr(G, "DIRECT_BYTES", 0)
        spread = G.evaluate(b, points, at, 0.5)
    for (f, g), (f2, g2) in zip(direct, spread):
        assert f == pytest.approx(f2) and np.allclose(g, g2)
    score = X[:, 1] * 0.5 - 1.0
    assert direct[1][0] == pytest.approx(np.square(score - Y).mean() / 2)
    assert np.allclose(direct[1][1], [((score - Y) * X[:, 1]).mean(), (score - Y).mean()])


def test_fourier_features_approach_the_kernel_and_share_one_projection():
    draw = G.Projection.draw(3, 8000)
    for view in draw.views([0.05, 0.5, 2.0]):
        z = view.make(X[:40] @ draw.directions)
        want = np.exp(-view.gamma * np.square(X[:40, None] - X[None, :40]).sum(axis=2))
        assert np.abs(z @ z.T - want).max() < 0.07


def test_no_weights_in_the_plan(spark, data):
    draw = G.Projection.draw(3, 64)
    with G.packed(data, F.col("features"), "label", draw.views([0.1]), draw) as b:
        plan = b.frame._jdf.queryExecution().toString()
        assert f"{draw.directions[0, 0]:.6f}"[:8] not in plan and b.width == 64 and b.n == 240


def test_grids_keep_every_point_and_the_best_separates(spark):
    rows = [(i, [float(np.cos(a)) * r, float(np.sin(a)) * r], float(r > 1)) for i, (a, r) in
            enumerate((k * 0.7, 0.5 if k % 2 else 1.5) for k in range(120))]  # a disc in a ring: no line parts them
    df = spark.createDataFrame(rows, "row_idx long, features array<double>, label double")
    linear, _ = M.tune_svm_linear(df, df, [1.0, 64.0], dim=2)
    kernel = M.tune_svm_rbf_approx(df, df, "features", 2, [1.0, 64.0], [0.25, 1.0], n_out=64)
    assert [r[:2] for r in kernel] == [(1.0, 0.25), (1.0, 1.0), (64.0, 0.25), (64.0, 1.0)]
    assert max(a for _, a in linear) < 0.8 and max(r[2] for r in kernel) == 1.0


def test_three_classes_and_selected_sets(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), 0.1 * (i % 7)], float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_idx long, features array<double>, label double")
    got, best = M.tune_svm_linear(df, df, [1.0, 8.0], classes=(0.0, 1.0, 2.0), dim=3)
    assert max(a for _, a in got) == 1.0 and best in (1.0, 8.0)
    p = M.fit_selected(df, df.limit(30), [("both", [0, 1], 8.0), ("noise", [2], 8.0)], ["row_idx"], classes=(0.0, 1.0, 2.0))
    rows = p.collect()
    assert len(rows) == 2 * 120 and {(r.name, r.part) for r in rows} == {(a, b) for a in ("both", "noise") for b in ("train", "test")}
    assert all(r.prediction == r.label for r in rows if r.name == "both")


def test_regression_grid(spark, data):
    rows = M.tune_svr(data, data, "features", 3, [1.0, 16.0], gammas=None, epsilons=[0, 0.5], label="target")
    assert [r[:3] for r in rows] == [(1.0, None, 0.0), (1.0, None, 0.5), (16.0, None, 0.0), (16.0, None, 0.5)]
    assert min(r[3] for r in rows) < 0.12 and max(r[4] for r in rows) > 0.95
    assert len(M.tune_svr(data, data, "features", 3, [4.0], [0.1, 0.5], [0.1], n_out=32, label="target")) == 2


def test_a_block_moves_as_its_features(spark, data):
    """The projection is taken where a block is read: it neither stores nor moves the wider random features."""
    draw = G.Projection.draw(3, 64)
    with G.packed(data, F.col("features"), "label", draw.views([0.1]), draw) as b:
        rows = b.frame.collect()
        assert sum(r.n for r in rows) == 240 and all(len(r.x) == 8 * 3 * r.n for r in rows)
        w = RNG.normal(size=65)
        (value, gradient), = G.evaluate(b, [G.Point(0, "squared", 1.0)], [w], 0.5)
    z = draw.views([0.1])[0].make(X @ draw.directions)
    r = z @ w[:-1] + w[-1] - Y
    assert value == pytest.approx((r * r).mean() / 2) and np.allclose(gradient, [*(z.T @ r / 240), r.mean()])


def test_gammas_share_their_cosines(monkeypatch):
    """Doubled angles give the features that each gamma gives alone, also of rows that a fit has not seen, other views between."""
    draw = G.Projection.draw(3, 32)
    views = [*draw.views([1.0, 2.0 ** -10, 0.25, 0.3, 4.0, 4.0, 2.0 ** 14]), G.Columns((1, 0))]
    direct, angles = [], np.sin
    monkeypatch.setattr(G.np, "sin", lambda *a, **k: direct.append(1) or angles(*a, **k))
    made = G.Features(views, range(len(views)))
    del direct[:]
    for x in (X @ draw.directions, (X * 30 @ draw.directions)[:7]):
        got = {v: z.copy() for v, z in made.of(x)}
        assert got.keys() == set(range(len(views)))
        for v, z in got.items():
            assert np.abs(z - views[v].make(x)).max() < (1e-11 if v < 7 else 1e-15)
    assert len(direct) == 2  # one chain of angles for each x


def test_tube_losses_and_scores_of_many_points(spark, data):
    points = [G.Point(v, "epsilon", 1.0, epsilon=e) for v in (0, 1) for e in (0.0, 0.1, 8.0)]
    at = [RNG.normal(size=n) for n in (4, 4, 4, 2, 2, 2)]
    with G.packed(data, F.col("features"), "target", [G.Columns((0, 1, 2)), G.Columns((1,))]) as b:
        got = G.evaluate(b, points, at, 0.5)
        found = G.scores(b, [G.Model((p,), (w,)) for p, w in zip(points, at)][::-1])[::-1]
    for p, w, (f, g), s in zip(points, at, got, found):
        x = X if p.view == 0 else X[:, 1:2]
        r = x @ w[:-1] + w[-1] - T
        value, slope = G._smooth(np.abs(r) - p.epsilon, 0.5)
        assert f == pytest.approx(value.mean()) and np.allclose(g, np.append(x.T @ (slope * np.sign(r)), (slope * np.sign(r)).sum()) / 240)
        assert s["n"] == 240 and s["mse"] == pytest.approx(np.square(r).mean()) and s["r2"] == pytest.approx(np.corrcoef(r + T, T)[0, 1] ** 2)

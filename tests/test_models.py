"""Fitted models: parity with closed-form or Newton solutions, metric floors, and invariants of the segmentations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import boosting as bst
from cohortlab.operators import classify as cls
from cohortlab.operators import forecast as fc
from cohortlab.operators import segment as seg
from cohortlab.operators import ward
from cohortlab.operators.encode import assemble

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3)) * [1.0, 3.0, 0.5] + [0.0, 2.0, -1.0]
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.8 * x[:, 1] + 0.4)))
    y = (rng.random(1500) < p).astype(int)
    m = 3 * x[:, 0] - x[:, 1] ** 2 + rng.normal(size=1500) * 0.3
    rows = [(i, *map(float, r), int(t), float(v)) for i, (r, t, v) in enumerate(zip(x, y, m))]
    return x, y, m, spark.createDataFrame(rows, "id long, a double, b double, c double, y int, m double").repartition(4).cache()


def test_logistic_matches_newton(data):
    x, y, _, df = data
    model, _ = cls.fit_logistic(df, FEATS, "y", c=1.0, tol=1e-9)
    z = (x - x.mean(0)) / x.std(0)
    zz, w = np.column_stack([np.ones(len(z)), z]), np.zeros(4)
    ridge = np.diag([0.0, 1.0, 1.0, 1.0])  # 0.5 |w|^2 + C sum(logloss), intercept free
    for _ in range(50):
        p = 1 / (1 + np.exp(-zz @ w))
        w -= np.linalg.solve(zz.T @ (zz * (p * (1 - p))[:, None]) + ridge, zz.T @ (p - y) + ridge @ w)
    assert np.allclose([model.intercept, *model.coefficients.toArray()], w, atol=1e-4)


def test_ols_solves_the_normal_equations(data):
    x, _, m, df = data
    model, stats = fc.fit_linear(df, FEATS, "m")
    got = fc.predict_linear(model, stats, df, FEATS, ["id", "m"])
    res = got.join(df.select("id", *FEATS), "id").select((F.col("m") - F.col("prediction")).alias("r"), *FEATS)
    row = res.agg(F.sum("r"), *[F.sum(F.col("r") * F.col(f)) for f in FEATS]).first()
    assert np.allclose(list(row), 0, atol=1e-6)


def test_boosting_beats_the_line_and_the_mean(data):
    _, _, _, df = data
    gbt = fc.regression_metrics(bst.predict_boosting(bst.fit_boosting(df, FEATS, "m", n_trees=40), df, FEATS, ["m"]), "m", "prediction").first()
    model, stats = fc.fit_linear(df, FEATS, "m")
    ols = fc.regression_metrics(fc.predict_linear(model, stats, df, FEATS, ["m"]), "m", "prediction").first()
    assert gbt.r2 > 0.9 > ols.r2 > 0


def test_forest_beats_the_majority(data):
    _, y, _, df = data
    model = cls.fit_random_forest(df, FEATS, "y", n_trees=20, max_depth=6)
    pred = cls.predict_rf(model, df, FEATS, ["y"]).cache()
    got = cls.binary_metrics(pred, "y", "prediction").first()
    cells = {(r.actual, r.predicted): r.n for r in cls.confusion_matrix(pred, "y", "prediction").collect()}
    assert got.accuracy > max(y.mean(), 1 - y.mean()) + 0.1 and sum(cells.values()) == len(y)
    assert got.accuracy == pytest.approx((cells[0, 0] + cells[1, 1]) / len(y), abs=1e-4)
    shown = cls.feature_importance(model, FEATS, df.sparkSession).collect()
    assert sum(r.importance for r in shown) == pytest.approx(1.0)


def test_chosen_models(data):
    _, y, _, df = data
    one = cls.train_and_score(df, df, FEATS, "y", "lr").collect()
    assert [(r.model, r.n, r.winner) for r in one] == [("Logistic Regression", len(y), "Logistic Regression")]
    both = {r.model: r for r in cls.train_and_score(df, df, FEATS, "y", "both", n_trees=10, max_depth=5).collect()}
    assert set(both) == {"Random Forest", "Logistic Regression"} and both["Logistic Regression"].f1 == one[0].f1
    assert {r.winner for r in both.values()} == {max(both.values(), key=lambda r: r.f1).model}
    with pytest.raises(ValueError, match="choice"):
        cls.train_and_score(df, df, FEATS, "y", "svm")


def test_segmentations_are_fixed_points(data):
    _, _, _, df = data
    vec = assemble(df, FEATS).select("id", "features").cache()
    model = seg.fit_kmeans(vec, k=3, n_init=3)
    pts = seg.features_to_columns(model.transform(vec).withColumnRenamed("prediction", "cluster"), FEATS).collect()
    centers = np.array(model.clusterCenters())
    x, lab = np.array([[r.a, r.b, r.c] for r in pts]), np.array([r.cluster for r in pts])
    assert (((x[:, None] - centers) ** 2).sum(-1).argmin(1) == lab).all()
    assert np.allclose([x[lab == k].mean(0) for k in range(3)], centers, atol=0.1)
    for labelled in (ward.ward_segments(vec, "id", k=3, limit=50), seg.bisecting_segments(vec, "id", k=3)):
        sizes = {r.cluster: r["count"] for r in labelled.groupBy("cluster").count().collect()}
        assert len(sizes) == 3 and sum(sizes.values()) == len(x)


def test_bisecting_splits_centred_data(spark):
    """Three far groups of z-scores, whose common centre is 0."""
    rng = np.random.default_rng(3)
    x = np.array([[-10, 0], [10, -3], [0, 3]])[np.arange(90) % 3] + rng.normal(0, 0.1, (90, 2))
    x = (x - x.mean(0)) / x.std(0)
    df = assemble(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double"), ["a", "b"])
    got = {}
    for r in seg.bisecting_segments(df, "id", k=3).collect():
        got.setdefault(r.cluster, set()).add(r.id)
        assert list(r.features) == pytest.approx(list(x[r.id]))
    assert sorted(map(sorted, got.values())) == [list(range(i, 90, 3)) for i in range(3)]

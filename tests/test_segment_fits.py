"""Euclidean silhouette, Ward and boosting against brute force and a worked example."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlab.operators import boosting, silhouette, ward


def points(spark, n, k=3, d=3, seed=1, labels=None):
    rng = np.random.default_rng(seed)
    lab = rng.integers(0, k, n) if labels is None else np.array(labels)
    x = rng.normal(0, 1, (n, d)) + lab[:, None]
    frame = spark.createDataFrame([(int(i), f"c{lab[i]}", *map(float, x[i])) for i in range(n)], ["id", "lab", *[f"x{j}" for j in range(d)]])
    return frame.repartition(4), x, lab, [f"x{j}" for j in range(d)]


def silhouette_brute(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1 or len(set(lab)) == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


# --- silhouette ----------------------------------------------------------------------------------------------


def test_silhouette_of_the_whole_table_is_exact(spark):
    df, x, lab, f = points(spark, 120)
    r = silhouette.euclidean_silhouette(df, "id", f, "lab", size=1000).first()
    assert r.silhouette == pytest.approx(silhouette_brute(x, lab).mean(), abs=1e-12)
    assert (r.std_error, r.n_sample, r.n) == (0.0, 120, 120)


def test_sampled_points_are_exact_and_the_error_is_honest(spark):
    df, x, lab, f = points(spark, 600, seed=2)
    true = silhouette_brute(x, lab)
    for r in silhouette.sampled_points(df, "id", f, "lab", size=60).collect():
        assert r.s == pytest.approx(true[r.key], abs=1e-12)
    off = []
    for seed in range(12):
        r = silhouette.euclidean_silhouette(df, "id", f, "lab", size=60, seed=seed).first()
        assert 60 <= r.n_sample <= 63 and r.n == 600 and r.std_error > 0
        off.append((r.silhouette - true.mean()) / r.std_error)
    assert np.mean(np.abs(off) < 2) >= 0.75 and max(np.abs(off)) < 5


def test_silhouette_does_not_depend_on_the_partitioning(spark):
    df, _, _, f = points(spark, 200, seed=3)
    a, b = (silhouette.euclidean_silhouette(x, "id", f, "lab", size=40).first() for x in (df.repartition(2), df.repartition(7)))
    assert a.silhouette == pytest.approx(b.silhouette, abs=1e-12) and a.n_sample == b.n_sample


def test_silhouette_of_awkward_tables(spark):
    df, _, _, f = points(spark, 5, labels=[0, 0, 0, 0, 1])  # a point alone
    x = np.array([[r[c] for c in f] for r in sorted(df.collect(), key=lambda r: r.id)])
    r = silhouette.euclidean_silhouette(df, "id", f, "lab").first()
    assert r.silhouette == pytest.approx(silhouette_brute(x, np.array([0, 0, 0, 0, 1])).mean())
    one, _, _, f = points(spark, 6, labels=[0] * 6)
    assert silhouette.euclidean_silhouette(one, "id", f, "lab").first().silhouette == 0.0
    same = spark.createDataFrame([(i, "ab"[i % 2], 1.0) for i in range(6)], "id int, lab string, x double")
    assert silhouette.euclidean_silhouette(same, "id", ["x"], "lab").first().silhouette == 0.0
    none = silhouette.euclidean_silhouette(same.limit(0), "id", ["x"], "lab").first()
    assert (none.silhouette, none.n_sample, none.n) == (None, 0, 0)
    holes = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 9.0), (4, None, 1.0), (5, "b", None), (6, "b", float("nan"))], "id int, lab string, x double")
    assert silhouette.euclidean_silhouette(holes, "id", ["x"], "lab").first().n == 3
    many, x, lab, f = points(spark, 80, labels=[i // 2 for i in range(80)])  # more labels than half the sample
    r = silhouette.euclidean_silhouette(many, "id", f, "lab", size=30).first()
    assert (r.n_sample, r.n) == (30, 80)


# --- Ward ----------------------------------------------------------------------------------------------------


def ward_brute(x, k):
    """Merge the two clusters whose union raises the sum of squares least, from all points."""
    clusters = [[i] for i in range(len(x))]

    def sse(c):
        return ((x[c] - x[c].mean(0)) ** 2).sum()

    while len(clusters) > k:
        cost = {(i, j): sse(clusters[i] + clusters[j]) - sse(clusters[i]) - sse(clusters[j]) for i in range(len(clusters)) for j in range(i + 1, len(clusters))}
        i, j = min(cost, key=cost.get)
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def vectors(df, f):
    return VectorAssembler(inputCols=f, outputCol="features").transform(df)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("k", [2, 4])
def test_ward_is_exact_while_points_fit(spark, k):
    df, x, _, f = points(spark, 45, k=4, seed=5)
    got = ward.ward_segments(vectors(df, f), "id", k=k, limit=60).collect()
    assert groups(got) == ward_brute(x, k) and {r.leaf_radius for r in got} == {0.0}


def test_ward_with_copies_is_ward_on_all_points(spark):
    df, x, _, f = points(spark, 20, k=3, seed=6)
    both = df.unionByName(df.withColumn("id", F.col("id") + 20)).unionByName(df.where("id < 7").withColumn("id", F.col("id") + 40)).repartition(5)
    got = ward.ward_segments(vectors(both, f), "id", k=3, limit=20).collect()
    everything = np.concatenate([x, x, x[:7]])
    assert groups(got) == ward_brute(everything, 3) and {r.leaf_radius for r in got} == {0.0}


def test_ward_above_the_limit_states_its_radius(spark):
    rng = np.random.default_rng(7)
    centre = np.array([[0, 0], [20, 0], [0, 20], [20, 20]])
    lab = rng.integers(0, 4, 1500)
    x = centre[lab] + rng.normal(0, 1, (1500, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, x0 double, x1 double").repartition(6)
    got = ward.ward_segments(vectors(df, ["x0", "x1"]), "id", k=4, limit=40).collect()
    assert groups(got) == {frozenset(np.flatnonzero(lab == c)) for c in range(4)}
    radii = {r.leaf_radius for r in got}
    assert 0 < max(radii) < 3


def test_features_add_up(spark):
    df, x, _, f = points(spark, 900, seed=8)
    leaves = ward.clustering_features(df.select(F.array(*f).alias("x")), 50)
    n = np.array([r["n"] for r in leaves])
    mean = np.array([r["mean"] for r in leaves])
    sse = np.array([r["sse"] for r in leaves])
    assert len(leaves) <= 50 and n.sum() == 900
    grand = (n[:, None] * mean).sum(0) / 900
    assert grand == pytest.approx(x.mean(0))
    assert sse.sum() + (n * ((mean - grand) ** 2).sum(1)).sum() == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_ward_of_nothing(spark):
    df, _, _, f = points(spark, 3)
    assert ward.ward_segments(vectors(df.limit(0), f), "id").collect() == []


# --- boosting ------------------------------------------------------------------------------------------------


def test_three_trees_worked_by_hand(spark):
    """x = 1..4, y = 1, 2, 10, 11: mean 6, residuals -5 -4 4 5.

    A stump cuts at 2.5: leaves -4.5 and 4.5.  At rate 0.5 the residuals become -2.75 -1.75 1.75 2.75, the next leaves are -2.25 and 2.25, then
    -1.625 -0.625 0.625 1.625 and -1.125, 1.125.  Prediction left: 6 - 0.5 (4.5 + 2.25 + 1.125) = 2.0625.
    """
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 10.0), (4.0, 11.0)], "x double, y double")
    m = boosting.fit_boosting(df, ["x"], "y", n_trees=3, learning_rate=0.5, max_depth=1, every=2)
    assert m.mean == 6 and [t.cut.tolist() for t in m.trees] == [[2.5]] * 3
    assert [t.value.tolist() for t in m.trees] == [[-4.5, 4.5], [-2.25, 2.25], [-1.125, 1.125]]
    assert m.losses == pytest.approx([82.0, 21.25, 6.0625, 2.265625])
    got = {r.x: r.prediction for r in boosting.predict_boosting(m, df, ["x"], ["x"]).collect()}
    assert got == pytest.approx({1.0: 2.0625, 2.0: 2.0625, 3.0: 9.9375, 4.0: 9.9375})


def tree_brute(x, r, depth):
    """Exact greedy regression tree: predictions of the training rows."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            for a, b in zip(v, v[1:]):
                left = x[:, j] <= a + (b - a) / 2
                gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, left)
    if best is None:
        return np.full(len(r), r.mean())
    out = np.empty(len(r))
    for side in (best[1], ~best[1]):
        out[side] = tree_brute(x[side], r[side], depth - 1)
    return out


def test_boosting_equals_exact_greedy_trees(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 5) * 7 + rng.normal(0, 1, 200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double").repartition(5)
    m = boosting.fit_boosting(df, ["a", "b", "c"], "y", n_trees=8, learning_rate=0.3, max_depth=3, every=3)
    f = np.full(200, y.mean())
    losses = [((y - f) ** 2).sum()]
    for _ in range(8):
        f = f + 0.3 * tree_brute(x, y - f, 3)
        losses.append(((y - f) ** 2).sum())
    assert m.predict(x) == pytest.approx(f) and m.losses == pytest.approx(losses)
    assert all(b < a for a, b in zip(m.losses, m.losses[1:]))


def test_boosting_of_many_values_and_holes(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, 800), None
    y = np.where(x > 0.3, 5.0, 0.0)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 0.0), (float("nan"), 0.0), (1.0, None)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    m = boosting.fit_boosting(df, ["x"], "y", n_trees=12, learning_rate=0.5, max_bins=32)
    assert m.losses[-1] < 0.05 * m.losses[0] and all(b <= a * (1 + 1e-12) for a, b in zip(m.losses, m.losses[1:]))
    constant = boosting.fit_boosting(df.withColumn("y", F.lit(3.0)), ["x"], "y", n_trees=2)
    assert constant.predict(np.array([[1.0]])) == [3.0]
    with pytest.raises(ValueError):
        boosting.fit_boosting(df.limit(0), ["x"], "y")

"""Fits whose work must not grow faster than the table: few rows to a pass, bounded tasks, all rows used."""

import numpy as np
import pyarrow as pa
import pytest

from cohortlab.operators import boosting, forest


def test_boosting_works_on_blocks():
    """A pass reads blocks of many rows, however the rows come in, and loses none."""
    rng = np.random.default_rng(1)
    n, cuts = 2 * boosting.BLOCK + 7, [np.array([0.25, 0.5]), np.array([0.1])]
    x, y = rng.random((n, 2)), rng.random(n)
    whole = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y)], names=["x", "y"])
    batches = [whole.slice(i, 10_000) for i in range(0, n, 10_000)]
    blocks = list(boosting._to_bins(iter(batches), cuts, 0.5))
    assert [len(b.column(1)[0].as_py()) // 8 for b in blocks] == [boosting.BLOCK, boosting.BLOCK, 7]
    empty = boosting.Tree(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
    (sums,) = boosting._level(iter(blocks), 2, 3, [], 0.1, empty)
    got = {p: (c, s) for p, c, s in zip(*[sums.column(i).to_pylist() for i in range(3)], strict=True)}
    for j, c in enumerate(cuts):
        bins = np.searchsorted(c, x[:, j], "left")
        for b in range(len(c) + 1):
            assert got[3 * j + b] == pytest.approx(((bins == b).sum(), (y - 0.5)[bins == b].sum()))
    assert got[6][1] == pytest.approx(((y - 0.5) ** 2).sum())


def test_audit_reads_its_rows_from_one_table(spark, survey_small):
    """The distinct rows are written once; no later step shuffles whole rows again."""
    from cohortlab.operators import profile

    plan = profile.pipeline_audit(survey_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "audit_rows" in plan or "__copies" in plan
    assert "InMemoryRelation" not in plan  # the input itself is not read again


def test_single_file_is_sorted_and_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Only bytes of finished parts go through one task."""
    from cohortlab.sources import csv_io

    joined = []
    held = csv_io.partial
    monkeypatch.setattr(csv_io, "partial", lambda f, **kw: joined.append(kw["parts"]) or held(f, **kw))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).selectExpr("999 - id AS id", "'a,\n' AS note").repartition(6)
        csv_io.write_csv(df, str(tmp_path / "one.csv"), single_file=True, order_by=["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(joined[0]) > 3
    assert (tmp_path / "one.csv").read_text() == "id,note\n" + "".join(f'{i},"a,\n"\n' for i in range(1000))


def test_ranking_learns_from_every_label(spark):
    """The one bad document has the largest hash of all ids: a bounded sample would not see it."""
    pytest.importorskip("cohortlab.llm.ranking")
    from pyspark.sql import functions as F

    from cohortlab.llm import ranking

    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some plain words "), F.col("id").cast("string")).alias("text"))
    taught = docs.where(~ranking.held_out(F.col("doc_id")))
    bad = taught.orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]
    assert taught.count() > 10_000
    is_bad = F.col("doc_id") == bad
    docs = docs.withColumn("text", F.when(is_bad, F.lit("### ### !!! ###")).otherwise(F.col("text")))
    model = ranking.fit(docs, docs.select("doc_id", F.when(is_bad, 0).otherwise(1).alias("quality")))
    assert model.weights is not None and 0 < 1 - model.share < 1e-3
    assert [r.doc_id for r in ranking.score(docs, model).where("predicted = 0").collect()] == [bad]


def test_threshold_over_ranges_is_the_local_one(spark):
    pytest.importorskip("cohortlab.llm.ranking")
    from cohortlab.llm import ranking

    rng = np.random.default_rng(2)
    s, y = rng.normal(0, 1, 300).round(1), (rng.random(300) < 0.5).astype(float)
    s = s + y / 2
    table = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y double")
    assert ranking._threshold(table) == pytest.approx(ranking.threshold_of(s, y))
    assert ranking._threshold(table.selectExpr("1D AS s", "y")) == 1.0


def _survey_like(spark, n=600, p=2):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, n), *[rng.normal(size=n) for _ in range(p - 1)]]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.3) ^ (rng.random(n) < 0.1)).astype(int)
    names = [f"c{j}" for j in range(p)]
    return x, y, names, spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in names) + ", y int").repartition(3)


def test_forest_weights_are_poisson_and_repeatable():
    w = forest.weights(42, 7, 1, 2, 400_001)
    assert (w == forest.weights(42, 7, 1, 2, 400_001)).all() and (w != forest.weights(42, 8, 1, 2, 400_001)).any()
    shares = np.bincount(w, minlength=5)[:5] / len(w)
    assert shares == pytest.approx([np.exp(-1) / f for f in (1, 1, 2, 6, 24)], abs=0.004) and w.mean() == pytest.approx(1, abs=0.01)


def test_forest_splits_are_the_best_of_the_bagged_rows(spark, monkeypatch):
    """A pass reads blocks, not rows; with both features drawn every node is the exact greedy split of its bag."""
    x, y, names, df = _survey_like(spark)
    written = {}
    held = forest.materialize
    monkeypatch.setattr(forest, "materialize", lambda d, name: written.setdefault(name, held(d, name)))
    model = forest.fit_forest(df, names, "y", n_trees=4, max_depth=3, max_bins=16)
    blocks = written["forest_bins"].collect()
    assert len(blocks) <= 3
    for number, tree in enumerate(model.trees):
        bins, label = [], []
        for b in blocks:
            one = np.frombuffer(b.y, np.uint8)
            w = forest.weights(42, number, b.part, b.at, len(one))
            bins.append(np.repeat(np.frombuffer(b.bins, np.uint8).reshape(2, -1), w, axis=1))
            label.append(np.repeat(one, w))
        bins, label = np.concatenate(bins, axis=1), np.concatenate(label)
        inside = {0: np.ones(len(label), bool)}
        gini = lambda m: 1 - ((np.bincount(label[m], minlength=2) / m.sum()) ** 2).sum()
        for v in range(len(tree.left)):
            if v not in inside:
                continue  # below a joined pair of leaves
            m = inside[v]
            assert tree.counts[v].tolist() == np.bincount(label[m], minlength=2).tolist()
            if tree.left[v] == v:
                continue
            best = 0.0
            for f in range(2):
                for c in range(len(model.cuts[f])):
                    low = m & (bins[f] <= c)
                    if 0 < low.sum() < m.sum():
                        best = max(best, gini(m) - low.sum() / m.sum() * gini(low) - (1 - low.sum() / m.sum()) * gini(m & ~low))
            assert tree.gain[v] == pytest.approx(best)
            low = bins[tree.feature[v]] <= tree.bin[v]
            inside[tree.left[v]], inside[tree.left[v] + 1] = m & low, m & ~low
    assert model.importances.sum() == pytest.approx(1)
    got = forest.predict_forest(model, df, names, [*names, "y"]).collect()
    assert np.mean([r.prediction == r.y for r in got]) > 0.8 and len(got) == len(y)
    assert [r.prediction for r in got] == model.shares(np.array([r[:2] for r in got])).argmax(1).tolist()


def test_forest_does_not_depend_on_its_memory(spark):
    """Levels in several passes, and below the levels that go node by node."""
    _, _, names, df = _survey_like(spark, 900, 5)
    df = df.coalesce(1).cache()
    one, many = (forest.fit_forest(df, names, "y", n_trees=12, max_depth=7, max_bins=200, max_memory_mb=mb) for mb in (64, 1))
    assert max(len(t.left) for t in one.trees) > 100 and max(t.depth.max() for t in one.trees) > forest.TOP
    for a, b in zip(one.trees, many.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.left == b.left).all() and (a.counts == b.counts).all()
        # the walk agrees with the counts it was grown on: every row ends in a leaf
        x = forest.to_bins(np.random.default_rng(0).normal(size=(5, 100)), one.cuts, a.bin.dtype)
        leaf = a.node(x, np.arange(100), int(a.depth.max()) + 1)
        for i, v in enumerate(leaf):
            at = 0
            while a.left[at] != at:
                at = a.left[at] + (x[a.feature[at], i] > a.bin[at])
            assert v == at


def test_forest_edges(spark):
    """Classes above 1, one class, one value of all features; missing features and labels are errors."""
    three = spark.createDataFrame([(float(i), i % 3) for i in range(60)], "c0 double, y int").selectExpr("y + 0.25D AS c0", "y")
    model = forest.fit_forest(three, ["c0"], "y", n_trees=5, max_depth=2)
    assert {(r.y, r.prediction) for r in forest.predict_forest(model, three, ["c0"], ["y"]).collect()} == {(0, 0), (1, 1), (2, 2)}
    flat = forest.fit_forest(three.selectExpr("1D AS c0", "1 AS y"), ["c0"], "y", n_trees=3, max_depth=0)
    assert flat.importances.tolist() == [0.0] and {r.prediction for r in forest.predict_forest(flat, three, ["c0"], []).collect()} == {1}
    for bad in ("CAST(NULL AS DOUBLE) AS c0, y", "double('NaN') AS c0, y", "double('Infinity') AS c0, y", "c0, CAST(NULL AS INT) AS y", "c0, y + 0.5D AS y", "c0, y - 1 AS y"):
        with pytest.raises(Exception, match="missing|labels"):
            forest.fit_forest(three.selectExpr(*bad.split(", ")), ["c0"], "y", n_trees=1, max_depth=1)
    with pytest.raises(ValueError, match="no rows"):
        forest.fit_forest(three.where("y > 5"), ["c0"], "y")


def test_silhouettes_read_written_numbers(spark, sf_small):
    """A pass over the points must not derive every number from the order tables again."""
    from cohortlab.plans import segments

    for query in (segments.silhouette_euclidean, segments.kmeans_silhouette_euclidean):
        plan = query(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert "o_custkey" not in plan and "c_mktsegment" not in plan and "CASE WHEN (difficulty" not in plan
    labelled = segments._kmeans(spark, sf_small)[0]
    assert "o_custkey" not in labelled._jdf.queryExecution().optimizedPlan().toString()


def test_distances_by_products_are_those_by_differences():
    from cohortlab.operators import silhouette

    rng = np.random.default_rng(4)
    x, sample = rng.normal(3, 1, (300, 7)), rng.normal(3, 1, (40, 7))
    sample[:5] = x[:5]
    sample[5] = x[5] + 1e-9
    x[7, 0] = np.inf
    with np.errstate(invalid="ignore"):
        got = silhouette._distances(x, sample, np.einsum("ij,ij->i", sample, sample))
    want = np.sqrt(((x[:, None, :] - sample[None, :, :]) ** 2).sum(-1))
    assert (got[range(5), range(5)] == 0).all()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_forest_blocks_come_in_bounded_row_groups(spark, monkeypatch):
    """A reader holds a row group: large rows must not make one of a whole file."""
    import pyarrow.parquet as pq

    frames, held = [], forest.materialize
    monkeypatch.setattr(forest, "GROUP_BYTES", 1 << 14, raising=False)
    monkeypatch.setattr(forest, "BLOCK", 1024)
    monkeypatch.setattr(forest, "LEAST_BLOCK", 1024)
    monkeypatch.setattr(forest, "materialize", lambda df, name: frames.append(held(df, name)) or frames[-1])
    names = [f"a{i}" for i in range(6)]
    train = spark.range(0, 12_000, 1, 2).selectExpr(*[f"rand({i}) AS {n}" for i, n in enumerate(names)], "cast(id % 2 AS int) AS y")
    forest.fit_forest(train, names, "y", n_trees=2, max_depth=2)
    files = [f.removeprefix("file://") for f in frames[-1].inputFiles()]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 4


def test_fits_hold_bounded_partitions(spark, monkeypatch):
    import concurrent.futures

    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from cohortlab.operators import classify, encode, segment

    monkeypatch.setattr(encode, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(segment, "CORE_ROWS", 1, raising=False)
    assert encode.spread(spark.range(1000), rows=1000).rdd.getNumPartitions() == 10
    seen, held = [], classify.fit_cached
    monkeypatch.setattr(classify, "fit_cached", lambda e, data, rows=None, **kw: seen.append((rows, kw)) or held(e, data, rows, **kw))
    train = spark.range(300).selectExpr("cast(id AS double) AS a", "cast(id > 150 AS int) AS y")
    classify.fit_logistic(train, ["a"], "y")
    assert seen == [(300, {"keep": False})]
    workers, pool = [], concurrent.futures.ThreadPoolExecutor
    monkeypatch.setattr(concurrent.futures, "ThreadPoolExecutor", lambda max_workers: workers.append(max_workers) or pool(max_workers))
    points = spark.range(300).select(array_to_vector(F.array((F.col("id") % 3).cast("double"))).alias("features"))
    segment.fit_kmeans(points, 3, n_init=2, rows=300)
    segment.fit_kmeans(points, 3, n_init=2)
    assert workers == [1, 2]

"""NaN, empty tables (hand-written values) and mergeable sketches (against the data they stand for)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import aggregate as agg
from cohortlab.operators import encode as enc
from cohortlab.operators import profile as prof
from cohortlab.operators import segment as seg
from cohortlab.operators import sketches as sk
from cohortlab.functions.exprs import present, require_columns

NAN = float("nan")


@pytest.fixture(scope="module")
def four(spark):
    """2, NaN, NULL and 4."""
    return spark.createDataFrame([(1, 2.0, "a"), (2, NAN, "a"), (3, None, "b"), (4, 4.0, "b")], "id long, x double, s string")


def test_describe_leaves_nan_out(four):
    r = agg.describe(four, ["x"]).first()
    assert (r["count"], r.mean, r["std"], r.min, r.p50, r.max) == (2, 3.0, 1.41, 2.0, 3.0, 4.0)


def test_standardize_keeps_other_rows(four):
    got = {r.id: r.x for r in enc.standardize(four, ["x"], keep=["id"]).collect()}
    assert got == {1: -1.0, 2: None, 3: None, 4: 1.0}


def test_impute_fills_nan(four):
    got = {r.id: r.x for r in prof.impute_median_mode(four, ["x"]).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: 3.0, 4: 4.0}


def test_sparse_rows_count_nan(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, NAN, "a"), (3, NAN, None)], "id long, x double, s string")
    assert {r.id for r in prof.drop_sparse_rows(df, 0.4).collect()} == {1, 2}
    assert {r.id for r in prof.drop_sparse_rows(df, 0.3).collect()} == {1}


def test_nan_breaks_no_rule_and_is_no_outlier(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4] * 4] + [(NAN,)], "x double")
    r = prof.outlier_summary(df, ["x"]).first()
    assert (r.outliers, r.outlier_pct) == (0, "0.0%")
    assert {r.x for r in prof.winsorize(df, ["x"]).collect()} == {1.0, 2.0, 3.0, 4.0, None}
    assert prof.column_profile(df.withColumn("id", F.monotonically_increasing_id()), "id").first().unique_values == 4


def test_fits_get_no_nan(survey_small):
    dirty = survey_small.withColumn("wtp_monthly_usd", F.lit(NAN)).withColumn("monthly_spend_on_ai_usd", F.when(F.col("respondent_id") % 3 == 0, F.lit(NAN)).otherwise(F.col("monthly_spend_on_ai_usd")))
    for frame in (enc.feature_matrix(dirty), seg.cluster_input(dirty)[0].drop("respondent_id")):
        bad = frame.select([F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in frame.columns]).first()
        assert sum(bad) == 0


def test_profiles_of_an_empty_table(four):
    none = four.limit(0)
    assert [tuple(r)[1:4] for r in prof.missing_profile(none).collect()] == [("id", 0, None), ("x", 0, None), ("s", 0, None)]
    r = prof.outlier_summary(none, ["x"]).first()
    assert (r.q1, r.outliers, r.outlier_pct) == (None, 0, None)
    assert agg.describe(none, ["x"]).first()["count"] == 0
    assert prof.missing_total(none).first()[0] == 0
    assert [r.n_duplicates for r in prof.duplicate_profile(none, "id").collect()] == [0, 0, 0]


def test_optional_and_required_columns(four):
    assert present(four, ["s", "t", "id"]) == ["s", "id"]
    require_columns(four, ["s", "id"])
    with pytest.raises(KeyError, match="'t', 'u'"):
        require_columns(four, ["s", "t", "u"])


# --- sketches ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(11)
    x = np.r_[rng.lognormal(0, 2, 30_000), np.full(6_000, 7.5)]
    day = rng.integers(0, 9, len(x))
    rows = [(int(d), float(v), int(i % 5000), f"u{i % 300}") for i, (d, v) in enumerate(zip(day, x))] + [(3, NAN, None, None), (4, None, 1, "u1")]
    return x, spark.createDataFrame(rows, "day int, x double, k long, s string").repartition(6).cache()


def test_union_from_sketches_alone(days):
    x, df = days
    parts = sk.sketch_columns(df, ["x", "k", "s"], by=["day"]).cache()
    assert parts.count() == 27
    whole = {r.feature: r for r in sk.sketch_profile(sk.merge_sketches(parts)).collect()}
    r = whole["x"]
    assert (r["count"], r.missing, r.min, r.max) == (36_000, 2, x.min(), x.max())
    assert r.mean == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=1))
    assert whole["s"].distinct == pytest.approx(300, rel=0.08) and whole["k"].distinct == pytest.approx(5000, rel=0.08)
    assert whole["s"].p50 is None and whole["s"].missing == 1
    errors = sk.rank_errors(df, sk.sketch_profile(sk.merge_sketches(parts)), ["x", "k"]).collect()
    assert len(errors) == 6 and max(e.rank_error for e in errors) <= 2 * sk.RANK_ERROR


def test_merging_is_associative(days):
    _, df = days
    parts = sk.sketch_columns(df, ["x"], by=["day"])
    weeks = sk.merge_sketches(parts.withColumn("week", F.floor(F.col("day") / 3)), by=["week"])
    a, b = (sk.sketch_profile(sk.merge_sketches(p)).first() for p in (parts, weeks))
    assert a["count"] == b["count"] and a.distinct == b.distinct and a["std"] == pytest.approx(b["std"])
    by_day = {r.day: r["count"] for r in sk.sketch_profile(parts, by=["day"]).collect()}
    assert sum(by_day.values()) == 36_000


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double").repartition(4)
    r = sk.sketch_profile(sk.sketch_columns(df)).first()
    assert (r.p25, r.p50, r.p75, r.distinct) == (25.0, 50.0, 75.0, 101)


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([], "x double, s string")
    got = {r.feature: r for r in sk.sketch_profile(sk.sketch_columns(df)).collect()}
    assert (got["x"]["count"], got["x"].distinct, got["x"].p50, got["s"].distinct) == (0, 0, None, 0)
    assert sk.sketch_columns(df.withColumn("d", F.lit(1)), by=["d"]).collect() == []
    mixed = spark.createDataFrame([(1, None), (2, 5.0), (2, NAN)], "d int, x double")
    r = sk.sketch_profile(sk.merge_sketches(sk.sketch_columns(mixed, by=["d"]))).first()
    assert (r["count"], r.missing, r.mean, r["std"], r.p50) == (1, 2, 5.0, None, 5.0)

"""What must hold of the fitted models, as tables that DuckDB can state: residuals and gradients that vanish, nearest centres, sizes that add
up, reports that agree with their matrix.  Each reads the fits of the other queries (one fit a session)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators import classify as cls
from cohortlab.operators import forecast as fc
from cohortlab.operators import segment as seg
from cohortlab.operators.encode import standardize
from cohortlab.plans import models as m
from cohortlab.plans import segments as sg
from cohortlab.plans.encoding import split_sql
from cohortlab.plans.registry import register
from cohortlab.plans.survey_sql import with_survey

C, FEATS = m.C, m.FEATS
_N_TEST = "(SELECT count(*) FROM survey WHERE " + split_sql() + " = 'test')"
_MODELS = ["Random Forest", "Logistic Regression", "Gradient Boosting", "Linear Regression"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@register(
    "fits_score_every_test_row",
    with_survey(" UNION ALL ".join(f"SELECT '{x}' AS model, CAST({_N_TEST} AS BIGINT) AS n, CAST({_N_TEST} AS BIGINT) AS ids, CAST(0 AS BIGINT) AS missing FROM (SELECT 1)" for x in _MODELS)),
)
def fits_score_every_test_row(spark, sf_dir):
    """Each model predicts every test row once."""
    frames = [m._rf(spark, sf_dir)[1], m._lr(spark, sf_dir)[1], m._gbt(spark, sf_dir)[1], m._ols(spark, sf_dir)[1]]
    p = F.col("prediction").cast("double")
    counts = [F.count(F.lit(1)).alias("n"), F.count_distinct(C.id).alias("ids"), F.count_if(p.isNull() | F.isnan(p)).alias("missing")]
    return _union([f.agg(*counts).select(F.lit(x).alias("model"), "*") for x, f in zip(_MODELS, frames, strict=True)])


def _vanish(z: DataFrame, residual, ridge: dict[str, float]) -> DataFrame:
    """Mean of residual x feature (plus the ridge's part) for each feature and the intercept: 0 at the optimum."""
    row = z.agg(F.avg(residual).alias("intercept"), *[(F.avg(residual * F.col(f)) + F.lit(ridge.get(f, 0.0))).alias(f) for f in FEATS])
    cells = [F.struct(F.lit(f).alias("term"), (F.abs(F.col(f)) < 1e-3).alias("vanishes")) for f in ["intercept", *FEATS]]
    return row.select(F.inline(F.array(*cells)))


_TERMS = " UNION ALL ".join(f"SELECT '{f}' AS term, true AS vanishes" for f in ["intercept", *FEATS])


@register("ols_normal_equations", _TERMS)
def ols_normal_equations(spark, sf_dir):
    """Residuals of the linear regression are orthogonal to every feature on the training rows (relative to the label's deviation)."""
    train, _, _ = m._split(spark, sf_dir)
    m._ols(spark, sf_dir)
    model, stats = m.cached(spark, sf_dir, "fit_ols", None)
    z = standardize(train.where(F.col(C.mrr).isNotNull()), FEATS, stats, keep=[C.mrr])
    line = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f) for w, f in zip(model.coefficients.toArray(), FEATS, strict=True)])
    sd = train.agg(F.stddev_pop(C.mrr).alias("sd")).first()["sd"] or 1.0
    return _vanish(z, (F.col(C.mrr) - line - F.lit(float(model.intercept))) / F.lit(float(sd)), {})


@register("logistic_gradient", _TERMS)
def logistic_gradient(spark, sf_dir):
    """The gradient of the regularised logistic loss is zero at the fit."""
    train, _, _ = m._split(spark, sf_dir)
    m._lr(spark, sf_dir)
    model, stats = m.cached(spark, sf_dir, "fit_lr", None)
    z = standardize(train, FEATS, stats, keep=[C.subscribe])
    weights = dict(zip(FEATS, map(float, model.coefficients.toArray()), strict=True))
    line = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f) for f, w in weights.items()]) + F.lit(float(model.intercept))
    n = train.count()
    return _vanish(z, 1 / (1 + F.exp(-line)) - F.col(C.subscribe), {f: w / n for f, w in weights.items()})


@register("importances_add_up", "SELECT CAST(21 AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, true AS none_negative")
def importances_add_up(spark, sf_dir):
    f = cls.feature_importance(m._rf(spark, sf_dir)[0], FEATS, spark, top=len(FEATS))
    return f.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative"))


@register(
    "reports_match_their_matrix",
    with_survey(
        " UNION ALL ".join(
            f"SELECT '{x}' AS model, CAST(count(*) FILTER (WHERE will_subscribe = 1) AS DOUBLE) AS support_1, CAST(count(*) FILTER (WHERE will_subscribe = 0) AS DOUBLE) AS support_0, "
            f"true AS accuracy_agrees FROM survey WHERE {split_sql()} = 'test'"
            for x in _MODELS[:2]
        )
    ),
)
def reports_match_their_matrix(spark, sf_dir):
    """Supports of the report are the matrix's row sums, its accuracy the share of the diagonal."""
    parts = []
    for name, pred in (("Random Forest", m._rf(spark, sf_dir)[1]), ("Logistic Regression", m._lr(spark, sf_dir)[1])):
        cells = cls.confusion_matrix(pred, C.subscribe, "prediction")
        matrix = cells.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))) / F.sum("n")).alias("share")).scalar()
        report = cls.classification_report(pred, C.subscribe, "prediction")
        of = lambda i, c: F.max(F.when(F.col("position") == i, F.col(c)))
        row = report.agg(of(2, "support").alias("support_1"), of(1, "support").alias("support_0"), of(3, "precision").alias("accuracy")).withColumn("share", matrix)
        parts.append(row.select(F.lit(name).alias("model"), "support_1", "support_0", (F.abs(F.col("accuracy") - F.col("share")) < 0.00051).alias("accuracy_agrees")))
    return _union(parts)


_METHODS = ["K-Means", "Agglomerative (Ward)", "Bisecting K-Means"]


@register(
    "segment_sizes_add_up",
    with_survey(" UNION ALL ".join(f"SELECT '{x}' AS method, CAST(4 AS BIGINT) AS clusters, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT respondent_id) AS BIGINT) AS ids FROM survey" for x in _METHODS)),
)
def segment_sizes_add_up(spark, sf_dir):
    """Every respondent is in one cluster of each segmentation."""
    frames = [sg._kmeans(spark, sf_dir)[1], sg.ward_assignments(spark, sf_dir), sg.bisecting_assignments(spark, sf_dir)]
    counts = [F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("n"), F.count_distinct(C.id).alias("ids")]
    return _union([f.agg(*counts).select(F.lit(x).alias("method"), "*") for x, f in zip(_METHODS, frames, strict=True)])


@register("kmeans_nearest_centres", with_survey("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS not_nearest, true AS centres_are_means FROM survey"))
def kmeans_nearest_centres(spark, sf_dir):
    """A fixed point: every point is with its nearest centre, and the centres are their points' means (to the tolerance of the fit)."""
    _, points, model = sg._kmeans(spark, sf_dir)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    x = points.select("cluster", vector_to_array("features").alias("x"))
    square = lambda c: reduce(lambda a, b: a + b, [(F.col("x")[j] - F.lit(v)) * (F.col("x")[j] - F.lit(v)) for j, v in enumerate(c)])
    x = x.select("cluster", "x", F.array(*[square(c) for c in centres]).alias("d"))
    off = [F.abs(F.avg(F.when(F.col("cluster") == k, F.col("x")[j])) - F.lit(v)) for k, c in enumerate(centres) for j, v in enumerate(c)]
    row = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d")[F.col("cluster")] > F.array_min("d") + 1e-9).alias("not_nearest"), F.greatest(*off).alias("off"))
    return row.select("n", "not_nearest", (F.col("off") < 0.02).alias("centres_are_means"))


@register(
    "forecasts_by_tier_add_up",
    with_survey("SELECT CAST(count(*) AS BIGINT) AS n, true AS totals_agree FROM survey WHERE preferred_subscription_tier IN ('Free', 'Silver', 'Gold', 'Platinum')"),
)
def forecasts_by_tier_add_up(spark, sf_dir):
    """The tiers' totals of the boosted forecast are the total of all its predictions."""
    by_tier = m.gbt_forecast_by_tier(spark, sf_dir).agg(F.sum("n").alias("n"), F.sum("total_value").alias("t"))
    total = m._gbt(spark, sf_dir)[2].agg(F.sum("prediction")).scalar()
    return by_tier.select("n", (F.abs(F.col("t") - total) < 0.05).alias("totals_agree"))


@register("histograms_add_up", with_survey("SELECT CAST(30 AS BIGINT) AS bins, CAST(count(*) AS BIGINT) AS n FROM survey WHERE " + split_sql() + " = 'test'"))
def histograms_add_up(spark, sf_dir):
    h = fc.histogram(m._gbt(spark, sf_dir)[1], "prediction", 30)
    return h.agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n"))


@register("silhouettes_agree", "SELECT true AS evaluator_agrees, true AS in_range")
def silhouettes_agree(spark, sf_dir):
    """Our squared silhouette of the K-Means labels is Spark's."""
    _, a, _ = sg._kmeans(spark, sf_dir)
    ours = seg.silhouette(seg.features_to_columns(a, sg.FEATS), sg.FEATS, "cluster")
    theirs = seg.silhouette_spark(a, "cluster")
    return ours.select((F.abs(F.col("silhouette") - F.lit(theirs)) < 1e-6).alias("evaluator_agrees"), F.col("silhouette").between(-1, 1).alias("in_range"))

"""Classification and regression queries (M1-M10, R1-R9, A9).

Metric tables are checked against DuckDB on the rule-based predictions
(subscribe when WTP > 90; MRR forecast = 0.7 x WTP) over the same hash split;
the fitted models (random forest, logistic regression, boosting, OLS) are
checked by row counts.  Fits are shared by the queries of one session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.config import CLASS_NAMES, SURVEY, TIER_ORDER
from cohortlab.operators import aggregate as agg
from cohortlab.operators import boosting as bst
from cohortlab.operators import classify as cls
from cohortlab.operators import encode as enc
from cohortlab.operators import forecast as fc
from cohortlab.plans.encoding import split_sql
from cohortlab.plans.registry import cached, register, survey, table_name, use_materialized_survey
from cohortlab.plans.survey_sql import with_survey
from cohortlab.session import materialize

C = SURVEY
FEATS = list(C.model_features)
KEEP = [C.id, C.subscribe, C.mrr, C.tier]


def rule_pred():
    return F.when(F.coalesce(F.col(C.wtp), F.lit(0.0)) > 90, 1).otherwise(0)


def rule_mrr():
    return F.coalesce(F.col(C.wtp), F.lit(0.0)) * F.lit(0.7)


RULE_PRED_SQL = "CASE WHEN coalesce(wtp_monthly_usd, 0.0) > 90 THEN 1 ELSE 0 END"
RULE_MRR_SQL = "coalesce(wtp_monthly_usd, 0.0) * 0.7"
TEST_CTE = f"t AS (SELECT *, {RULE_PRED_SQL} AS pred, {RULE_MRR_SQL} AS pred_mrr FROM survey WHERE {split_sql()} = 'test')"


def model_frame(spark, sf_dir):
    """Encoded feature matrix with the hash split, written once per session and state of the data: every fit and every prediction reads it."""

    def build():
        return materialize(enc.train_test_split(enc.feature_matrix(use_materialized_survey(spark, sf_dir), keep=KEEP), C.id), table_name(sf_dir, "model_frame"))

    return cached(spark, sf_dir, "model_frame", build)


def _test_rule(spark, sf_dir):
    s = enc.train_test_split(survey(spark, sf_dir), C.id)
    return s.where(F.col("split") == "test").select("*", rule_pred().alias("pred"), rule_mrr().alias("pred_mrr"))


# ----------------------------------------------------------------------------- oracled metric tables
def _cc_sql() -> str:
    return (
        "cc AS (SELECT count(*) FILTER (WHERE will_subscribe = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE will_subscribe = 0 AND pred = 1) AS fp, "
        "count(*) FILTER (WHERE will_subscribe = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE will_subscribe = 0 AND pred = 0) AS tn, "
        "count(*) FILTER (WHERE NOT coalesce(will_subscribe IN (0, 1) AND pred IN (0, 1), false)) AS unscored FROM t)"
    )


def _r(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


_P1, _R1 = _r("tp", "tp + fp"), _r("tp", "tp + fn")
_P0, _R0 = _r("tn", "tn + fn"), _r("tn", "tn + fp")


@register(
    "classification_metrics",
    with_survey(
        f"""SELECT round_even({_r('tp + tn', 'tp + fp + fn + tn')}, 4) AS accuracy, round_even({_P1}, 4) AS precision,
       round_even({_R1}, 4) AS recall, round_even({_r(f'2.0 * ({_P1}) * ({_R1})', f'({_P1}) + ({_R1})')}, 4) AS f1,
       CAST(tp + fp + fn + tn AS BIGINT) AS n, CAST(unscored AS BIGINT) AS unscored FROM cc""",
        TEST_CTE,
        _cc_sql(),
    ),
)
def classification_metrics(spark, sf_dir):
    return cls.binary_metrics(_test_rule(spark, sf_dir), C.subscribe, "pred")


@register(
    "confusion_matrix",
    with_survey(
        "SELECT 0 AS actual, 0 AS predicted, CAST(tn AS BIGINT) AS n FROM cc UNION ALL SELECT 0, 1, CAST(fp AS BIGINT) FROM cc "
        "UNION ALL SELECT 1, 0, CAST(fn AS BIGINT) FROM cc UNION ALL SELECT 1, 1, CAST(tp AS BIGINT) FROM cc",
        TEST_CTE,
        _cc_sql(),
    ),
)
def confusion_matrix(spark, sf_dir):
    return cls.confusion_matrix(_test_rule(spark, sf_dir), C.subscribe, "pred")


# ----------------------------------------------------------------------------- more than two labels
#: Predicted tier by willingness to pay; no prediction without it.
_TIER_PRED_SQL = "CASE WHEN wtp_monthly_usd > 120 THEN 'Platinum' WHEN wtp_monthly_usd > 70 THEN 'Gold' WHEN wtp_monthly_usd > 20 THEN 'Silver' WHEN wtp_monthly_usd <= 20 THEN 'Basic' END"
_TIER_CTE = f"tp AS (SELECT preferred_subscription_tier AS actual, {_TIER_PRED_SQL} AS predicted FROM survey)"
_LABELS_CTE = "labs AS (SELECT actual AS lab FROM tp WHERE actual IS NOT NULL UNION SELECT predicted FROM tp WHERE predicted IS NOT NULL)"


def _tier_predictions(spark, sf_dir):
    w = F.col(C.wtp)
    pred = F.when(w > 120, "Platinum").when(w > 70, "Gold").when(w > 20, "Silver").when(w <= 20, "Basic")
    return survey(spark, sf_dir).select(F.col(C.tier).alias("actual"), pred.alias("predicted"))


@register(
    "tier_confusion",
    with_survey(
        "SELECT a.lab AS actual, p.lab AS predicted, CAST(count(tp.actual) AS BIGINT) AS n FROM labs a CROSS JOIN labs p LEFT JOIN tp ON tp.actual = a.lab AND tp.predicted = p.lab "
        "GROUP BY 1, 2 UNION ALL SELECT actual, predicted, CAST(count(*) AS BIGINT) FROM tp WHERE actual IS NULL OR predicted IS NULL GROUP BY 1, 2",
        _TIER_CTE,
        _LABELS_CTE,
    ),
)
def tier_confusion(spark, sf_dir):
    """A five-label matrix (one label is never actual, one never predicted) with the rows that have no prediction."""
    return cls.confusion_table(_tier_predictions(spark, sf_dir), "actual", "predicted")


_TIER_REPORT_CTES = [
    _TIER_CTE,
    _LABELS_CTE,
    "sc AS (SELECT * FROM tp WHERE actual IS NOT NULL AND predicted IS NOT NULL)",
    "e AS (SELECT lab, (SELECT count(*) FROM sc WHERE actual = lab) AS s, (SELECT count(*) FROM sc WHERE predicted = lab) AS q, "
    "(SELECT count(*) FROM sc WHERE actual = lab AND predicted = lab) AS h FROM labs WHERE lab IN (SELECT actual FROM sc UNION SELECT predicted FROM sc))",
    "m AS (SELECT lab, s, h, CASE WHEN q > 0 THEN h / q ELSE 0.0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0.0 END AS r FROM e)",
    "f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM m)",
]


@register(
    "tier_report",
    with_survey(
        """
SELECT 'label' AS kind, lab AS label, round_even(p, 3) AS precision, round_even(r, 3) AS recall, round_even(f, 3) AS f1_score, CAST(s AS DOUBLE) AS support FROM f
UNION ALL SELECT 'summary', 'accuracy', round_even(sum(h) / sum(s), 3), round_even(sum(h) / sum(s), 3), round_even(sum(h) / sum(s), 3), round_even(sum(h) / sum(s), 3) FROM f
UNION ALL SELECT 'summary', 'macro avg', round_even(avg(p), 3), round_even(avg(r), 3), round_even(avg(f), 3), CAST(sum(s) AS DOUBLE) FROM f
UNION ALL SELECT 'summary', 'weighted avg', round_even(sum(p * s) / sum(s), 3), round_even(sum(r * s) / sum(s), 3), round_even(sum(f * s) / sum(s), 3), CAST(sum(s) AS DOUBLE) FROM f
UNION ALL SELECT 'summary', 'unscored', NULL, NULL, NULL, CAST(count(*) AS DOUBLE) FROM tp WHERE actual IS NULL OR predicted IS NULL""",
        *_TIER_REPORT_CTES,
    ),
)
def tier_report(spark, sf_dir):
    return cls.label_report(_tier_predictions(spark, sf_dir), "actual", "predicted")


def _report_sql() -> str:
    f1_1 = _r(f"2.0 * ({_P1}) * ({_R1})", f"({_P1}) + ({_R1})")
    f1_0 = _r(f"2.0 * ({_P0}) * ({_R0})", f"({_P0}) + ({_R0})")
    n = "CAST(tp + fp + fn + tn AS DOUBLE)"
    s1, s0 = "CAST(tp + fn AS DOUBLE)", "CAST(tn + fp AS DOUBLE)"
    acc = _r("tp + tn", n)
    rows = [
        (1, CLASS_NAMES[0], _P0, _R0, f1_0, s0),
        (2, CLASS_NAMES[1], _P1, _R1, f1_1, s1),
        (3, "accuracy", acc, acc, acc, acc),
        (4, "macro avg", f"(({_P0}) + ({_P1})) / 2", f"(({_R0}) + ({_R1})) / 2", f"(({f1_0}) + ({f1_1})) / 2", n),
        (5, "weighted avg", _r(f"({_P0}) * {s0} + ({_P1}) * {s1}", n), _r(f"({_R0}) * {s0} + ({_R1}) * {s1}", n),
         _r(f"({f1_0}) * {s0} + ({f1_1}) * {s1}", n), n),
    ]
    body = " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS label, round_even({p}, 3) AS precision, round_even({rc}, 3) AS recall, "
        f"round_even({f}, 3) AS f1_score, round_even({s}, 3) AS support FROM cc"
        for i, name, p, rc, f, s in rows
    )
    return with_survey(body, TEST_CTE, _cc_sql())


@register("classification_report", _report_sql())
def classification_report(spark, sf_dir):
    return cls.classification_report(_test_rule(spark, sf_dir), C.subscribe, "pred")


@register(
    "regression_metrics",
    with_survey(
        f"""SELECT round(avg(abs(estimated_mrr_usd - pred_mrr)), 6) AS mae,
       round(CASE WHEN sum((estimated_mrr_usd - m) * (estimated_mrr_usd - m)) > 0
             THEN 1 - sum((estimated_mrr_usd - pred_mrr) * (estimated_mrr_usd - pred_mrr)) / sum((estimated_mrr_usd - m) * (estimated_mrr_usd - m))
             ELSE 0.0 END, 6) AS r2,
       round(avg(pred_mrr), 6) AS avg_predicted, round(sum(pred_mrr), 6) AS total_predicted, CAST(count(*) AS BIGINT) AS n
FROM t, (SELECT avg(estimated_mrr_usd) AS m FROM t)""",
        TEST_CTE,
    ),
)
def regression_metrics(spark, sf_dir):
    m = fc.regression_metrics(_test_rule(spark, sf_dir), C.mrr, "pred_mrr")
    return m.select(*[F.round(x, 6).alias(x) for x in ("mae", "r2", "avg_predicted", "total_predicted")], "n")


@register(
    "forecast_kpis",
    with_survey("SELECT round_even(avg(pred_mrr), 2) AS avg_predicted_mrr, round_even(sum(pred_mrr), 2) AS total_predicted_mrr FROM t", TEST_CTE),
)
def forecast_kpis(spark, sf_dir):
    t = _test_rule(spark, sf_dir)
    return t.agg(F.bround(F.avg("pred_mrr"), 2).alias("avg_predicted_mrr"), F.bround(F.sum("pred_mrr"), 2).alias("total_predicted_mrr"))


@register(
    "fit_limits",
    with_survey("SELECT least(min(estimated_mrr_usd), min(pred_mrr)) AS lo, greatest(max(estimated_mrr_usd), max(pred_mrr)) AS hi FROM t", TEST_CTE),
)
def fit_limits(spark, sf_dir):
    return fc.fit_limits(_test_rule(spark, sf_dir), C.mrr, "pred_mrr")


def _hist_sql(col: str) -> str:
    return with_survey(
        f"""
SELECT CAST(g.i AS INTEGER) AS bin, r.lo + ((r.hi - r.lo) / 30.0) * g.i AS bin_start, r.lo + ((r.hi - r.lo) / 30.0) * (g.i + 1) AS bin_end,
       CAST(count(h.b) AS BIGINT) AS n
FROM range(30) g(i)
CROSS JOIN (SELECT min({col}) AS lo, max({col}) AS hi FROM t) r
LEFT JOIN (SELECT CASE WHEN r2.hi = r2.lo THEN 0 ELSE least(floor(({col} - r2.lo) / (r2.hi - r2.lo) * 30), 29) END AS b
           FROM t, (SELECT min({col}) AS lo, max({col}) AS hi FROM t) r2 WHERE {col} IS NOT NULL) h ON h.b = g.i
GROUP BY g.i, r.lo, r.hi""",
        TEST_CTE,
    )


@register("histogram_actual", _hist_sql("estimated_mrr_usd"))
def histogram_actual(spark, sf_dir):
    return fc.histogram(_test_rule(spark, sf_dir), C.mrr, 30)


@register("histogram_predicted", _hist_sql("pred_mrr"))
def histogram_predicted(spark, sf_dir):
    return fc.histogram(_test_rule(spark, sf_dir), "pred_mrr", 30)


def _tier_sql() -> str:
    parts = [
        f"SELECT {i + 1} AS position, '{t}' AS preferred_subscription_tier, round_even(avg(p) FILTER (WHERE preferred_subscription_tier = '{t}'), 2) AS avg_value, "
        f"round_even(sum(p) FILTER (WHERE preferred_subscription_tier = '{t}'), 2) AS total_value, "
        f"CAST(nullif(count(p) FILTER (WHERE preferred_subscription_tier = '{t}'), 0) AS BIGINT) AS n FROM a"
        for i, t in enumerate(TIER_ORDER)
    ]
    return with_survey(" UNION ALL ".join(parts), f"a AS (SELECT preferred_subscription_tier, {RULE_MRR_SQL} AS p FROM survey)")


@register("forecast_by_tier", _tier_sql())
def forecast_by_tier(spark, sf_dir):
    s = survey(spark, sf_dir)
    return agg.ordered_group_stats(s, C.tier, rule_mrr(), TIER_ORDER)


# ----------------------------------------------------------------------------- fitted models (rows-only)
def _split(spark, sf_dir):
    m = model_frame(spark, sf_dir)
    return m.where(F.col("split") == "train"), m.where(F.col("split") == "test"), m


def _rf(spark, sf_dir):
    train, test, _ = _split(spark, sf_dir)
    model = cached(spark, sf_dir, "fit_rf", lambda: cls.fit_random_forest(train, FEATS, C.subscribe))
    return model, cls.predict_rf(model, test, FEATS, [C.id, C.subscribe])


def _lr(spark, sf_dir):
    train, test, _ = _split(spark, sf_dir)
    model, stats = cached(spark, sf_dir, "fit_lr", lambda: cls.fit_logistic(train, FEATS, C.subscribe))
    return model, cls.predict_logistic(model, stats, test, FEATS, [C.id, C.subscribe])


def _gbt(spark, sf_dir):
    train, test, allrows = _split(spark, sf_dir)
    model = cached(spark, sf_dir, "fit_gbt", lambda: bst.fit_boosting(train, FEATS, C.mrr))
    return model, bst.predict_boosting(model, test, FEATS, [C.id, C.mrr]), bst.predict_boosting(model, allrows, FEATS, [C.id, C.mrr, C.tier])


def _ols(spark, sf_dir):
    train, test, _ = _split(spark, sf_dir)
    model, stats = cached(spark, sf_dir, "fit_ols", lambda: fc.fit_linear(train, FEATS, C.mrr))
    return model, fc.predict_linear(model, stats, test, FEATS, [C.id, C.mrr])


@register("rf_predictions")
def rf_predictions(spark, sf_dir):
    return _rf(spark, sf_dir)[1]


@register("lr_predictions")
def lr_predictions(spark, sf_dir):
    return _lr(spark, sf_dir)[1]


@register("feature_importance")
def feature_importance(spark, sf_dir):
    return cls.feature_importance(_rf(spark, sf_dir)[0], FEATS, spark)


def _cls_comparison(spark, sf_dir):
    return cls.compare(
        {
            "Random Forest": cls.binary_metrics(_rf(spark, sf_dir)[1], C.subscribe, "prediction"),
            "Logistic Regression": cls.binary_metrics(_lr(spark, sf_dir)[1], C.subscribe, "prediction"),
        },
        "f1",
        "Random Forest",
    )


@register("model_comparison")
def model_comparison(spark, sf_dir):
    return _cls_comparison(spark, sf_dir)


@register("rf_confusion_matrix")
def rf_confusion_matrix(spark, sf_dir):
    return cls.confusion_matrix(_rf(spark, sf_dir)[1], C.subscribe, "prediction")


@register("rf_classification_report")
def rf_classification_report(spark, sf_dir):
    return cls.classification_report(_rf(spark, sf_dir)[1], C.subscribe, "prediction")


@register("lr_confusion_matrix")
def lr_confusion_matrix(spark, sf_dir):
    return cls.confusion_matrix(_lr(spark, sf_dir)[1], C.subscribe, "prediction")


@register("lr_classification_report")
def lr_classification_report(spark, sf_dir):
    return cls.classification_report(_lr(spark, sf_dir)[1], C.subscribe, "prediction")


@register("gbt_predictions")
def gbt_predictions(spark, sf_dir):
    return _gbt(spark, sf_dir)[1]


@register(
    "gbt_loss_falls",
    "SELECT CAST(t AS INTEGER) AS tree, true AS falls FROM range(1, 101) x(t)",
)
def gbt_loss_falls(spark, sf_dir):
    """Whether every tree lowers the sum of squared residuals on the training rows."""
    losses = _gbt(spark, sf_dir)[0].losses
    return spark.createDataFrame([(i, losses[i] < losses[i - 1]) for i in range(1, len(losses))], "tree int, falls boolean")


@register("gbt_mean_residual", with_survey("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mean_residual FROM survey WHERE " + split_sql() + " = 'train' AND estimated_mrr_usd IS NOT NULL"))
def gbt_mean_residual(spark, sf_dir):
    """Boosting from the mean keeps the residuals of the training rows centred."""
    train, _, _ = _split(spark, sf_dir)
    p = bst.predict_boosting(_gbt(spark, sf_dir)[0], train, FEATS, [C.mrr])
    return p.agg(F.count("prediction").alias("n"), (F.round(F.avg(F.col(C.mrr) - F.col("prediction")), 6) + F.lit(0.0)).alias("mean_residual"))


@register("linreg_predictions")
def linreg_predictions(spark, sf_dir):
    return _ols(spark, sf_dir)[1]


@register("gbt_metrics")
def gbt_metrics(spark, sf_dir):
    return fc.regression_metrics(_gbt(spark, sf_dir)[1], C.mrr, "prediction")


@register("gbt_forecast_by_tier")
def gbt_forecast_by_tier(spark, sf_dir):
    """Prediction over all rows (training rows included), per tier in fixed order."""
    return agg.ordered_group_stats(_gbt(spark, sf_dir)[2], C.tier, "prediction", TIER_ORDER)


@register("gbt_fit_limits")
def gbt_fit_limits(spark, sf_dir):
    return fc.fit_limits(_gbt(spark, sf_dir)[1], C.mrr, "prediction")


@register("linreg_fit_limits")
def linreg_fit_limits(spark, sf_dir):
    return fc.fit_limits(_ols(spark, sf_dir)[1], C.mrr, "prediction")


@register("gbt_histogram")
def gbt_histogram(spark, sf_dir):
    return fc.histogram(_gbt(spark, sf_dir)[1], "prediction", 30)


def _reg_comparison(spark, sf_dir):
    return cls.compare(
        {
            "Gradient Boosting": fc.regression_metrics(_gbt(spark, sf_dir)[1], C.mrr, "prediction"),
            "Linear Regression": fc.regression_metrics(_ols(spark, sf_dir)[1], C.mrr, "prediction"),
        },
        "r2",
        "Gradient Boosting",
    )


@register("regression_comparison")
def regression_comparison(spark, sf_dir):
    return _reg_comparison(spark, sf_dir)


def _both(df, key: str, score: str, one: str, two: str, analysis: str, metric: str):
    """One row of the summary from a comparison of two rows."""
    value = lambda name: F.max(F.when(F.col(key) == name, F.col(score).cast("double")))
    row = df.agg(value(one).alias("value_a"), value(two).alias("value_b"), F.max("winner").alias("winner"))
    names = [F.lit(x).alias(c) for x, c in ((analysis, "analysis"), (one, "algorithm_a"), (two, "algorithm_b"), (metric, "metric"))]
    return row.select(*names, "value_a", "value_b", "winner")


@register("algorithm_summary")
def algorithm_summary(spark, sf_dir):
    """One row per method family: the two algorithms, the key metric of each and the winner - four comparisons of two rows each, put together by the plan."""
    from cohortlab.plans.bundles import miner_comparison
    from cohortlab.plans.segments import clustering_comparison

    rules = miner_comparison(spark, sf_dir)
    first = F.when(F.max(F.when(F.col("method") == "Apriori", F.col("rules"))) >= F.max(F.when(F.col("method") == "FP-Growth", F.col("rules"))), "Apriori").otherwise("FP-Growth")
    rules = rules.withColumn("winner", rules.agg(first).scalar())
    parts = [
        _both(_cls_comparison(spark, sf_dir), "model", "f1", "Random Forest", "Logistic Regression", "Classification", "F1"),
        _both(clustering_comparison(spark, sf_dir), "method", "silhouette", "K-Means", "Agglomerative (Ward)", "Clustering", "Silhouette (Euclidean)"),
        _both(rules, "method", "rules", "Apriori", "FP-Growth", "Association Rules", "Rules"),
        _both(_reg_comparison(spark, sf_dir), "model", "r2", "Gradient Boosting", "Linear Regression", "Regression", "R2"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("chosen_model_logistic")
def chosen_model_logistic(spark, sf_dir):
    """The classification tab with one model chosen: its metrics alone (the other is not fitted)."""
    train, test, _ = _split(spark, sf_dir)
    return cls.train_and_score(train, test, FEATS, C.subscribe, "lr")


@register(
    "chosen_model_rows",
    with_survey("SELECT 'Logistic Regression' AS model, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS unscored FROM survey WHERE " + split_sql() + " = 'test'"),
)
def chosen_model_rows(spark, sf_dir):
    """Every test row is scored by the chosen model."""
    return chosen_model_logistic(spark, sf_dir).select("model", "n", "unscored")

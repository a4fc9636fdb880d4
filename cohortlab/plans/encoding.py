"""Encoding queries (E1-E9) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.config import ORDINAL_SCALES, SURVEY
from cohortlab.functions.exprs import split_threshold
from cohortlab.operators import encode as enc
from cohortlab.plans.registry import register, survey
from cohortlab.plans.survey_sql import with_survey

C = SURVEY
SCALE = list(C.scale_cols)
NOMINAL = list(C.nominal)


def ord_sql(c: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDINAL_SCALES[c].items())
    return f"CAST(CASE {c} {whens} ELSE 0 END AS INTEGER)"


def enc_sql(c: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 AS INTEGER)"


def encoded_cte() -> str:
    """``enc``: survey + _ord + _enc columns."""
    ords = ", ".join(f"{ord_sql(c)} AS {c}_ord" for c in ORDINAL_SCALES)
    encs = ", ".join(f"{enc_sql(c)} AS {c}_enc" for c in NOMINAL)
    return f"enc AS (SELECT *, {ords}, {encs} FROM survey)"


def features_cte() -> str:
    """``fm``: respondent_id, targets and the 21 model features as doubles (missing -> 0)."""
    feats = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in C.model_features)
    return f"fm AS (SELECT respondent_id, will_subscribe, estimated_mrr_usd, preferred_subscription_tier, {feats} FROM enc)"


def split_sql(key: str = "respondent_id", fraction: float = 0.2, seed: int = 42) -> str:
    h = f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
    return f"CASE WHEN {h} < {split_threshold(fraction)} THEN 'test' ELSE 'train' END"


@register(
    "ordinal_encode",
    with_survey("SELECT respondent_id, " + ", ".join(f"{ord_sql(c)} AS {c}_ord" for c in ORDINAL_SCALES) + " FROM survey"),
)
def ordinal_encode(spark, sf_dir):
    return enc.ordinal_encode(survey(spark, sf_dir)).select(C.id, *[f"{c}_ord" for c in ORDINAL_SCALES])


@register(
    "label_encode",
    with_survey("SELECT respondent_id, " + ", ".join(f"{enc_sql(c)} AS {c}_enc" for c in NOMINAL) + " FROM survey"),
)
def label_encode(spark, sf_dir):
    return enc.label_encode(survey(spark, sf_dir), NOMINAL).select(C.id, *[f"{c}_enc" for c in NOMINAL])


@register(
    "category_catalog",
    with_survey(
        " UNION ALL ".join(
            f"SELECT {i + 1} AS position, '{c}' AS feature, CAST(count(DISTINCT coalesce({c}, 'nan')) AS BIGINT) AS n_categories, "
            f"array_to_string(list_slice(list_sort(list(DISTINCT coalesce({c}, 'nan'))), 1, 3), ', ') || "
            f"CASE WHEN count(DISTINCT coalesce({c}, 'nan')) > 3 THEN '...' ELSE '' END AS example_classes FROM survey"
            for i, c in enumerate(NOMINAL)
        )
    ),
)
def category_catalog(spark, sf_dir):
    return enc.category_catalog(survey(spark, sf_dir), NOMINAL)


def _z_sql(c: str) -> str:
    return (
        f"round(CASE WHEN {c} IS NULL THEN NULL WHEN (SELECT stddev_pop({c}) FROM survey) = 0 THEN 0.0 "
        f"ELSE ({c} - (SELECT avg({c}) FROM survey)) / (SELECT stddev_pop({c}) FROM survey) END, 6) AS {c}"
    )


@register("standardize", with_survey("SELECT respondent_id, " + ", ".join(_z_sql(c) for c in SCALE) + " FROM survey"))
def standardize(spark, sf_dir):
    z = enc.standardize(survey(spark, sf_dir), SCALE, keep=[C.id])
    return z.select(C.id, *[F.round(c, 6).alias(c) for c in SCALE])


def _zc(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN (SELECT stddev_pop({c}) FROM survey) = 0 THEN 0.0 "
        f"ELSE ({c} - (SELECT avg({c}) FROM survey)) / (SELECT stddev_pop({c}) FROM survey) END"
    )


@register(
    "scale_check",
    with_survey(
        " UNION ALL ".join(
            f"SELECT {i + 1} AS position, '{c}' AS feature, round_even(avg({c}), 2) + 0.0 AS mean_before, round_even(stddev_samp({c}), 2) + 0.0 AS std_before, "
            f"round_even(avg({_zc(c)}), 4) + 0.0 AS mean_after, round_even(stddev_samp({_zc(c)}), 4) + 0.0 AS std_after FROM survey"
            for i, c in enumerate(SCALE)
        )
    ),
)
def scale_check(spark, sf_dir):
    return enc.scale_check(survey(spark, sf_dir), SCALE)


@register(
    "feature_matrix",
    with_survey("SELECT respondent_id, " + ", ".join(C.model_features) + " FROM fm", encoded_cte(), features_cte()),
)
def feature_matrix(spark, sf_dir):
    return enc.feature_matrix(survey(spark, sf_dir), keep=[C.id])


@register("train_test_split", with_survey(f"SELECT respondent_id, {split_sql()} AS split FROM survey"))
def train_test_split(spark, sf_dir):
    return enc.train_test_split(survey(spark, sf_dir).select(C.id), C.id)


@register(
    "train_test_sizes",
    with_survey(f"SELECT {split_sql()} AS split, CAST(count(*) AS BIGINT) AS n FROM survey GROUP BY 1"),
)
def train_test_sizes(spark, sf_dir):
    s = enc.train_test_split(survey(spark, sf_dir).select(C.id), C.id)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_score = (
    f"CAST({ord_sql('trust_concern_frequency')} AS DOUBLE) * 0.25 + CAST({ord_sql('difficulty_finding_tools')} AS DOUBLE) * 0.25 + "
    f"CAST({ord_sql('subscription_fatigue')} AS DOUBLE) * 0.25 + CAST({ord_sql('preferred_subscription_tier')} AS DOUBLE) * 0.25"
)
_churn = (
    f"least(greatest(1.0 - CAST({ord_sql('preferred_subscription_tier')} AS DOUBLE) / 3.0 * 0.4 + "
    f"CASE WHEN preferred_billing_cadence = 'Monthly' THEN 0.1 ELSE 0.0 END + 0.05 * CAST({ord_sql('subscription_fatigue')} AS DOUBLE), 0.0), 1.0)"
)


@register(
    "derive_targets",
    with_survey(
        f"""
SELECT respondent_id, round(s, 6) AS subscription_score, CASE WHEN s > 3.2 THEN 1 ELSE 0 END AS will_subscribe_derived,
       round(ch, 6) AS churn_risk_derived,
       round(coalesce(wtp_monthly_usd, 0.0) * CASE WHEN s > 3.2 THEN 1 ELSE 0 END *
         coalesce(CASE preferred_billing_cadence WHEN 'Monthly' THEN 1.0 WHEN 'Half-Yearly' THEN 0.9 WHEN 'Yearly' THEN 0.8 END, 1.0), 6) AS estimated_mrr_derived
FROM (SELECT *, {_score} AS s, {_churn} AS ch FROM survey)"""
    ),
)
def derive_targets(spark, sf_dir):
    d = enc.derive_targets(survey(spark, sf_dir))
    return d.select(
        C.id,
        F.round("subscription_score", 6).alias("subscription_score"),
        "will_subscribe_derived",
        F.round("churn_risk_derived", 6).alias("churn_risk_derived"),
        F.round("estimated_mrr_derived", 6).alias("estimated_mrr_derived"),
    )


@register(
    "exact_split",
    with_survey(
        "SELECT respondent_id, CASE WHEN row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || CAST(respondent_id AS VARCHAR)), 1, 8) AS BIGINT), respondent_id) "
        "<= ceil(0.2 * (SELECT count(*) FROM survey)) THEN 'test' ELSE 'train' END AS split FROM survey"
    ),
)
def exact_split(spark, sf_dir):
    """Exactly ceil(0.2 n) test rows."""
    return enc.exact_split(survey(spark, sf_dir).select(C.id), C.id)


def _uniform_sql(stream: int) -> str:
    return f"((CAST('0x' || substr(md5('42:{stream}:' || CAST(respondent_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _normal_sql(stream: int) -> str:
    return f"sqrt(-2.0 * ln({_uniform_sql(2 * stream)})) * cos(2 * pi() * {_uniform_sql(2 * stream + 1)})"


@register("noise_columns", with_survey(f"SELECT respondent_id, round({_uniform_sql(0)}, 9) AS u, round({_normal_sql(0)}, 6) AS z FROM survey"))
def noise_columns(spark, sf_dir):
    """A uniform and a normal number for every respondent."""
    from cohortlab.functions.exprs import normal, uniform

    return survey(spark, sf_dir).select(C.id, F.round(uniform(C.id), 9).alias("u"), F.round(normal(C.id), 6).alias("z"))


@register(
    "derive_targets_noisy",
    with_survey(
        f"""
SELECT respondent_id, round(s, 6) AS subscription_score, CASE WHEN s > 3.2 THEN 1 ELSE 0 END AS will_subscribe_derived,
       round(least(greatest(ch, 0.0), 1.0), 6) AS churn_risk_derived
FROM (SELECT *, {_score} + 0.3 * {_normal_sql(0)} AS s,
        1.0 - CAST({ord_sql('preferred_subscription_tier')} AS DOUBLE) / 3.0 * 0.4 + CASE WHEN preferred_billing_cadence = 'Monthly' THEN 0.1 ELSE 0.0 END
        + 0.05 * CAST({ord_sql('subscription_fatigue')} AS DOUBLE) + 0.03 * {_normal_sql(1)} AS ch FROM survey)"""
    ),
)
def derive_targets_noisy(spark, sf_dir):
    d = enc.derive_targets(survey(spark, sf_dir), noise=0.3)
    rounded = [F.round(c, 6).alias(c) for c in ("subscription_score", "churn_risk_derived")]
    return d.select(C.id, "will_subscribe_derived", *rounded)

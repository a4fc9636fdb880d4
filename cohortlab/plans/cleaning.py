"""Cleaning-tab queries (Q1-Q14, D1-D3, O1-O4) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.config import (
    ACTION_IMPUTE,
    ACTION_NONE,
    CHECK_CHURN_RANGE,
    CHECK_FLAGS,
    CHECK_FREE_WTP,
    CHECK_NEG_SPEND,
    CHECK_NONSUB_MRR,
    OUTLIER_CAP,
    OUTLIER_RETAIN,
    SURVEY,
    TOOL_LABELS,
)
from cohortlab.operators import profile as prof
from cohortlab.plans.registry import dirty, register, survey
from cohortlab.plans.survey_sql import with_survey
from cohortlab.sources.survey import SURVEY_COLUMNS

C = SURVEY
INT_COLS = {"respondent_id", "num_ai_tools_currently_used", "will_subscribe", *TOOL_LABELS}
FLOAT_COLS = {"monthly_spend_on_ai_usd", "wtp_monthly_usd", "churn_risk_score", "estimated_mrr_usd"}


def _dtype(c: str) -> str:
    return "Integer" if c in INT_COLS else "Float" if c in FLOAT_COLS else "Categorical (string)"


# ----------------------------------------------------------------------------- missing values
def _missing_sql(view: str) -> str:
    parts = [
        f"SELECT {i + 1} AS position, '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing_count, "
        f"round_even(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS missing_pct, "
        f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN '{ACTION_NONE}' ELSE '{ACTION_IMPUTE}' END AS action FROM {view}"
        for i, c in enumerate(SURVEY_COLUMNS)
    ]
    return " UNION ALL ".join(parts)


@register("missing_profile", with_survey(_missing_sql("survey")))
def missing_profile(spark, sf_dir):
    return prof.missing_profile(survey(spark, sf_dir))


@register(
    "missing_total",
    with_survey("SELECT CAST(" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in SURVEY_COLUMNS) + " AS BIGINT) AS total_missing FROM survey"),
)
def missing_total(spark, sf_dir):
    return prof.missing_total(survey(spark, sf_dir))


# ----------------------------------------------------------------------------- column census
def _profile_sql() -> str:
    parts = [
        f"SELECT {i + 1} AS position, '{c}' AS feature, '{_dtype(c)}' AS dtype, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values, "
        f"arg_min_null(CAST({c} AS VARCHAR), respondent_id) AS sample, 'Correct' AS status FROM survey"
        for i, c in enumerate(SURVEY_COLUMNS)
    ]
    return " UNION ALL ".join(parts)


@register("column_profile", with_survey(_profile_sql()))
def column_profile(spark, sf_dir):
    return prof.column_profile(survey(spark, sf_dir), C.id)


@register(
    "type_census",
    with_survey(
        "SELECT (SELECT count(*) FROM survey) AS n_rows, CAST(count(*) FILTER (WHERE t IN ('BIGINT', 'INTEGER', 'DOUBLE')) AS BIGINT) AS n_numeric, "
        "CAST(count(*) FILTER (WHERE t = 'VARCHAR') AS BIGINT) AS n_text, "
        "CAST(count(*) FILTER (WHERE t NOT IN ('BIGINT', 'INTEGER', 'DOUBLE', 'VARCHAR')) AS BIGINT) AS n_other, CAST(count(*) AS BIGINT) AS n_columns FROM ty",
        "one AS (SELECT * FROM survey LIMIT 1)",
        "ty AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, typeof({c}) AS t FROM one" for c in SURVEY_COLUMNS) + ")",
    ),
)
def type_census(spark, sf_dir):
    return prof.type_census(survey(spark, sf_dir))


# ----------------------------------------------------------------------------- business rules
_flag_bad = " + ".join(f"count(*) FILTER (WHERE {f} IS NULL OR {f} NOT IN (0, 1))" for f in C.tools)
_RULES_SQL = [
    (CHECK_FREE_WTP[0], "count(*) FILTER (WHERE preferred_subscription_tier = 'Free' AND wtp_monthly_usd > 50)", CHECK_FREE_WTP[1]),
    (CHECK_NONSUB_MRR[0], "count(*) FILTER (WHERE will_subscribe = 0 AND estimated_mrr_usd > 0)", CHECK_NONSUB_MRR[1]),
    (CHECK_CHURN_RANGE[0], "count(*) FILTER (WHERE churn_risk_score < 0 OR churn_risk_score > 1)", CHECK_CHURN_RANGE[1]),
    (CHECK_NEG_SPEND[0], "count(*) FILTER (WHERE monthly_spend_on_ai_usd < 0)", CHECK_NEG_SPEND[1]),
    (CHECK_FLAGS[0], _flag_bad, CHECK_FLAGS[1]),
]


def _checks_sql(view: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{name}' AS \"check\", CAST({expr} AS BIGINT) AS flagged, '{act}' AS action, "
        f"CASE WHEN {expr} > 0 THEN 'Found' ELSE 'Clean' END AS status FROM {view}"
        for i, (name, expr, act) in enumerate(_RULES_SQL)
    )


@register("consistency_checks", with_survey(_checks_sql("survey")))
def consistency_checks(spark, sf_dir):
    return prof.run_checks(survey(spark, sf_dir), prof.survey_rules())


@register("consistency_checks_dirty", with_survey(_checks_sql("survey_dirty"), dirty=True))
def consistency_checks_dirty(spark, sf_dir):
    return prof.run_checks(dirty(spark, sf_dir), prof.survey_rules())


@register(
    "checks_passed",
    with_survey(
        "SELECT CAST(count(*) FILTER (WHERE status = 'Clean') AS BIGINT) AS checks_passed, CAST(count(*) AS BIGINT) AS checks_total FROM ch",
        "ch AS (" + _checks_sql("survey") + ")",
    ),
)
def checks_passed(spark, sf_dir):
    return prof.checks_passed(prof.run_checks(survey(spark, sf_dir), prof.survey_rules()))


# ----------------------------------------------------------------------------- duplicates
_others = ", ".join(c for c in SURVEY_COLUMNS if c != "respondent_id")


@register(
    "duplicate_profile",
    with_survey(
        f"""
SELECT 1 AS position, 'full_row' AS kind, CAST((SELECT count(*) FROM survey_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM survey_dirty)) AS BIGINT) AS n_duplicates
UNION ALL SELECT 2, 'id', CAST((SELECT count(*) FROM survey_dirty) - (SELECT count(DISTINCT respondent_id) FROM survey_dirty) AS BIGINT)
UNION ALL SELECT 3, 'answers_without_id', CAST((SELECT count(*) FROM survey_dirty) - (SELECT count(*) FROM (SELECT DISTINCT {_others} FROM survey_dirty)) AS BIGINT)""",
        dirty=True,
    ),
)
def duplicate_profile(spark, sf_dir):
    return prof.duplicate_profile(dirty(spark, sf_dir), C.id)


@register("dedup_rows", with_survey("SELECT DISTINCT * FROM survey_dirty", dirty=True))
def dedup_rows(spark, sf_dir):
    return prof.drop_duplicates_exact(dirty(spark, sf_dir))


# ----------------------------------------------------------------------------- outliers
OUT = list(C.outlier_cols)


def _fences_cte(view: str = "survey") -> str:
    parts = [
        f"SELECT {i + 1} AS position, '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {view}"
        for i, c in enumerate(OUT)
    ]
    return (
        "fq AS (" + " UNION ALL ".join(parts) + "), fences AS (SELECT position, feature, q1, q3, q3 - q1 AS iqr, "
        "q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM fq)"
    )


@register(
    "iqr_fences",
    with_survey(
        "SELECT position, feature, round_even(q1, 2) AS q1, round_even(q3, 2) AS q3, round_even(iqr, 2) AS iqr, "
        "round_even(lower_fence, 2) AS lower_fence, round_even(upper_fence, 2) AS upper_fence FROM fences",
        _fences_cte(),
    ),
)
def iqr_fences(spark, sf_dir):
    f = prof.iqr_fences(survey(spark, sf_dir), OUT)
    return f.select("position", "feature", *[F.bround(x, 2).alias(x) for x in ["q1", "q3", "iqr", "lower_fence", "upper_fence"]])


def _fence(c: str, which: str) -> str:
    return f"(SELECT {which} FROM fences WHERE feature = '{c}')"


_out_counts = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < {_fence(c, 'lower_fence')} OR {c} > {_fence(c, 'upper_fence')}) AS outliers, count(*) AS n FROM survey"
    for c in OUT
)


@register(
    "outlier_summary",
    with_survey(
        """
SELECT f.position, f.feature, round_even(q1, 2) AS q1, round_even(q3, 2) AS q3, round_even(lower_fence, 2) AS lower_fence,
       round_even(upper_fence, 2) AS upper_fence, CAST(o.outliers AS BIGINT) AS outliers,
       printf('%.1f%%', round_even(o.outliers / o.n * 100, 1)) AS outlier_pct,
       CASE WHEN o.outliers / o.n * 100 > 1 THEN '""" + OUTLIER_CAP + """' ELSE '""" + OUTLIER_RETAIN + """' END AS action
FROM fences f JOIN oc o ON f.feature = o.feature""",
        _fences_cte(),
        "oc AS (" + _out_counts + ")",
    ),
)
def outlier_summary(spark, sf_dir):
    return prof.outlier_summary(survey(spark, sf_dir), OUT)


def _clip_sql(c: str) -> str:
    lo, hi = _fence(c, "lower_fence"), _fence(c, "upper_fence")
    x = f"CAST({c} AS DOUBLE)"
    return f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


@register(
    "winsorize",
    with_survey("SELECT " + ", ".join(f"round({_clip_sql(c)}, 6) AS {c}" if c in OUT else c for c in SURVEY_COLUMNS) + " FROM survey", _fences_cte()),
)
def winsorize(spark, sf_dir):
    # clipped values equal interpolated fences: 6 places keep the engines' last-bit differences out
    w = prof.winsorize(survey(spark, sf_dir), OUT)
    return w.select(*[F.round(c, 6).alias(c) if c in OUT else F.col(c) for c in w.columns])


def _box_sql() -> str:
    parts = []
    for c in OUT:
        for stage, e in (("before", f"CAST({c} AS DOUBLE)"), ("after", _clip_sql(c))):
            parts.append(
                f"SELECT '{c}' AS feature, '{stage}' AS stage, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
                f"round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, "
                f"CAST(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS fliers "
                f"FROM (SELECT v, quantile_cont(v, 0.25) OVER () AS q1, quantile_cont(v, 0.5) OVER () AS median, quantile_cont(v, 0.75) OVER () AS q3 "
                f"FROM (SELECT {e} AS v FROM survey) WHERE v IS NOT NULL) GROUP BY q1, median, q3"
            )
    return " UNION ALL ".join(parts)


@register("box_stats", with_survey(_box_sql(), _fences_cte()))
def box_stats(spark, sf_dir):
    b = prof.box_stats(survey(spark, sf_dir), OUT)
    return b.select("feature", "stage", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "fliers")


# ----------------------------------------------------------------------------- repairs
_NUM = [c for c in SURVEY_COLUMNS if c in INT_COLS or c in FLOAT_COLS]


_FILL = [c for c in SURVEY_COLUMNS if c not in ("respondent_id", "will_subscribe", "estimated_mrr_usd")]


def _impute_sql() -> str:
    cols = []
    for c in SURVEY_COLUMNS:
        if c not in _FILL:
            cols.append(c)
        elif c in _NUM:
            # only a column with holes is filled; the survey has them in one numeric column
            cols.append(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM survey)), 6) AS {c}" if c == "wtp_monthly_usd" else c)
        else:
            mode = f"(SELECT {c} FROM survey WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)"
            cols.append(f"coalesce({c}, {mode}) AS {c}")
    return "SELECT " + ", ".join(cols) + " FROM survey"


@register("impute_median_mode", with_survey(_impute_sql()))
def impute_median_mode(spark, sf_dir):
    i = prof.impute_median_mode(survey(spark, sf_dir))
    return i.withColumn("wtp_monthly_usd", F.round("wtp_monthly_usd", 6))


@register(
    "dedup_ids",
    with_survey(
        "SELECT DISTINCT * FROM survey_dirty",  # planted copies of an id are whole-row copies, so both agree there
        dirty=True,
    ),
)
def dedup_ids(spark, sf_dir):
    return prof.drop_duplicate_ids(dirty(spark, sf_dir), C.id)


_null_sum = " + ".join(f"CAST({c} IS NULL AS INT)" for c in SURVEY_COLUMNS)


@register("drop_sparse_rows", with_survey(f"SELECT * FROM survey_dirty WHERE ({_null_sum}) / 25 <= 0.3", dirty=True))
def drop_sparse_rows(spark, sf_dir):
    return prof.drop_sparse_rows(dirty(spark, sf_dir))


_REPAIRED = {
    "wtp_monthly_usd": "CASE WHEN preferred_subscription_tier = 'Free' AND wtp_monthly_usd > 50 THEN 5.0 ELSE wtp_monthly_usd END",
    "estimated_mrr_usd": "CASE WHEN will_subscribe = 0 AND estimated_mrr_usd > 0 THEN 0.0 ELSE estimated_mrr_usd END",
    "churn_risk_score": "CASE WHEN churn_risk_score < 0 THEN 0.0 WHEN churn_risk_score > 1 THEN 1.0 ELSE churn_risk_score END",
    "monthly_spend_on_ai_usd": "CASE WHEN monthly_spend_on_ai_usd < 0 THEN 0.0 ELSE monthly_spend_on_ai_usd END",
} | {f: f"CASE WHEN {f} IS NOT NULL THEN CAST(least(greatest(round({f}), 0), 1) AS INTEGER) END" for f in C.tools}


def _repair_sql() -> str:
    return "SELECT " + ", ".join(f"{_REPAIRED[c]} AS {c}" if c in _REPAIRED else c for c in SURVEY_COLUMNS) + " FROM survey_dirty"


@register("repair_rules", with_survey(_repair_sql(), dirty=True))
def repair_rules(spark, sf_dir):
    return prof.repair_rules(dirty(spark, sf_dir))


def _audit_sql() -> str:
    n = "(SELECT count(*) FROM survey_dirty)"
    d = "(SELECT count(*) FROM dd)"
    m = "(SELECT count(*) FROM mp WHERE missing_count > 0)"

    def changed(c: str) -> str:
        """Whether a step changes a value of the column."""
        parts = []
        if c in OUT:
            parts.append(f"(SELECT count(*) FROM dd WHERE {c} < {_fence(c, 'lower_fence')} OR {c} > {_fence(c, 'upper_fence')}) > 0")
        if c in _REPAIRED:
            parts.append(f"(SELECT count(*) FROM dd WHERE ({_REPAIRED[c]}) IS DISTINCT FROM {c}) > 0")
        return "CAST((" + " OR ".join(parts) + ") AS INTEGER)"

    o = " + ".join(f"CAST((SELECT count(*) FROM dd WHERE {c} < {_fence(c, 'lower_fence')} OR {c} > {_fence(c, 'upper_fence')}) > 0 AS INTEGER)" for c in OUT)
    r = " + ".join(f"CAST((SELECT count(*) FROM dd WHERE ({e}) IS DISTINCT FROM {c}) > 0 AS INTEGER)" for c, e in _REPAIRED.items())
    both = " + ".join(changed(c) for c in {**dict.fromkeys(OUT), **_REPAIRED})
    rows = [
        ("1", "Raw Data Ingestion", n, n, "25"),
        ("2", "Missing Value Check", n, n, m),
        ("3", "Duplicate Removal", n, d, "25"),
        ("4", "Data Type Validation", d, d, "25"),
        ("5", "Outlier Winsorization", d, d, o),
        ("6", "Consistency Checks", d, d, r),
        ("7a", "Ordinal Encoding", d, d, "6"),
        ("7b", "Label Encoding (Nominal)", d, d, "5"),
        ("7c", "StandardScaler", d, d, "4"),
        ("7d", "Target Variable Derivation", d, d, "3"),
        ("total", "All steps", n, d, f"{both} + 11"),
    ]
    body = " UNION ALL ".join(
        f"SELECT '{i}' AS step, '{p}' AS process, CAST({a} AS BIGINT) AS rows_in, CAST({b} AS BIGINT) AS rows_out, CAST({k} AS BIGINT) AS cols_affected"
        for i, p, a, b, k in rows
    )
    return with_survey(
        body,
        "mp AS (" + _missing_sql("survey_dirty") + ")",
        "dd AS (SELECT DISTINCT * FROM survey_dirty)",
        _fences_cte("dd"),
        dirty=True,
    )


@register("pipeline_audit", _audit_sql())
def pipeline_audit(spark, sf_dir):
    return prof.pipeline_audit(dirty(spark, sf_dir))


def _zq_sql() -> str:
    parts = []
    for c in C.scale_cols:
        z = (f"CASE WHEN {c} IS NULL THEN NULL WHEN (SELECT stddev_pop({c}) FROM survey) = 0 THEN 0.0 "
             f"ELSE ({c} - (SELECT avg({c}) FROM survey)) / (SELECT stddev_pop({c}) FROM survey) END")
        parts.append(
            f"SELECT '{c}' AS feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
            f"round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, "
            f"CAST(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS fliers "
            f"FROM (SELECT v, quantile_cont(v, 0.25) OVER () AS q1, quantile_cont(v, 0.5) OVER () AS median, quantile_cont(v, 0.75) OVER () AS q3 "
            f"FROM (SELECT {z} AS v FROM survey) WHERE v IS NOT NULL) GROUP BY q1, median, q3"
        )
    return with_survey(" UNION ALL ".join(parts))


@register("box_stats_scaled", _zq_sql())
def box_stats_scaled(spark, sf_dir):
    """Box statistics of the z-scored columns (the after-scaling box plot)."""
    from cohortlab.operators.encode import standardize

    cols = list(C.scale_cols)
    b = prof.box_stats_plain(standardize(survey(spark, sf_dir), cols), cols)
    return b.select("feature", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "fliers")

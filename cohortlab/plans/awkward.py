"""Operators on awkward tables: the survey with planted NaN (missing, as NULL is) and the survey without rows; and profiles merged from sketches.

The oracles read the same answers off a survey with NULL in those places, so NaN may not leave a trace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.config import ACTION_NONE, OUTLIER_RETAIN, SURVEY
from cohortlab.operators import aggregate as agg
from cohortlab.operators import encode as enc
from cohortlab.operators import profile as prof
from cohortlab.operators import sketches as sk
from cohortlab.plans import cleaning, encoding, overview  # noqa: F401  (their oracles are read below)
from cohortlab.plans.registry import ORACLES, register, survey, table_name
from cohortlab.plans.survey_sql import SURVEY_CTES, with_survey
from cohortlab.session import materialize
from cohortlab.sources.survey import SURVEY_COLUMNS

C = SURVEY
#: Column and the divisor of the ids whose value is missing.
PLANTED = {C.wtp: 29, C.spend: 31, C.churn: 43, C.mrr: 47}


def survey_nan(spark, sf_dir: str) -> DataFrame:
    s = survey(spark, sf_dir)
    return s.withColumns({c: F.when(F.col(C.id) % d == 0, F.lit(float("nan"))).otherwise(F.col(c)) for c, d in PLANTED.items()})


def survey_empty(spark, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).where(F.col(C.id) < 0)


def _over(base: str, select: str) -> str:
    """The oracle of a query with another survey: ``select`` derives it from ``survey_base``."""
    ctes = SURVEY_CTES.strip()
    changed = ctes.replace("survey AS (", "survey_base AS (") + f",\nsurvey AS ({select})"
    sql = ORACLES[base]
    if ctes not in sql:
        raise ValueError(f"{base} does not read the survey")
    return sql.replace(ctes, changed)


_NAN = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN respondent_id % {d} <> 0 THEN {c} END AS {c}" for c, d in PLANTED.items()) + ") FROM survey_base"
_EMPTY = "SELECT * FROM survey_base WHERE respondent_id < 0"


def _round(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


ON_NAN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "missing_profile": prof.missing_profile,
    "missing_total": prof.missing_total,
    "column_profile": lambda s: prof.column_profile(s, C.id),
    "consistency_checks": lambda s: prof.run_checks(s, prof.survey_rules()),
    "outlier_summary": lambda s: prof.outlier_summary(s, cleaning.OUT),
    "winsorize": lambda s: _round(prof.winsorize(s, cleaning.OUT), cleaning.OUT),
    "describe_numeric": lambda s: agg.describe(s, list(C.scale_cols)),
    "kpi_overview": lambda s: _round(agg.kpis(s), ["subscribe_rate", "avg_wtp", "avg_tools_used", "avg_mrr"]),
    "segment_profile": lambda s: agg.segment_profile(s, C.user_type),
    "standardize": lambda s: _round(enc.standardize(s, encoding.SCALE, keep=[C.id]), encoding.SCALE),
    "scale_check": lambda s: enc.scale_check(s, encoding.SCALE),
    "feature_matrix": lambda s: enc.feature_matrix(s, keep=[C.id]),
}
ON_EMPTY = {k: ON_NAN[k] for k in ("missing_total", "column_profile", "consistency_checks", "winsorize", "describe_numeric", "segment_profile", "standardize", "feature_matrix")}


def _register(prefix: str, base: str, op: Callable[[DataFrame], DataFrame], source: Callable, select: str) -> None:
    def query(spark, sf_dir):
        return op(source(spark, sf_dir))

    query.__doc__ = f"``{base}`` over a survey {prefix}."
    register(f"{base}_{prefix}", _over(base, select))(query)


for _name, _op in ON_NAN.items():
    _register("nan", _name, _op, survey_nan, _NAN)
for _name, _op in ON_EMPTY.items():
    _register("empty", _name, _op, survey_empty, _EMPTY)


@register(
    "missing_profile_empty",
    " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS feature, CAST(0 AS BIGINT) AS missing_count, CAST(NULL AS DOUBLE) AS missing_pct, '{ACTION_NONE}' AS action" for i, c in enumerate(SURVEY_COLUMNS)
    ),
)
def missing_profile_empty(spark, sf_dir):
    return prof.missing_profile(survey_empty(spark, sf_dir))


@register(
    "outlier_summary_empty",
    " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS feature, "
        + ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("q1", "q3", "lower_fence", "upper_fence"))
        + f", CAST(0 AS BIGINT) AS outliers, CAST(NULL AS VARCHAR) AS outlier_pct, '{OUTLIER_RETAIN}' AS action"
        for i, c in enumerate(cleaning.OUT)
    ),
)
def outlier_summary_empty(spark, sf_dir):
    return prof.outlier_summary(survey_empty(spark, sf_dir), cleaning.OUT)


_FILLED = {c: d for c, d in PLANTED.items() if c != C.mrr}


def _impute_nan_sql() -> str:
    cols = []
    for c in SURVEY_COLUMNS:
        if c in _FILLED:
            cols.append(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM survey)), 6) AS {c}")
        elif c in cleaning._FILL and c not in cleaning._NUM:
            cols.append(f"coalesce({c}, (SELECT {c} FROM survey WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)) AS {c}")
        else:
            cols.append(c)
    return "SELECT " + ", ".join(cols) + " FROM survey"


ORACLES["_impute_nan"] = with_survey(_impute_nan_sql())


@register("impute_median_mode_nan", _over("_impute_nan", _NAN.replace(f", CASE WHEN respondent_id % {PLANTED[C.mrr]} <> 0 THEN {C.mrr} END AS {C.mrr}", "")))
def impute_median_mode_nan(spark, sf_dir):
    s = survey(spark, sf_dir)
    s = s.withColumns({c: F.when(F.col(C.id) % d == 0, F.lit(float("nan"))).otherwise(F.col(c)) for c, d in _FILLED.items()})
    return _round(prof.impute_median_mode(s), list(_FILLED))


del ORACLES["_impute_nan"]
_sum = " + ".join(f"CAST({c} IS NULL AS INT)" for c in SURVEY_COLUMNS)
ORACLES["_sparse_nan"] = with_survey(f"SELECT respondent_id FROM survey WHERE ({_sum}) / 25 <= 0.06")


@register("drop_sparse_rows_nan", _over("_sparse_nan", _NAN))
def drop_sparse_rows_nan(spark, sf_dir):
    """Rows with at most one missing answer, NaN counted."""
    return prof.drop_sparse_rows(survey_nan(spark, sf_dir), 0.06).select(C.id)


del ORACLES["_sparse_nan"]


# ----------------------------------------------------------------------------- sketches
SKETCHED = [C.spend, C.wtp, C.churn, C.mrr, C.tools_count]


def daily_sketches(spark, sf_dir: str) -> DataFrame:
    """Sketches of every region's answers (as of every day's uploads), written once and read from then on."""
    return materialize(sk.sketch_columns(survey(spark, sf_dir), [*SKETCHED, C.user_type, C.id], by=["region"]), table_name(sf_dir, "sketches"))


_MOMENTS = ", ".join(
    f"({i + 1}, '{c}', (SELECT count({c}) FROM survey), (SELECT count(*) - count({c}) FROM survey), "
    + (f"(SELECT avg({c}) FROM survey), (SELECT stddev_samp({c}) FROM survey), (SELECT min({c}) FROM survey), (SELECT max({c}) FROM survey))" if c != C.user_type else "NULL, NULL, NULL, NULL)")
    for i, c in enumerate([*SKETCHED, C.user_type, C.id])
)


@register(
    "sketch_union_profile",
    with_survey(
        "SELECT position, feature, CAST(cnt AS BIGINT) AS count, CAST(missing AS BIGINT) AS missing, round(CAST(mean AS DOUBLE), 6) AS mean, round(CAST(std AS DOUBLE), 6) AS std, "
        "round(CAST(lo AS DOUBLE), 6) AS min, round(CAST(hi AS DOUBLE), 6) AS max FROM t",
        f"t(position, feature, cnt, missing, mean, std, lo, hi) AS (VALUES {_MOMENTS})",
    ),
)
def sketch_union_profile(spark, sf_dir):
    """The whole survey's profile from its regions' sketches alone: the parts that are exact."""
    p = sk.sketch_profile(sk.merge_sketches(daily_sketches(spark, sf_dir)))
    return p.select("position", "feature", "count", "missing", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@register(
    "sketch_within_bounds",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS probability, true AS within_bound" for c in SKETCHED for p in (0.25, 0.5, 0.75)),
)
def sketch_within_bounds(spark, sf_dir):
    """Whether the merged sketches' quantiles keep their rank error bound, by exact ranks (95 in 100 at half the bound; 2 x here)."""
    s = survey(spark, sf_dir)
    p = sk.sketch_profile(sk.merge_sketches(daily_sketches(spark, sf_dir)))
    e = sk.rank_errors(s, p, SKETCHED)
    return e.select("feature", "probability", (F.col("rank_error") <= 2 * sk.RANK_ERROR).alias("within_bound"))


@register(
    "sketch_distinct_within_bounds",
    with_survey(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, true AS within_bound FROM survey" for c in (C.user_type, C.id, C.wtp))),
)
def sketch_distinct_within_bounds(spark, sf_dir):
    """Whether the merged sketches' distinct counts are within five standard errors of the exact ones."""
    s = survey(spark, sf_dir)
    exact = s.agg(*[F.count_distinct(c).alias(c) for c in (C.user_type, C.id, C.wtp)]).unpivot([], [C.user_type, C.id, C.wtp], "feature", "distinct_values")
    p = sk.sketch_profile(sk.merge_sketches(daily_sketches(spark, sf_dir))).select("feature", "distinct")
    off = F.abs(F.col("distinct") - F.col("distinct_values")) / F.col("distinct_values")
    return exact.join(p, "feature").select("feature", "distinct_values", (off <= 5 * 1.04 / 2 ** (sk.LG_K / 2)).alias("within_bound"))

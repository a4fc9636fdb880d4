"""Overview and explorer queries (A1-A5, A8, A11, F1, F2, S3, S4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.config import SURVEY, TIER_ORDER, TOOL_LABELS, TRUST_ORDER
from cohortlab.operators import aggregate as agg
from cohortlab.plans.registry import register, survey
from cohortlab.plans.survey_sql import with_survey

C = SURVEY
EXPLORER_FACETS = {"user_type": ["Enterprise", "SME"], "industry": [], "preferred_subscription_tier": ["Gold", "Platinum"]}


@register(
    "kpi_overview",
    with_survey("""
SELECT CAST(count(*) AS BIGINT) AS n_respondents,
       round(avg(will_subscribe), 6) AS subscribe_rate,
       round(avg(wtp_monthly_usd), 6) AS avg_wtp,
       round(avg(num_ai_tools_currently_used), 6) AS avg_tools_used,
       round(avg(estimated_mrr_usd), 6) AS avg_mrr
FROM survey"""),
)
def kpi_overview(spark, sf_dir):
    k = agg.kpis(survey(spark, sf_dir))
    return k.select("n_respondents", *[F.round(x, 6).alias(x) for x in k.columns[1:]])


@register(
    "subscribe_rate_by_user_type",
    with_survey("""
SELECT user_type, round(avg(will_subscribe) * 100, 6) AS rate_pct, CAST(count(*) AS BIGINT) AS n
FROM survey WHERE user_type IS NOT NULL GROUP BY user_type"""),
)
def subscribe_rate_by_user_type(spark, sf_dir):
    r = agg.rate_by(survey(spark, sf_dir), C.user_type, C.subscribe)
    return r.select(C.user_type, F.round("rate_pct", 6).alias("rate_pct"), "n")


def _ordered_sql(column, order):
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS position, '{v}' AS category" for i, v in enumerate(order))
    return with_survey(f"""
SELECT o.position, o.category, CAST(c.n AS BIGINT) AS n
FROM ({rows}) o LEFT JOIN (SELECT {column} AS category, count(*) AS n FROM survey GROUP BY {column}) c
  ON o.category = c.category""")


@register("tier_distribution", _ordered_sql(C.tier, TIER_ORDER))
def tier_distribution(spark, sf_dir):
    return agg.ordered_counts(survey(spark, sf_dir), C.tier, TIER_ORDER)


@register("trust_distribution", _ordered_sql(C.trust, TRUST_ORDER))
def trust_distribution(spark, sf_dir):
    return agg.ordered_counts(survey(spark, sf_dir), C.trust, TRUST_ORDER)


_tool_union = " UNION ALL ".join(
    f"SELECT '{f}' AS flag, '{lab}' AS label, round(avg({f}) * 100, 6) AS rate_pct FROM survey" for f, lab in TOOL_LABELS.items()
)


@register("tool_adoption", with_survey(_tool_union))
def tool_adoption(spark, sf_dir):
    r = agg.flag_rates(survey(spark, sf_dir), TOOL_LABELS)
    return r.select("flag", "label", F.round("rate_pct", 6).alias("rate_pct"))


def _describe_sql(where: str) -> str:
    parts = []
    for c in C.scale_cols:
        parts.append(f"""
SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS count, round_even(avg({c}), 2) AS mean,
       round_even(stddev_samp({c}), 2) AS std, round_even(min({c}), 2) AS min,
       round_even(quantile_cont({c}, 0.25), 2) AS p25, round_even(quantile_cont({c}, 0.5), 2) AS p50,
       round_even(quantile_cont({c}, 0.75), 2) AS p75, round_even(max({c}), 2) AS max
FROM survey {where}""")
    return with_survey(" UNION ALL ".join(parts))


_facet_where = "WHERE user_type IN ('Enterprise', 'SME') AND preferred_subscription_tier IN ('Gold', 'Platinum')"


@register("describe_numeric", _describe_sql(""))
def describe_numeric(spark, sf_dir):
    return agg.describe(survey(spark, sf_dir), list(C.scale_cols))


@register("describe_filtered", _describe_sql(_facet_where))
def describe_filtered(spark, sf_dir):
    return agg.describe(agg.facet_filter(survey(spark, sf_dir), EXPLORER_FACETS), list(C.scale_cols))


@register("facet_filter", with_survey(f"SELECT * FROM survey {_facet_where}"))
def facet_filter(spark, sf_dir):
    return agg.facet_filter(survey(spark, sf_dir), EXPLORER_FACETS)


@register("facet_count", with_survey(f"SELECT CAST(count(*) AS BIGINT) AS n_rows FROM survey {_facet_where}"))
def facet_count(spark, sf_dir):
    return agg.facet_filter(survey(spark, sf_dir), EXPLORER_FACETS).agg(F.count(F.lit(1)).alias("n_rows"))


_facets = ["user_type", "industry", "preferred_subscription_tier"]


@register(
    "facet_values",
    with_survey(" UNION ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value FROM survey" for c in _facets)),
)
def facet_values(spark, sf_dir):
    return agg.facet_values(survey(spark, sf_dir), _facets)


@register(
    "dataset_shape",
    with_survey("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(25 AS BIGINT) AS n_columns FROM survey"),
)
def dataset_shape(spark, sf_dir):
    return agg.shape(survey(spark, sf_dir))


@register("preview_head", with_survey("SELECT * FROM survey ORDER BY respondent_id LIMIT 5"))
def preview_head(spark, sf_dir):
    # first rows by key (a stored frame has no positional order); TakeOrderedAndProject
    return survey(spark, sf_dir).orderBy(C.id).limit(5)


@register("scan_survey", with_survey("SELECT * FROM survey"))
def scan_survey(spark, sf_dir):
    return survey(spark, sf_dir)


@register(
    "segment_profile",
    with_survey("""
SELECT user_type, CAST(count(respondent_id) AS BIGINT) AS size,
       round_even(avg(monthly_spend_on_ai_usd), 2) AS avg_monthly_spend,
       round_even(avg(wtp_monthly_usd), 2) AS avg_wtp,
       round_even(avg(num_ai_tools_currently_used), 2) AS avg_tools_used,
       round_even(avg(will_subscribe), 2) AS subscribe_rate,
       round_even(avg(will_subscribe) * 100, 1) AS subscribe_rate_pct,
       CAST(round_even(round_even(avg(will_subscribe), 2) * 100, 1) AS VARCHAR) || '%' AS subscribe_rate_label,
       round_even(avg(estimated_mrr_usd), 2) AS avg_mrr
FROM survey WHERE user_type IS NOT NULL GROUP BY user_type"""),
)
def segment_profile(spark, sf_dir):
    return agg.segment_profile(survey(spark, sf_dir), C.user_type)


@register(
    "crosstab_segment_industry",
    with_survey("""
SELECT u.user_type, i.industry, CAST(count(s.respondent_id) AS BIGINT) AS n
FROM (SELECT DISTINCT user_type FROM survey WHERE user_type IS NOT NULL) u
CROSS JOIN (SELECT DISTINCT industry FROM survey WHERE industry IS NOT NULL) i
LEFT JOIN survey s ON s.user_type = u.user_type AND s.industry = i.industry
GROUP BY u.user_type, i.industry"""),
)
def crosstab_segment_industry(spark, sf_dir):
    return agg.crosstab_long(survey(spark, sf_dir), C.user_type, C.industry)

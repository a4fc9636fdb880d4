"""Source and sink queries (S1, S2): CSV out and back in with the explicit survey schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.config import NA_TOKENS
from cohortlab.plans.registry import register, survey, table_name
from cohortlab.plans.survey_sql import with_survey
from cohortlab.session import run_path
from cohortlab.sources.csv_io import cast_failures, malformed_rows, read_survey, write_csv
from cohortlab.sources.survey import SURVEY_COLUMNS
from cohortlab.sources.tables import table


def _roundtrip_path(spark, sf_dir: str) -> str:
    path = run_path(spark, "csv", table_name(sf_dir, "survey"))
    write_csv(survey(spark, sf_dir), path)
    return path


@register("csv_roundtrip", with_survey("SELECT * FROM survey"))
def csv_roundtrip(spark, sf_dir):
    """Survey written as CSV (header, NULL as empty) and read back through the typed reader."""
    return read_survey(spark, _roundtrip_path(spark, sf_dir))


_TYPES = {"respondent_id": "BIGINT", "num_ai_tools_currently_used": "INTEGER", "will_subscribe": "INTEGER",
          "monthly_spend_on_ai_usd": "DOUBLE", "wtp_monthly_usd": "DOUBLE", "churn_risk_score": "DOUBLE", "estimated_mrr_usd": "DOUBLE"}


def _fail_sql(c: str) -> str:
    t = _TYPES.get(c, "INTEGER" if c.startswith("uses_") else "VARCHAR")
    return (f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS {t}) IS NULL) AS BIGINT) "
            f"AS failures FROM survey")


@register("csv_cast_failures", with_survey(" UNION ALL ".join(_fail_sql(c) for c in SURVEY_COLUMNS)))
def csv_cast_failures(spark, sf_dir):
    """Values in the written CSV that fail their schema cast (0 for a clean export)."""
    return cast_failures(spark, _roundtrip_path(spark, sf_dir))


@register(
    "stream_kpis_by_user_type",
    with_survey(
        "SELECT user_type, CAST(count(*) AS BIGINT) AS n, round(avg(will_subscribe) * 100, 6) AS rate_pct, round(avg(wtp_monthly_usd), 6) AS avg_wtp, "
        "round(avg(num_ai_tools_currently_used), 6) AS avg_tools_used, round(avg(estimated_mrr_usd), 6) AS avg_mrr FROM survey "
        "WHERE user_type IS NOT NULL GROUP BY user_type"
    ),
)
def stream_kpis_by_user_type(spark, sf_dir):
    """The survey exported as several CSV uploads, aggregated by the streaming KPI query (one availableNow run)."""
    from pyspark.sql import functions as F

    from cohortlab.streaming.uploads import run_once

    folder = run_path(spark, "uploads", table_name(sf_dir, "survey"))
    write_csv(survey(spark, sf_dir), folder)
    out = run_once(spark, folder, folder.rsplit("/", 1)[-1])
    return out.select(
        "user_type", "n", *[F.round(c, 6).alias(c) for c in ("rate_pct", "avg_wtp", "avg_tools_used", "avg_mrr")]
    )


@register(
    "filtered_csv",
    with_survey(
        "SELECT * FROM survey WHERE user_type IN ('Enterprise', 'SME') AND preferred_subscription_tier IN ('Gold', 'Platinum')"
    ),
)
def filtered_csv(spark, sf_dir):
    """The explorer's download: rows after the facet filters, written as CSV and read back typed."""
    from cohortlab.operators.aggregate import facet_filter
    from cohortlab.plans.overview import EXPLORER_FACETS

    path = run_path(spark, "csv", table_name(sf_dir, "filtered"))
    write_csv(facet_filter(survey(spark, sf_dir), EXPLORER_FACETS), path)
    return read_survey(spark, path)


PAGE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def _text_sql(c: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return f"CASE WHEN {c} NOT IN ({tokens}) THEN {c} END AS {c}"


@register("csv_text_roundtrip", f"SELECT page_id, {_text_sql('url')}, {_text_sql('html')} FROM pages")
def csv_text_roundtrip(spark, sf_dir):
    """Raw HTML - quotes, commas, line breaks inside fields - written as CSV and read back."""
    path = run_path(spark, "csv", table_name(sf_dir, "pages"))
    write_csv(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_survey(spark, path, PAGE_SCHEMA)


def _damaged_path(spark, sf_dir: str) -> str:
    """The orders as CSV lines: every 50th lacks its last two fields, every 70th has one too many."""
    o = table(spark, sf_dir, "orders")
    k, quoted = F.col("o_orderkey"), F.concat(F.lit('"'), F.replace("o_orderpriority", F.lit('"'), F.lit('""')), F.lit('"'))
    head = F.concat_ws(",", k.cast("string"), quoted)
    tail = F.concat_ws(",", F.lit(""), F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string"))
    line = F.concat(head, F.when(k % 50 == 0, F.lit("")).otherwise(tail), F.when((k % 70 == 0) & (k % 50 != 0), F.lit(",extra")).otherwise(F.lit("")))
    path = run_path(spark, "csv", table_name(sf_dir, "damaged"))
    o.select(line.alias("o_orderkey,o_orderpriority,o_custkey,o_totalprice")).write.option("header", True).option("quote", "\u0000").option("sep", "\t").csv(path)
    return path


DAMAGED_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


@register(
    "csv_damaged_rows",
    "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS o_custkey, "
    "CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS o_totalprice FROM orders",
)
def csv_damaged_rows(spark, sf_dir):
    """A file with short and long rows: each keeps the fields that it has."""
    return read_survey(spark, _damaged_path(spark, sf_dir), DAMAGED_SCHEMA)


@register(
    "csv_malformed_rows",
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE o_orderkey % 50 = 0 OR o_orderkey % 70 = 0) AS BIGINT) AS malformed, "
    "CAST(count(*) FILTER (WHERE o_orderkey % 50 = 0) AS BIGINT) AS cut_short FROM orders",
)
def csv_malformed_rows(spark, sf_dir):
    """How many rows of that file are malformed, over all its parts."""
    found = malformed_rows(spark, _damaged_path(spark, sf_dir))
    return found.agg(*[F.sum(c).alias(a) for c, a in (("rows", "n_rows"), ("malformed", "malformed"), ("cut_short", "cut_short"))])


@register("csv_single_file", with_survey("SELECT * FROM survey"))
def csv_single_file(spark, sf_dir):
    """The survey as one CSV file in the order of its ids, read back."""
    path = run_path(spark, "csv", table_name(sf_dir, "single")) + ".csv"
    write_csv(survey(spark, sf_dir), path, single_file=True, order_by=["respondent_id"])
    return read_survey(spark, path)

"""The 25-column survey table derived from the order tables (one respondent per order).

Plan at scale: ``lineitem`` is reduced to one basket row per order by a hash
aggregate with map-side combine (so a hot order key is collapsed before the
shuffle).  ``orders`` is joined to ``customer`` on the customer key (sort-merge;
AQE splits a skewed customer), to the fixed 25-row nation x region dimension, which is
broadcast after a row-count check, and last to the baskets on the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.config import ORDINAL_SCALES
from cohortlab.functions.broadcast import broadcast_if_small
from cohortlab.sources.tables import table

# Fixed values of the derivation: which part-key residues (mod 7) mark each tool,
# and the category names given to the customer attributes.
TOOL_RESIDUES: list[tuple[str, tuple[int, ...]]] = [
    ("uses_llm_writing_tools", (0, 1)),
    ("uses_image_gen_tools", (1,)),
    ("uses_video_gen_tools", (2,)),
    ("uses_code_assistant_tools", (0, 3)),
    ("uses_data_analytics_tools", (3, 4)),
    ("uses_voice_audio_tools", (5,)),
    ("uses_productivity_tools", (0, 4, 6)),
]
SEGMENT_USER_TYPE = {"AUTOMOBILE": "Enterprise", "BUILDING": "SME", "FURNITURE": "Freelancer", "HOUSEHOLD": "Individual"}
INDUSTRIES = ["Design & Creative", "Software Development", "Marketing", "Data", "Finance", "Other"]
AGE_GROUPS = ["18-24", "25-34", "35-44", "45-54", "55+"]
DISCOVERY = ["Search", "Referral", "Social"]
# answers of the ordinal columns, in the order of their codes
DIFFICULTY, TRUST, FATIGUE, TIERS, CADENCE, BUNDLE = (
    sorted(ORDINAL_SCALES[c], key=ORDINAL_SCALES[c].get)
    for c in (
        "difficulty_finding_tools", "trust_concern_frequency", "subscription_fatigue", "preferred_subscription_tier", "preferred_billing_cadence", "bundle_interest",
    )
)

SURVEY_COLUMNS = [
    "respondent_id", "user_type", "industry", "region", "age_group", "num_ai_tools_currently_used",
    "monthly_spend_on_ai_usd", "primary_discovery_method", "difficulty_finding_tools", "trust_concern_frequency",
    "subscription_fatigue", "uses_llm_writing_tools", "uses_image_gen_tools", "uses_video_gen_tools",
    "uses_code_assistant_tools", "uses_data_analytics_tools", "uses_voice_audio_tools", "uses_productivity_tools",
    "preferred_subscription_tier", "preferred_billing_cadence", "bundle_interest", "wtp_monthly_usd",
    "will_subscribe", "churn_risk_score", "estimated_mrr_usd",
]


def _pick(code: Column, names: list[str], base: int = 0) -> Column:
    """names[code - base] as a CASE chain; the last name takes every other code."""
    out = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        out = F.when(code == F.lit(i + base), F.lit(names[i])).otherwise(out)
    return out


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    r = F.col("l_partkey") % 7
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("long").alias("n_lines"),
        *[F.max(F.when(r.isin(*res), 1).otherwise(0)).alias(name) for name, res in TOOL_RESIDUES],
    )


def survey_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey table: 25 columns, one row per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    geo = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")
    geo = broadcast_if_small(geo, 10_000)

    ok, ck = F.col("o_orderkey"), F.col("c_custkey")
    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(baskets(spark, sf_dir), F.col("l_orderkey") == ok, "left")
        .select(
            ok,
            ck,
            "c_mktsegment",
            "r_name",
            (F.col("o_totalprice") / F.lit(500000.0)).alias("x"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / F.lit(50.0)).otherwise(F.lit(0.0)).alias("wtp"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("d"),
            ((ok * 7 + ck) % 5 + 1).cast("int").alias("t"),
            ((ok * 3 + ck) % 5 + 1).cast("int").alias("f"),
            ((ok + ck * 5) % 4).cast("int").alias("tier"),
            (ok % 3 + 1).cast("int").alias("bill"),
            ((ok * 11 + ck) % 4 + 1).cast("int").alias("bi"),
            F.coalesce(F.col("n_lines"), F.lit(0)).cast("int").alias("n_lines"),
            *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name, _ in TOOL_RESIDUES],
        )
    )
    x, wtp, t, d, f = F.col("x"), F.col("wtp"), F.col("t"), F.col("d"), F.col("f")
    sub = F.when(t * 2 + d * 2 + f + wtp / F.lit(20.0) > F.lit(18.0), 1).otherwise(0)
    scored = base.withColumn("sub", sub)
    bill = F.col("bill")
    bill_factor = F.when(bill == 1, F.lit(100.0)).when(bill == 2, F.lit(90.0)).otherwise(F.lit(80.0))
    seg = F.col("c_mktsegment")
    user_type = F.lit("Student")
    for k in reversed(list(SEGMENT_USER_TYPE)):
        user_type = F.when(seg == F.lit(k), F.lit(SEGMENT_USER_TYPE[k])).otherwise(user_type)
    ck = F.col("c_custkey")
    ok = F.col("o_orderkey")
    return scored.select(
        ok.alias("respondent_id"),
        user_type.alias("user_type"),
        _pick(ck % 6, INDUSTRIES).alias("industry"),
        F.col("r_name").alias("region"),
        _pick(ck % 5, AGE_GROUPS).alias("age_group"),
        F.col("n_lines").alias("num_ai_tools_currently_used"),
        F.when(ok % 97 == 0, -x).otherwise(x * x * x * x * F.lit(750.0)).alias("monthly_spend_on_ai_usd"),
        F.when(ok % 41 == 0, F.lit(None).cast("string")).otherwise(_pick(ck % 3, DISCOVERY)).alias(
            "primary_discovery_method"
        ),
        _pick(d, DIFFICULTY, 1).alias("difficulty_finding_tools"),
        F.when(ok % 37 == 0, F.lit(None).cast("string")).otherwise(_pick(t, TRUST, 1)).alias("trust_concern_frequency"),
        _pick(f, FATIGUE, 1).alias("subscription_fatigue"),
        *[F.col(name) for name, _ in TOOL_RESIDUES],
        _pick(F.col("tier"), TIERS).alias("preferred_subscription_tier"),
        _pick(bill, CADENCE, 1).alias("preferred_billing_cadence"),
        _pick(F.col("bi"), BUNDLE, 1).alias("bundle_interest"),
        F.when(ok % 53 == 0, F.lit(None).cast("double")).otherwise(wtp).alias("wtp_monthly_usd"),
        F.col("sub").alias("will_subscribe"),
        F.when(ok % 89 == 0, F.lit(2.0))
        .otherwise((F.col("tier") * 10 + f * 6 + bill * 4).cast("double") / F.lit(100.0))
        .alias("churn_risk_score"),
        F.when((ok % 83 == 0) & (F.col("sub") == 0), F.lit(5.0))
        .otherwise(wtp * F.col("sub") * bill_factor / F.lit(100.0))
        .alias("estimated_mrr_usd"),
    )


def survey_dirty(spark: SparkSession, sf_dir: str, survey: DataFrame | None = None) -> DataFrame:
    """Survey with planted duplicates and bad flags (for the duplicate and flag checks).

    Exact copies of ids divisible by 101, re-keyed copies (id + 100000000) of ids
    divisible by 103, and the voice flag set to 2 for ids divisible by 79 and to
    NULL for ids divisible by 113 (NULL wins), applied after the unions.
    """
    s = survey if survey is not None else survey_view(spark, sf_dir)
    rid = F.col("respondent_id")
    # one pass: every row once, again if it has an exact copy, again if it has a re-keyed one
    shifts = F.array(F.lit(0), F.when(rid % 101 == 0, F.lit(0)), F.when(rid % 103 == 0, F.lit(100000000)))
    u = s.withColumn("__shift", F.explode(F.array_compact(shifts)))
    u = u.withColumn("respondent_id", rid + F.col("__shift")).drop("__shift")
    voice = (
        F.when(rid % 113 == 0, F.lit(None).cast("int"))
        .when(rid % 79 == 0, F.lit(2))
        .otherwise(F.col("uses_voice_audio_tools"))
    )
    return u.withColumn("uses_voice_audio_tools", voice)

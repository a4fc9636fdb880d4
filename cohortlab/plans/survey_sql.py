"""The survey view as SQL common table expressions (DuckDB and Spark SQL read the same text).

Oracle queries are written as ``with_survey("SELECT ... FROM survey ...")`` so
that they run against the pre-registered base tables only.
"""

from __future__ import annotations

SURVEY_CTES = """
baskets AS (
  SELECT l_orderkey,
         CAST(count(*) AS BIGINT) AS n_lines,
         max(CASE WHEN l_partkey % 7 IN (0, 1) THEN 1 ELSE 0 END) AS t0,
         max(CASE WHEN l_partkey % 7 IN (1) THEN 1 ELSE 0 END) AS t1,
         max(CASE WHEN l_partkey % 7 IN (2) THEN 1 ELSE 0 END) AS t2,
         max(CASE WHEN l_partkey % 7 IN (0, 3) THEN 1 ELSE 0 END) AS t3,
         max(CASE WHEN l_partkey % 7 IN (3, 4) THEN 1 ELSE 0 END) AS t4,
         max(CASE WHEN l_partkey % 7 IN (5) THEN 1 ELSE 0 END) AS t5,
         max(CASE WHEN l_partkey % 7 IN (0, 4, 6) THEN 1 ELSE 0 END) AS t6
  FROM lineitem GROUP BY l_orderkey
), base AS (
  SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment, r.r_name,
         o.o_totalprice / CAST(500000 AS DOUBLE) AS x,
         CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal / CAST(50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS wtp,
         CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS d,
         CAST((o.o_orderkey * 7 + c.c_custkey) % 5 + 1 AS INT) AS t,
         CAST((o.o_orderkey * 3 + c.c_custkey) % 5 + 1 AS INT) AS f,
         CAST((o.o_orderkey + c.c_custkey * 5) % 4 AS INT) AS tier,
         CAST(o.o_orderkey % 3 + 1 AS INT) AS bill,
         CAST((o.o_orderkey * 11 + c.c_custkey) % 4 + 1 AS INT) AS bi,
         CAST(coalesce(b.n_lines, 0) AS INT) AS n_lines,
         coalesce(b.t0,0) t0, coalesce(b.t1,0) t1, coalesce(b.t2,0) t2, coalesce(b.t3,0) t3,
         coalesce(b.t4,0) t4, coalesce(b.t5,0) t5, coalesce(b.t6,0) t6
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN baskets b ON b.l_orderkey = o.o_orderkey
), scored AS (
  SELECT *, CASE WHEN t * 2 + d * 2 + f + wtp / CAST(20 AS DOUBLE) > CAST(18 AS DOUBLE) THEN 1 ELSE 0 END AS sub
  FROM base
), survey AS (
SELECT o_orderkey AS respondent_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Enterprise' WHEN 'BUILDING' THEN 'SME' WHEN 'FURNITURE' THEN 'Freelancer'
       WHEN 'HOUSEHOLD' THEN 'Individual' ELSE 'Student' END AS user_type,
  CASE c_custkey % 6 WHEN 0 THEN 'Design & Creative' WHEN 1 THEN 'Software Development' WHEN 2 THEN 'Marketing'
       WHEN 3 THEN 'Data' WHEN 4 THEN 'Finance' ELSE 'Other' END AS industry,
  r_name AS region,
  CASE c_custkey % 5 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' WHEN 3 THEN '45-54' ELSE '55+' END AS age_group,
  n_lines AS num_ai_tools_currently_used,
  CASE WHEN o_orderkey % 97 = 0 THEN -x ELSE x * x * x * x * CAST(750 AS DOUBLE) END AS monthly_spend_on_ai_usd,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Search' WHEN c_custkey % 3 = 1 THEN 'Referral' ELSE 'Social' END AS primary_discovery_method,
  CASE d WHEN 1 THEN 'Very Easy' WHEN 2 THEN 'Easy' WHEN 3 THEN 'Neutral' WHEN 4 THEN 'Difficult' ELSE 'Very Difficult' END AS difficulty_finding_tools,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN t = 1 THEN 'Never' WHEN t = 2 THEN 'Rarely' WHEN t = 3 THEN 'Sometimes' WHEN t = 4 THEN 'Often' ELSE 'Always' END AS trust_concern_frequency,
  CASE f WHEN 1 THEN 'Strongly Disagree' WHEN 2 THEN 'Disagree' WHEN 3 THEN 'Neutral' WHEN 4 THEN 'Agree' ELSE 'Strongly Agree' END AS subscription_fatigue,
  t0 AS uses_llm_writing_tools, t1 AS uses_image_gen_tools, t2 AS uses_video_gen_tools, t3 AS uses_code_assistant_tools,
  t4 AS uses_data_analytics_tools, t5 AS uses_voice_audio_tools, t6 AS uses_productivity_tools,
  CASE tier WHEN 0 THEN 'Free' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Gold' ELSE 'Platinum' END AS preferred_subscription_tier,
  CASE bill WHEN 1 THEN 'Monthly' WHEN 2 THEN 'Half-Yearly' ELSE 'Yearly' END AS preferred_billing_cadence,
  CASE bi WHEN 1 THEN 'Not Interested' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Interested' ELSE 'Very Interested' END AS bundle_interest,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE wtp END AS wtp_monthly_usd,
  sub AS will_subscribe,
  CASE WHEN o_orderkey % 89 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST((tier * 10 + f * 6 + bill * 4) AS DOUBLE) / CAST(100 AS DOUBLE) END AS churn_risk_score,
  CASE WHEN o_orderkey % 83 = 0 AND sub = 0 THEN CAST(5 AS DOUBLE) ELSE wtp * sub * (CASE bill WHEN 1 THEN CAST(100 AS DOUBLE) WHEN 2 THEN CAST(90 AS DOUBLE) ELSE CAST(80 AS DOUBLE) END) / CAST(100 AS DOUBLE) END AS estimated_mrr_usd
FROM scored
)"""

DIRTY_CTE = """
survey_dirty AS (
  SELECT * REPLACE (
    CASE WHEN respondent_id % 113 = 0 THEN NULL
         WHEN respondent_id % 79 = 0 THEN 2
         ELSE uses_voice_audio_tools END AS uses_voice_audio_tools)
  FROM (
    SELECT * FROM survey
    UNION ALL SELECT * FROM survey WHERE respondent_id % 101 = 0
    UNION ALL SELECT * REPLACE (respondent_id + 100000000 AS respondent_id) FROM survey WHERE respondent_id % 103 = 0
  ) u
)"""


def with_survey(body: str, *extra_ctes: str, dirty: bool = False) -> str:
    """Prefix ``body`` with the survey CTEs (and optional more ``name AS (...)`` CTEs)."""
    ctes = [SURVEY_CTES.strip()]
    if dirty:
        ctes.append(DIRTY_CTE.strip())
    ctes.extend(c.strip() for c in extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()

"""Column roles of the survey table and the fixed values every operator shares.

All operators take column names as parameters; the defaults below describe the
25-column survey table.  Nothing here touches Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values.  They stand for the dashboard's own tables, so that results
# agree: ordinal scales with their codes, the seven tool flags with their
# display labels, the persona names, the display orders of two charts, the
# business-rule check names and actions, outlier and missing-value actions
# (arrows and dashes in ASCII), the two class names of the classification
# report, the steps of the audit, and the columns of four tables and models
# in their order.
# ---------------------------------------------------------------------------
ORDINAL_SCALES: dict[str, dict[str, int]] = {
    "difficulty_finding_tools": {"Very Easy": 1, "Easy": 2, "Neutral": 3, "Difficult": 4, "Very Difficult": 5},
    "trust_concern_frequency": {"Never": 1, "Rarely": 2, "Sometimes": 3, "Often": 4, "Always": 5},
    "subscription_fatigue": {"Strongly Disagree": 1, "Disagree": 2, "Neutral": 3, "Agree": 4, "Strongly Agree": 5},
    "preferred_subscription_tier": {"Free": 0, "Silver": 1, "Gold": 2, "Platinum": 3},
    "bundle_interest": {"Not Interested": 1, "Neutral": 2, "Interested": 3, "Very Interested": 4},
    "preferred_billing_cadence": {"Monthly": 1, "Half-Yearly": 2, "Yearly": 3},
}

TOOL_LABELS: dict[str, str] = {
    "uses_llm_writing_tools": "LLM / Writing",
    "uses_image_gen_tools": "Image Gen",
    "uses_video_gen_tools": "Video Gen",
    "uses_code_assistant_tools": "Code Assistant",
    "uses_data_analytics_tools": "Data Analytics",
    "uses_voice_audio_tools": "Voice & Audio",
    "uses_productivity_tools": "Productivity",
}

PERSONA_NAMES: list[str] = [
    "Enterprise Power Buyers",
    "Growth-Stage Adopters",
    "Cost-Conscious Explorers",
    "Low-Engagement Browsers",
]

TIER_ORDER: list[str] = ["Free", "Silver", "Gold", "Platinum"]
TRUST_ORDER: list[str] = ["Never", "Rarely", "Sometimes", "Often", "Always"]

# business-rule checks (name, action) in display order
CHECK_FREE_WTP = ("Free-tier users with WTP > $50", "Reclassify WTP -> $5")
CHECK_NONSUB_MRR = ("Non-subscribers with MRR > $0", "Set MRR -> $0")
CHECK_CHURN_RANGE = ("Churn risk outside [0,1]", "Clip to [0,1]")
CHECK_NEG_SPEND = ("Negative monthly spend", "Set to 0")
CHECK_FLAGS = ("Binary tool flags not in {0,1}", "Round to nearest int")
OUTLIER_CAP = "Winsorize (cap to bounds)"
OUTLIER_RETAIN = "Retain - within range"
ACTION_NONE = "No action required"
ACTION_IMPUTE = "Impute median/mode"
CLASS_NAMES = ("Not Subscribe", "Subscribe")

# numbers and titles of the audit's steps
AUDIT_STEPS = (
    ("1", "Raw Data Ingestion"),
    ("2", "Missing Value Check"),
    ("3", "Duplicate Removal"),
    ("4", "Data Type Validation"),
    ("5", "Outlier Winsorization"),
    ("6", "Consistency Checks"),
    ("7a", "Ordinal Encoding"),
    ("7b", "Label Encoding (Nominal)"),
    ("7c", "StandardScaler"),
    ("7d", "Target Variable Derivation"),
    ("total", "All steps"),
)

# columns of the outlier tables, in display order; columns shown before and after scaling and in the explorer summary;
# features of the segments and of the models, in order
OUTLIER_COLUMNS = (
    "monthly_spend_on_ai_usd",
    "wtp_monthly_usd",
    "num_ai_tools_currently_used",
    "estimated_mrr_usd",
    "churn_risk_score",
)
SCALED_COLUMNS = (
    "monthly_spend_on_ai_usd",
    "wtp_monthly_usd",
    "num_ai_tools_currently_used",
    "estimated_mrr_usd",
)
CLUSTER_FEATURES = (
    "monthly_spend_on_ai_usd",
    "wtp_monthly_usd",
    "num_ai_tools_currently_used",
    "difficulty_finding_tools_ord",
    "trust_concern_frequency_ord",
    "subscription_fatigue_ord",
    "preferred_subscription_tier_ord",
)
MODEL_FEATURES = (
    "user_type_enc",
    "industry_enc",
    "region_enc",
    "age_group_enc",
    "num_ai_tools_currently_used",
    "monthly_spend_on_ai_usd",
    "primary_discovery_method_enc",
    "difficulty_finding_tools_ord",
    "trust_concern_frequency_ord",
    "subscription_fatigue_ord",
    "preferred_subscription_tier_ord",
    "preferred_billing_cadence_ord",
    "bundle_interest_ord",
    "wtp_monthly_usd",
    "uses_llm_writing_tools",
    "uses_image_gen_tools",
    "uses_video_gen_tools",
    "uses_code_assistant_tools",
    "uses_data_analytics_tools",
    "uses_voice_audio_tools",
    "uses_productivity_tools",
)
# -------------------------------------------------------------- end of fixed values

# Tokens that a survey CSV uses for "no answer" (pandas treats all as missing).
NA_TOKENS: list[str] = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

STATUS_FOUND = "Found"
STATUS_CLEAN = "Clean"


@dataclass(frozen=True)
class SurveyColumns:
    """Names of the columns that play a role in the survey operators."""

    id: str = "respondent_id"
    nominal: tuple[str, ...] = ("user_type", "industry", "region", "age_group", "primary_discovery_method")
    ordinal: tuple[str, ...] = tuple(ORDINAL_SCALES)
    tools: tuple[str, ...] = tuple(TOOL_LABELS)
    tools_count: str = "num_ai_tools_currently_used"
    spend: str = "monthly_spend_on_ai_usd"
    wtp: str = "wtp_monthly_usd"
    subscribe: str = "will_subscribe"
    churn: str = "churn_risk_score"
    mrr: str = "estimated_mrr_usd"
    tier: str = "preferred_subscription_tier"
    trust: str = "trust_concern_frequency"
    user_type: str = "user_type"
    industry: str = "industry"
    outlier_cols: tuple[str, ...] = OUTLIER_COLUMNS
    scale_cols: tuple[str, ...] = SCALED_COLUMNS
    cluster_features: tuple[str, ...] = CLUSTER_FEATURES
    model_features: tuple[str, ...] = MODEL_FEATURES


SURVEY = SurveyColumns()

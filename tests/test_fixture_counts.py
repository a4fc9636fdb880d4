"""Planted defects of the survey view at sf0.01 (the counts recorded in FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from cohortlab.config import SURVEY as C
from cohortlab.config import TOOL_LABELS
from cohortlab.operators import profile as prof
from cohortlab.operators import rules as ar
from cohortlab.sources.survey import survey_dirty, survey_view

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def survey(spark):
    return survey_view(spark, SF).cache()


def test_rows_and_missing(survey):
    assert survey.count() == 15_000
    m = {r.feature: r.missing_count for r in prof.missing_profile(survey).collect()}
    assert (m["primary_discovery_method"], m["trust_concern_frequency"], m["wtp_monthly_usd"]) == (366, 406, 284)


def test_business_rules(survey):
    got = [r.flagged for r in prof.run_checks(survey, prof.survey_rules()).orderBy("position").collect()]
    assert got[:4] == [2477, 79, 169, 155] and got[4] == 0


def test_outliers(survey):
    o = {r.feature: r.outliers for r in prof.outlier_summary(survey, list(C.outlier_cols)).collect()}
    assert [o[c] for c in ("monthly_spend_on_ai_usd", "num_ai_tools_currently_used", "churn_risk_score", "wtp_monthly_usd", "estimated_mrr_usd")] == [927, 300, 169, 0, 0]


def test_rules(survey):
    r = ar.mine_flag_rules(survey, TOOL_LABELS, 0.15, 0.5)
    assert r.count() == 112
    assert r.where(F.bit_count("con") == 2).count() == 29


def test_dirty_view(spark, survey):
    d = survey_dirty(spark, SF, survey)
    assert d.count() == 15_295
    dup = {r.kind: r.n_duplicates for r in prof.duplicate_profile(d, C.id).collect()}
    assert (dup["full_row"], dup["id"], dup["answers_without_id"]) == (149, 149, 289)
    flags = {r.check: r.flagged for r in prof.run_checks(d, prof.survey_rules()).collect()}
    assert flags["Binary tool flags not in {0,1}"] == 327

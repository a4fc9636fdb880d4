"""Empty inputs and hot groups keep their schema and give whole results."""

from pyspark.sql import functions as F

from cohortlab.config import SURVEY as C
from cohortlab.config import TOOL_LABELS
from cohortlab.operators import aggregate as agg
from cohortlab.operators import profile as prof
from cohortlab.operators import rules as ar


def test_empty_survey(survey_small):
    empty = survey_small.where(F.lit(False))
    k = agg.kpis(empty).first()
    assert k.n_respondents == 0 and k.subscribe_rate is None
    d = {r.feature: r for r in agg.describe(empty, list(C.scale_cols)).collect()}
    assert d[C.spend]["count"] == 0 and d[C.spend]["p50"] is None
    assert ar.mine_flag_rules(empty, TOOL_LABELS).count() == 0
    assert {r.check: r.flagged for r in prof.run_checks(empty, prof.survey_rules()).collect()}["Negative monthly spend"] == 0


def test_rules_empty_at_high_thresholds(survey_small):
    r = ar.mine_flag_rules(survey_small, TOOL_LABELS, min_support=0.95, min_confidence=0.5)
    assert r.count() == 0 and "lift" in r.columns
    kp = ar.rule_kpis(r, ar.top_rules(r, 30)).first()
    assert kp.rules_shown == 0 and kp.max_lift_shown is None


def test_hot_basket_third_of_rows(spark):
    # one basket (a, b) holds a third of all rows; the mask table still has one row per distinct basket
    rows = [(1, 1, 0)] * 100 + [(1, 0, 1)] * 100 + [(0, 1, 1)] * 100
    df = spark.createDataFrame(rows, "a int, b int, c int")
    masks = ar.mask_counts(df, ["a", "b", "c"])
    assert masks.count() == 3
    sup = {r["items"]: r["count"] for r in ar.itemset_support(masks, ["a", "b", "c"]).collect()}
    assert sup == {"a": 200, "b": 200, "c": 200, "a + b": 100, "a + c": 100, "b + c": 100}


def test_duplicates_with_a_hot_group(spark):
    df = spark.createDataFrame([(1, "x")] * 50 + [(2, "y"), (3, "y")], "id int, v string")
    d = {r.kind: r.n_duplicates for r in prof.duplicate_profile(df, "id").collect()}
    assert d == {"full_row": 49, "id": 49, "answers_without_id": 50}

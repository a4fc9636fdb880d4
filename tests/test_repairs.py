"""Hand-written expected values for answers that an oracle with the same expression cannot check."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.quantiles import exact_quantiles
from cohortlab.operators import aggregate as agg
from cohortlab.operators import classify as cls
from cohortlab.operators import encode as enc
from cohortlab.operators import profile as prof
from cohortlab.operators import rules as ar
from cohortlab.operators import segment as seg
from cohortlab.session import ensure_checkpoint_dir
from cohortlab.sources.csv_io import SURVEY_SCHEMA, cast_failures, read_survey
from cohortlab.streaming.uploads import run_once
from pyspark.errors import SparkRuntimeException, StreamingQueryException
from pyspark.sql import types as T


# --- quantiles: a value that holds nearly all rows -----------------------------------------------------------
def test_hot_minimum_never_ranks_the_tail_in_one_task(spark, monkeypatch):
    import cohortlab.functions.quantiles as q

    df = spark.range(20_000).select(F.when(F.col("id") % 1000 < 997, 0.0).otherwise(F.col("id") * 0.5).alias("x"))
    ranked = []
    exact = q._exact

    def spy(long, wins):
        ranked.extend(r["nd"] for r in q._tag(long, wins).groupBy("wid").agg(F.count_distinct("value").alias("nd")).collect())
        return exact(long, wins)

    monkeypatch.setattr(q, "_exact", spy)
    probs = [0.0, 0.25, 0.5, 0.9971, 0.999, 0.99999, 1.0]
    got = {r.q: r.value for r in exact_quantiles(df, ["x"], probs, buckets=16, max_exact=10).collect()}
    values = sorted(r.x for r in df.collect())
    for p in probs:
        h = (len(values) - 1) * p
        lo, hi = values[math.floor(h)], values[math.ceil(h)]
        assert got[p] == pytest.approx(lo + (hi - lo) * (h - math.floor(h)))
    assert ranked and max(ranked) <= 12  # the bound, plus the error of its sketch


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, 4.0)], "id long, x double")
    assert prof.missing_total(df).first()[0] == 2
    assert {r.feature: r.missing_count for r in prof.missing_profile(df).collect()} == {"id": 0, "x": 2}
    assert exact_quantiles(df, ["x"], [0.5]).first().value == 3.0


# --- repairs ------------------------------------------------------------------------------------------------
def survey_rows(spark, n=4, **columns):
    base = {f.name: None for f in SURVEY_SCHEMA.fields}
    rows = [tuple((base | {"respondent_id": i} | {k: v[i] for k, v in columns.items()}).values()) for i in range(n)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in SURVEY_SCHEMA.fields]))


def test_repair_keeps_null_flags(spark):
    df = survey_rows(spark, uses_voice_audio_tools=[None, 0, 2, -1], churn_risk_score=[None, 1.5, -0.5, 0.25])
    got = prof.repair_rules(df).orderBy("respondent_id").collect()
    assert [r.uses_voice_audio_tools for r in got] == [None, 0, 1, 0]
    assert [r.churn_risk_score for r in got] == [None, 1.0, 0.0, 0.25]


def test_impute_leaves_the_key_alone(spark):
    big = 9007199254740993
    df = survey_rows(spark, respondent_id=[big, 1, 2, 3], wtp_monthly_usd=[None, 1.0, 2.0, 4.0], num_ai_tools_currently_used=[1, 2, 3, 4], user_type=["b", "a", "a", None])
    out = prof.impute_median_mode(df)
    got = {r.respondent_id: r for r in out.collect()}
    assert dict(out.dtypes)["respondent_id"] == "bigint" and big in got and dict(out.dtypes)["num_ai_tools_currently_used"] == "int"
    assert got[big].wtp_monthly_usd == 2.0 and got[3].user_type == "a"


def test_outlier_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4] * 3 + [2, 3, 2, 1000]], "x double")  # 1 of 16 = 6.25 %
    assert prof.outlier_summary(df, ["x"]).first().outlier_pct == "6.2%"


def test_duplicates_by_id_and_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None), (3, "c")], "id long, x string")
    assert {r.kind: r.n_duplicates for r in prof.duplicate_profile(df, "id").collect()} == {"full_row": 1, "id": 3, "answers_without_id": 2}
    assert sorted(map(tuple, prof.drop_duplicate_ids(df, "id").collect())) == [(1, "a"), (2, None), (3, "c")]


# --- CSV ----------------------------------------------------------------------------------------------------
@pytest.fixture
def upload(tmp_path):
    def write(rows, names=None):
        names = names or [f.name for f in SURVEY_SCHEMA.fields]
        lines = [",".join(names)] + [",".join(str(r.get(n, "")) for n in names) for r in rows]
        path = tmp_path / "in"
        path.mkdir(exist_ok=True)
        (path / f"{len(list(path.iterdir()))}.csv").write_text("\n".join(lines) + "\n")
        return str(path)

    return write


def test_csv_numbers_that_do_not_fit(spark, upload):
    path = upload(
        [
            {"respondent_id": "9007199254740993.0", "will_subscribe": "3000000000", "wtp_monthly_usd": "NaN"},
            {"respondent_id": "1e3", "will_subscribe": "1.0", "wtp_monthly_usd": "#N/A N/A"},
            {"respondent_id": "7", "will_subscribe": "0.5", "wtp_monthly_usd": "x"},
        ]
    )
    got = sorted(map(lambda r: (r.respondent_id, r.will_subscribe, r.wtp_monthly_usd), read_survey(spark, path).collect()))
    assert got == [(7, None, None), (1000, 1, None), (9007199254740993, None, None)]
    bad = {r.feature: r.failures for r in cast_failures(spark, path).collect() if r.failures}
    assert bad == {"will_subscribe": 2, "wtp_monthly_usd": 1}


def test_stream_refuses_a_reordered_header(spark, upload):
    names = [f.name for f in SURVEY_SCHEMA.fields]
    row = {"respondent_id": 1, "user_type": "SME", "will_subscribe": 1}
    path, run = upload([row]), uuid.uuid4().hex
    assert run_once(spark, path, f"in_order_{run}").first().user_type == "SME"
    path = upload([row], names[::-1])
    with pytest.raises((StreamingQueryException, SparkRuntimeException)):
        run_once(spark, path, f"reordered_{run}").collect()


# --- no caps ------------------------------------------------------------------------------------------------
def test_label_codes_of_200_000_categories(spark):
    df = spark.range(200_000).select(F.format_string("v%07d", F.col("id")).alias("c"), F.lit(None).cast("string").alias("e"), "id")
    out = enc.label_encode(df.repartition(7), ["c", "e"])
    assert out.where("c_enc <> id or e_enc <> 0").count() == 0 and out.count() == 200_000


def test_labels_that_the_codes_do_not_know(spark):
    codes = enc.label_codes(spark.createDataFrame([("b",), ("a",), ("b",)], "c string"), ["c"])
    out = enc.label_encode(spark.createDataFrame([("b",), ("z",), (None,)], "c string"), ["c"], codes)
    assert sorted(map(tuple, out.collect()), key=str) == [("b", 1), ("z", 2), (None, 2)]


def test_crosstab_of_12_000_values(spark):
    df = spark.range(12_000).select((F.col("id") % 2).alias("r"), F.col("id").alias("c"))
    out = agg.crosstab_long(df, "r", "c")
    assert out.count() == 24_000 and out.agg(F.sum("n")).first()[0] == 12_000


def test_forty_flags(spark):
    flags = {f"f{i}": f"F{i}" for i in range(40)}
    rows = [tuple(int(i in (0, 38, 39)) for i in range(40))] * 3 + [(0,) * 40]
    df = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in flags))
    got = {(r.antecedent, r.consequent): r.confidence for r in ar.mine_flag_rules(df, flags, 0.5, 0.5).collect()}
    assert len(got) == 12 and got["F0 + F39", "F38"] == 1.0


def test_basket_rules_with_several_consequents(spark):
    baskets = [(["a", "b", "c"],)] * 6 + [(["a", "b"],)] * 2 + [(["c", "d"],)] + [(["d"],)]
    got = {(r.antecedent, r.consequent): (r.support, r.confidence, r.lift) for r in ar.basket_rules(spark.createDataFrame(baskets, "items array<string>"), 0.3, 0.1).collect()}
    assert got["a", "b, c"] == (0.6, 0.75, 1.25) and got["b, c", "a"] == (0.6, 1.0, 1.25) and len(got) == 12


def test_silhouette_of_nothing_one_and_many_clusters(spark):
    none = spark.createDataFrame([], "x double, lab int")
    assert tuple(seg.silhouette(none, ["x"], "lab").first()) == (None, 0)
    one = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, lab int")
    assert tuple(seg.silhouette(one, ["x"], "lab").first()) == (0.0, 2)
    many = spark.range(600).select((F.col("id") % 300 * 100 + F.col("id") % 7 * 0.1).alias("x"), (F.col("id") % 300).cast("int").alias("lab"))
    assert seg.silhouette(many, ["x"], "lab").first().silhouette > 0.99


def test_display_names():
    assert [cls.display_name(f) for f in ("trust_concern_ord", "user_type_enc", "wtp", "encoded_ordinal")] == ["Trust Concern", "User Type", "Wtp", "Encoded Ordinal"]


def test_cluster_sessions_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())

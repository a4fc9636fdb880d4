"""Hand-sized frames with known answers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.exprs import not_binary
from cohortlab.operators import classify as cls
from cohortlab.operators import encode as enc
from cohortlab.operators import forecast as fc
from cohortlab.operators import rules as ar
from cohortlab.sources.csv_io import read_survey
from pyspark.sql import types as T


def test_null_flag_counts_as_bad(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "x int")
    assert df.agg(F.count_if(not_binary("x"))).first()[0] == 2


def test_ties_have_a_fixed_order(spark):
    rows = [("b", "x", 0.2, 0.5, 1.5), ("a", "y", 0.2, 0.5, 1.5), ("a", "x", 0.2, 0.5, 1.5), ("c", "x", 0.3, 0.6, 1.5)]
    df = spark.createDataFrame(rows, "antecedent string, consequent string, support double, confidence double, lift double")
    got = [(r.antecedent, r.consequent) for r in ar.top_rules(df, 3).collect()]
    assert got == [("c", "x"), ("a", "x"), ("a", "y")]


def test_one_class_metrics_are_zero_not_errors(spark):
    df = spark.createDataFrame([(0, 0)] * 5, "label int, pred int")
    m = cls.binary_metrics(df, "label", "pred").first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (1.0, 0.0, 0.0, 0.0)
    rep = {r.label: r for r in cls.classification_report(df, "label", "pred").collect()}
    assert rep["Subscribe"].support == 0.0 and rep["Not Subscribe"].recall == 1.0
    cm = {(r.actual, r.predicted): r.n for r in cls.confusion_matrix(df, "label", "pred").collect()}
    assert cm == {(0, 0): 5, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 3.0)], "id int, x double")
    z = enc.standardize(df, ["x"], keep=["id"]).collect()
    assert [r.x for r in z] == [0.0, 0.0, 0.0]
    h = fc.histogram(df, "x", 30).collect()
    assert sum(r.n for r in h) == 3 and [r.n for r in h if r.n] == [3] and h[0].n == 3


def test_six_points_population_sd(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, x double")
    st = enc.moment_stats(df, ["x"]).first()["x"]
    assert st["sd"] == pytest.approx(1.7078, abs=1e-4)
    chk = enc.scale_check(df, ["x"]).first()
    assert chk.std_before == 1.87 and chk.std_after == pytest.approx(1.0954, abs=1e-4)


def test_csv_tokens_and_casts(spark):
    folder = tempfile.mkdtemp(prefix="cohortlab-csv-")
    path = os.path.join(folder, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d,e\n1,NA,None,nan,True\n2.0,x,,1.5,False\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType()),
                           T.StructField("d", T.DoubleType()), T.StructField("e", T.IntegerType())])
    rows = read_survey(spark, path, schema).orderBy("a").collect()
    assert rows[0].a == 1 and rows[0].b is None and rows[0].c is None and rows[0].d is None
    assert rows[1].a == 2 and rows[1].b == "x" and rows[1].c is None and rows[1].d == 1.5
    assert rows[0].e is None  # 'True' is not an integer: NULL, not a failed job


def test_five_baskets_supports(spark):
    names = ["a", "b", "c"]
    flags = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 1, 0), (0, 0, 0), (0, 0, 1)], "a int, b int, c int")
    sup = {r["items"]: r["support"] for r in ar.itemset_support(ar.mask_counts(flags, ["a", "b", "c"]), names).collect()}
    assert sup["a"] == 0.6 and sup["b"] == 0.6 and sup["c"] == 0.6
    assert sup["a + b"] == 0.6 and sup["a + b + c"] == 0.4
    baskets = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c"],), (["a", "b"],), ([],), (["c"],)], "items array<string>")
    fp = {", ".join(r["items"]): r["support"] for r in ar.fpgrowth_itemsets(baskets, 0.3).collect()}
    assert fp["a"] == 0.6 and fp["a, b, c"] == 0.4  # the empty basket stays in the denominator


def test_ward_merge_small_exact():
    import numpy as np

    from cohortlab.operators.ward import ward_merge

    pts = np.array([[0.0], [0.1], [5.0], [5.2], [10.0]])
    labels = ward_merge(pts, np.ones(5), 3)
    assert labels.tolist() == [0, 0, 1, 1, 2]

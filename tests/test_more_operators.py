"""Many flags, rule differences, exact splits, noise and metrics over any labels: brute force and hand-written values."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions.exprs import bitmask, normal, uniform, wide_has, wide_items, wide_minus, wide_of, wide_size
from cohortlab.operators import classify as cls
from cohortlab.operators import encode as enc
from cohortlab.operators import rules as ar


# --- more than 62 flags --------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def many_flags(spark):
    rng = np.random.default_rng(2)
    base = rng.random((300, 200)) < rng.choice([0.02, 0.3, 0.6], 200, p=[0.8, 0.15, 0.05])
    base[:, 199] = base[:, 0] | base[:, 63]
    x = base.astype(int)
    names = [f"f{i}" for i in range(200)]
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{f} int" for f in names)).repartition(5)
    return x, names, df


def supports_brute(x, names, min_support, max_size=3):
    n, out = len(x), {}
    often = [i for i in range(x.shape[1]) if x[:, i].mean() >= min_support]
    for size in range(1, max_size + 1):
        for c in combinations(often, size):
            s = x[:, c].all(1).sum() / n
            if s >= min_support:
                out[" + ".join(names[i] for i in c)] = s
    return out


def test_itemsets_of_200_flags(many_flags):
    x, names, df = many_flags
    got = ar.wide_itemsets(ar.mask_counts(df, names), names, 0.15).collect()
    assert {r["items"]: r.support for r in got} == pytest.approx(supports_brute(x, names, 0.15))
    assert all(r.size == len(r["items"].split(" + ")) and sum(bin(w).count("1") for w in r.itemset) == r.size for r in got)


def test_rules_of_200_flags(many_flags):
    x, names, df = many_flags
    sup = supports_brute(x, names, 0.15)
    want = {}
    for key, s in sup.items():
        items = key.split(" + ")
        for k in range(1, len(items)):
            for ant in combinations(items, k):
                con = " + ".join(i for i in items if i not in ant)
                ant = " + ".join(ant)
                if s / sup[ant] >= 0.5:
                    want[ant, con] = (s, s / sup[ant], s / sup[ant] / sup[con])
    got = {(r.antecedent, r.consequent): (r.support, r.confidence, r.lift) for r in ar.mine_flag_rules(df, dict(zip(names, names)), 0.15, 0.5).collect()}
    assert set(got) == set(want) and len(got) > 50
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=6e-5)


def test_all_supports_and_cooccurrence_of_many_flags(spark):
    rows = [tuple(int(i in on) for i in range(70)) for on in ({0, 61, 62, 69}, {0, 62}, set(), {69})]
    names = [f"f{i}" for i in range(70)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in names))
    got = {r["items"]: r["count"] for r in ar.itemset_support(ar.mask_counts(df, names), names).collect()}
    assert got["f0 + f62"] == 2 and got["f69"] == 2 and got["f61 + f62 + f69"] == 1 and len(got) == 4 + 6 + 4
    cells = {(r.item_a, r.item_b): r.support for r in ar.cooccurrence(df, dict(zip(names, names))).collect()}
    assert len(cells) == 4900 and cells["f0", "f62"] == cells["f62", "f0"] == 0.5 and cells["f1", "f2"] == 0 and cells["f69", "f69"] == 0.5


def test_wide_mask_operations(spark):
    names = [f"f{i}" for i in range(130)]
    df = spark.createDataFrame([tuple(int(i in (0, 61, 62, 124, 129)) for i in range(130))], ", ".join(f"{f} int" for f in names))
    m = F.col("m")
    row = df.select(bitmask(names).alias("m")).select(
        wide_items(m, 130).alias("i"), wide_size(m).alias("n"), wide_has(m, F.lit(62)).alias("has"), wide_has(m, F.lit(63)).alias("not"),
        wide_items(wide_minus(m, wide_of(F.array(F.lit(0), F.lit(129)), 130)), 130).alias("less"), (wide_of(wide_items(m, 130), 130) == m).alias("back"),
    ).first()
    assert (row.i, row.n, row.has, row["not"], row.less, row.back) == ([0, 61, 62, 124, 129], 5, True, False, [61, 62, 124], True)


# --- difference of rule lists --------------------------------------------------------------------------------
def test_rule_difference_both_ways(spark):
    schema = "antecedent string, consequent string, lift double"
    one = spark.createDataFrame([("a", "b", 1.5), ("a", "b", 1.5), ("b", "c", 2.0), ("x", None, None)], schema)
    two = spark.createDataFrame([("a", "b", 1.5), ("b", "c", 2.1), ("x", None, None)], schema)
    got = sorted(map(tuple, ar.rule_difference(one, two, ("one", "two")).collect()))
    assert got == [("one", 1, "a", "b", 1.5), ("one", 1, "b", "c", 2.0), ("two", 1, "b", "c", 2.1)]
    assert ar.rule_difference(one, one.repartition(3)).collect() == []


# --- exact split ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 5, 999, 5000])
@pytest.mark.parametrize("fraction", [0.2, 0.35])
def test_exact_split_sizes(spark, n, fraction):
    df = spark.range(n).withColumn("x", F.lit(1))
    got = {}
    for parts in (1, 7):
        rows = enc.exact_split(df.repartition(parts), "id", fraction).collect()
        got[parts] = {r.id for r in rows if r.split == "test"}
        assert len(rows) == n and len(got[parts]) == math.ceil(fraction * n)
    assert got[1] == got[7]


def test_exact_split_breaks_ties_by_key(spark, monkeypatch):
    monkeypatch.setattr(enc, "split_hash", lambda key, seed=42: F.lit(7).cast("bigint") + 0 * F.col(key) if isinstance(key, str) else F.lit(7))
    rows = enc.exact_split(spark.range(50).repartition(4), "id", 0.3).collect()
    assert {r.id for r in rows if r.split == "test"} == set(range(15))


def test_exact_split_of_edges(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "id long")
    assert sorted((r.split for r in enc.exact_split(df, "id", 1.0).collect())) == ["test"] * 3
    assert {r.split for r in enc.exact_split(df, "id", 0.0).collect()} == {"train"}
    assert {r.id: r.split for r in enc.exact_split(df, "id", 0.5).collect()}[None] == "train"
    assert enc.exact_split(df.limit(0), "id").collect() == []


# --- noise ---------------------------------------------------------------------------------------------------
def test_noise_is_a_function_of_seed_and_key(spark):
    df = spark.range(20_000)
    cols = [uniform("id").alias("u"), normal("id").alias("z"), normal("id", 42, 1).alias("w"), normal("id", 7).alias("other")]
    a = {r.id: tuple(r) for r in df.repartition(3).select("id", *cols).collect()}
    assert a == {r.id: tuple(r) for r in df.coalesce(1).select("id", *cols).collect()}
    u, z, w, other = np.array([a[i][1:] for i in range(20_000)]).T
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12**-0.5) < 0.005
    for v in (z, w, other):
        assert abs(v.mean()) < 0.03 and abs(v.std() - 1) < 0.02 and abs((v**3).mean()) < 0.1 and abs((np.abs(v) < 1).mean() - 0.6827) < 0.015
    assert abs(np.corrcoef(z, w)[0, 1]) < 0.03 and abs(np.corrcoef(z, other)[0, 1]) < 0.03


def test_targets_with_and_without_noise(spark, survey_small):
    plain = {r.respondent_id: r for r in enc.derive_targets(survey_small).collect()}
    noisy = {r.respondent_id: r for r in enc.derive_targets(survey_small, noise=0.5).collect()}
    off = np.array([noisy[k].subscription_score - plain[k].subscription_score for k in plain])
    assert abs(off.mean()) < 0.06 and abs(off.std() - 0.5) < 0.04
    assert all(0 <= r.churn_risk_derived <= 1 for r in noisy.values())
    assert all(r.will_subscribe_derived == int(r.subscription_score > 3.2) for r in noisy.values())


# --- any labels ----------------------------------------------------------------------------------------------
ROWS = [("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")] + [("c", "a")] + [("c", None)] * 2 + [(None, "b")] + [(None, None)]


def test_confusion_of_three_classes(spark):
    df = spark.createDataFrame(ROWS, "y string, p string").repartition(3)
    got = {(r.actual, r.predicted): r.n for r in cls.confusion_table(df, "y", "p").collect()}
    assert got == {
        ("a", "a"): 4, ("a", "b"): 1, ("a", "c"): 0, ("b", "a"): 0, ("b", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("c", "b"): 0, ("c", "c"): 0,
        ("c", None): 2, (None, "b"): 1, (None, None): 1,
    }
    assert sum(got.values()) == len(ROWS)


def test_report_of_three_classes(spark):
    got = {(r.kind, r.label): (r.precision, r.recall, r.f1_score, r.support) for r in cls.label_report(spark.createDataFrame(ROWS, "y string, p string"), "y", "p").collect()}
    assert got == {
        ("label", "a"): (0.8, 0.8, 0.8, 5.0), ("label", "b"): (0.667, 0.667, 0.667, 3.0), ("label", "c"): (0.0, 0.0, 0.0, 1.0),
        ("summary", "accuracy"): (0.667, 0.667, 0.667, 0.667), ("summary", "macro avg"): (0.489, 0.489, 0.489, 9.0),
        ("summary", "weighted avg"): (0.667, 0.667, 0.667, 9.0), ("summary", "unscored"): (None, None, None, 4.0),
    }


def test_report_agrees_with_the_binary_one(spark):
    df = spark.createDataFrame([(1, 1.0)] * 6 + [(1, 0.0)] * 2 + [(0, 1.0)] + [(0, 0.0)] * 3, "y int, p double")
    many = {r.label: r for r in cls.label_report(df, "y", "p").collect()}
    two = {r.label: r for r in cls.classification_report(df, "y", "p", names=("0.0", "1.0")).collect()}
    for label in two:
        assert [many[label][c] for c in ("precision", "recall", "f1_score", "support")] == [two[label][c] for c in ("precision", "recall", "f1_score", "support")], label


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "y string, p string")
    assert cls.confusion_table(none, "y", "p").collect() == []
    assert {r.label: r.support for r in cls.label_report(none, "y", "p").collect()} == {"accuracy": 0.0, "macro avg": 0.0, "weighted avg": 0.0, "unscored": 0.0}


def test_binary_card_counts_what_it_leaves_out(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, None), (None, 0), (2, 1)], "y int, p int")
    r = cls.binary_metrics(df, "y", "p").first()
    assert (r.n, r.unscored, r.accuracy) == (2, 3, 1.0)

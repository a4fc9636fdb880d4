
from pyspark.sql import functions as F

from cohortlab.config import SURVEY as C
from cohortlab.config import TOOL_LABELS
from cohortlab.operators import classify as cls
from cohortlab.operators import encode as enc
from cohortlab.operators import forecast as fc
from cohortlab.operators import profile as prof
from cohortlab.operators import rules as ar
from cohortlab.operators import segment as seg

NAMES = list(TOOL_LABELS.values())


def test_rules_respect_thresholds_and_lift_symmetry(survey_small):
    r = ar.mine_flag_rules(survey_small, TOOL_LABELS, 0.15, 0.5).collect()
    assert r and all(x.confidence >= 0.5 - 1e-4 and x.support >= 0.15 - 1e-4 for x in r)
    lift = {(x.antecedent, x.consequent): x.lift for x in r}
    for (a, c), v in lift.items():
        if (c, a) in lift:
            assert abs(lift[(c, a)] - v) <= 2e-4


def test_fpgrowth_path_equals_mask_path(survey_small):
    mask = ar.mine_flag_rules(survey_small, TOOL_LABELS, 0.15, 0.5, sep="+").drop("ant", "con")
    items = ar.fpgrowth_itemsets(ar.flag_baskets(survey_small), 0.15, max_size=3)
    fp = ar.rules_from_itemsets(ar.itemsets_to_masks(items, NAMES, "+"), 7, NAMES, 0.5, sep="+").drop("ant", "con")
    assert mask.exceptAll(fp).count() == 0 and fp.exceptAll(mask).count() == 0


def test_winsorized_values_inside_fences(survey_small):
    cols = list(C.outlier_cols)
    fences = {r.feature: r for r in prof.iqr_fences(survey_small, cols).collect()}
    w = prof.winsorize(survey_small, cols)
    agg = w.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    for c in cols:
        assert agg[f"lo_{c}"] >= fences[c].lower_fence - 1e-9 and agg[f"hi_{c}"] <= fences[c].upper_fence + 1e-9
    assert w.count() == survey_small.count()


def test_confusion_and_histogram_sum_to_n(survey_small):
    df = survey_small.select(C.subscribe, F.when(F.col(C.wtp) > 90, 1).otherwise(0).alias("pred"), C.mrr)
    n = df.count()
    assert sum(r.n for r in cls.confusion_matrix(df, C.subscribe, "pred").collect()) == n
    assert sum(r.n for r in fc.histogram(df, C.mrr, 30).collect()) == n


def test_split_is_disjoint_complete_and_stable(survey_small):
    a = enc.train_test_split(survey_small.select(C.id), C.id)
    b = enc.train_test_split(survey_small.select(C.id).repartition(7), C.id)
    assert a.count() == survey_small.count()
    assert a.select(C.id).distinct().count() == a.count()
    assert a.exceptAll(b).count() == 0
    frac = a.where(F.col("split") == "test").count() / a.count()
    assert 0.1 < frac < 0.3


def test_label_encoding_is_invertible(survey_small):
    e = enc.label_encode(survey_small, ["user_type", "industry"])
    for c in ["user_type", "industry"]:
        pairs = e.select(c, f"{c}_enc").distinct()
        assert pairs.count() == pairs.select(f"{c}_enc").distinct().count() == pairs.select(c).distinct().count()


def test_duplicate_counts_on_dirty(spark, sf_small):
    from cohortlab.sources.survey import survey_dirty

    d = {r.kind: r.n_duplicates for r in prof.duplicate_profile(survey_dirty(spark, sf_small), C.id).collect()}
    assert d["full_row"] == d["id"] and d["answers_without_id"] >= d["full_row"] > 0


def test_silhouette_matches_clustering_evaluator(survey_small):
    z, feats = seg.cluster_input(survey_small)
    z = z.join(survey_small.select(C.id, C.user_type), C.id)
    ours = seg.silhouette(z, feats, C.user_type).first().silhouette
    from pyspark.ml.feature import StringIndexer

    v = enc.assemble(z, feats)
    v = StringIndexer(inputCol=C.user_type, outputCol="lab").fit(v).transform(v)
    theirs = seg.silhouette_spark(v, "lab")
    assert abs(ours - theirs) < 1e-9


def test_kmeans_best_of_starts_is_deterministic(survey_small):
    z, feats = seg.cluster_input(survey_small)
    v = enc.assemble(z, feats).select(C.id, "features").cache()
    m1 = seg.fit_kmeans(v, k=3, n_init=3)
    m2 = seg.fit_kmeans(v, k=3, n_init=3, parallel=1)
    assert abs(m1.summary.trainingCost - m2.summary.trainingCost) < 1e-6

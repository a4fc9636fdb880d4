"""Purchase-intent classification: random forest, logistic regression and their metric tables.

Metrics come from the 2x2 counts of one aggregation (no per-row Python); every
ratio with an empty denominator is 0, as in the usual "zero division" default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.config import CLASS_NAMES
from cohortlab.functions.exprs import col_of
from cohortlab.operators.encode import assemble, fit_cached, moment_stats, standardize
from cohortlab.operators.forest import Forest, fit_forest, predict_forest

def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, label: str | Column, pred: str | Column) -> DataFrame:
    y, p = col_of(label), col_of(pred)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
        F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
        # a missing or another value on either side: no cell of the 2 x 2 table, but not lost either
        F.count_if(~F.coalesce(y.isin(0, 1) & p.isin(0, 1), F.lit(False))).cast("long").alias("unscored"),
    )


def binary_metrics(df: DataFrame, label: str | Column, pred: str | Column, digits: int = 4) -> DataFrame:
    """accuracy, precision, recall, F1 of class 1, rounded half-even; n rows with 0 or 1 on both sides, ``unscored`` others."""
    cc = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = _ratio(F.lit(2.0) * prec * rec, prec + rec)
    return cc.select(
        F.bround(_ratio(tp + tn, n), digits).alias("accuracy"),
        F.bround(prec, digits).alias("precision"),
        F.bround(rec, digits).alias("recall"),
        F.bround(f1, digits).alias("f1"),
        n.alias("n"),
        "unscored",
    )


def confusion_matrix(df: DataFrame, label: str | Column, pred: str | Column) -> DataFrame:
    """Long 2x2 matrix ``(actual, predicted, n)`` with zero cells."""
    cc = confusion_counts(df, label, pred)
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(name).alias("n"))
        for a, p, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return cc.select(F.inline(F.array(*cells)))


def classification_report(df: DataFrame, label: str | Column, pred: str | Column, names: Sequence[str] = CLASS_NAMES, digits: int = 3) -> DataFrame:
    """Per class precision / recall / F1 / support, the accuracy row (value repeated in every
    column, support included) and macro / weighted averages — rounded half-even."""
    cc = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = (tp + fp + fn + tn).cast("double")
    # class 1: tp/fp/fn as is; class 0: roles swapped
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1_1, f1_0 = _ratio(F.lit(2.0) * p1 * r1, p1 + r1), _ratio(F.lit(2.0) * p0 * r0, p0 + r0)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    acc = _ratio(tp + tn, n)
    r = lambda e: F.bround(e, digits)
    rows = [
        (1, names[0], p0, r0, f1_0, s0),
        (2, names[1], p1, r1, f1_1, s1),
        (3, "accuracy", acc, acc, acc, acc),
        (4, "macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        (5, "weighted avg", _ratio(p0 * s0 + p1 * s1, n), _ratio(r0 * s0 + r1 * s1, n), _ratio(f1_0 * s0 + f1_1 * s1, n), n),
    ]
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("label"), r(p).alias("precision"), r(rc).alias("recall"), r(f).alias("f1_score"), r(s).alias("support"))
        for i, name, p, rc, f, s in rows
    ]
    return cc.select(F.inline(F.array(*cells)))


# --------------------------------------------------------------------------- any set of labels
def label_counts(df: DataFrame, label: str | Column, pred: str | Column) -> DataFrame:
    """``(actual, predicted, n)`` of the pairs that occur, as text; NULL and NaN stand for a row without one.  One hash aggregate."""

    def text(c: Column, kind: str) -> Column:
        return F.when(~F.isnan(c), c).cast("string") if kind in ("double", "float") else c.cast("string")

    pairs = df.select(col_of(label).alias("actual"), col_of(pred).alias("predicted"))
    kinds = dict(pairs.dtypes)
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    if set(kinds.values()) <= numeric and len(set(kinds.values())) > 1:  # 1 and 1.0 are one label
        pairs, kinds = pairs.select(*[F.col(c).cast("double").alias(c) for c in pairs.columns]), dict.fromkeys(kinds, "double")
    return pairs.select(*[text(F.col(c), kinds[c]).alias(c) for c in pairs.columns]).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_table(df: DataFrame, label: str | Column, pred: str | Column) -> DataFrame:
    """The matrix over all labels that occur on either side, zero cells included, in long form; rows without a label or prediction
    are cells with NULL (where there are any), so ``n`` always adds up to the rows of ``df``.

    The grid comes from the two sides' distinct labels; it has labels squared cells by definition.
    """
    counts = label_counts(df, label, pred)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("lab")).where("lab is not null").distinct()
    grid = labels.select(F.col("lab").alias("actual"), F.lit(1).alias("one")).join(labels.select(F.col("lab").alias("predicted"), F.lit(1).alias("one")), "one").drop("one")
    full = grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.unionByName(counts.where("actual is null or predicted is null").select("actual", "predicted", F.col("n").cast("long").alias("n")))


def label_report(df: DataFrame, label: str | Column, pred: str | Column, digits: int = 3) -> DataFrame:
    """Per label precision, recall, F1 and support, then accuracy (as in ``classification_report``), macro and weighted means, and ``unscored``:
    the rows without a label or prediction, which take part in nothing else.

    Sums by actual and by predicted label of the grouped counts, joined by label: work grows with the labels that occur, not with rows or cells.
    """
    counts = label_counts(df, label, pred)
    scored = counts.where("actual is not null and predicted is not null")
    by_actual = scored.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    by_predicted = scored.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    each = by_actual.join(by_predicted, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("support", "hits", "predicted")])
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    each = each.select("label", "support", "hits", precision.alias("precision"), recall.alias("recall"))
    each = each.withColumn("f1_score", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1_score"]
    unscored = counts.where("actual is null or predicted is null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double"))
    total = each.agg(
        F.coalesce(F.sum("support"), F.lit(0.0)).alias("n"),
        F.coalesce(F.sum("hits"), F.lit(0.0)).alias("hits"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in measures],
        *[F.coalesce(F.sum(F.col(m) * F.col("support")), F.lit(0.0)).alias(f"sum_{m}") for m in measures],
    ).withColumn("unscored", unscored.scalar())
    n = F.col("n")
    rows = [
        ("accuracy", *[_ratio(F.col("hits"), n)] * 4),
        ("macro avg", *[F.col(f"macro_{m}") for m in measures], n),
        ("weighted avg", *[_ratio(F.col(f"sum_{m}"), n) for m in measures], n),
        ("unscored", *[F.lit(None).cast("double")] * 3, F.col("unscored")),
    ]
    names = [*measures, "support"]
    cells = [F.struct(F.lit("summary").alias("kind"), F.lit(r[0]).alias("label"), *[v.alias(c) for c, v in zip(names, r[1:], strict=True)]) for r in rows]
    both = each.select(F.lit("label").alias("kind"), "label", *names).unionByName(total.select(F.inline(F.array(*cells))))
    return both.select("kind", "label", *[(F.bround(c, digits) + F.lit(0.0)).alias(c) for c in names])


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str, n_trees: int = 100, max_depth: int = 10, seed: int = 42,
                      max_bins: int = 32, max_memory_mb: int = 64) -> Forest:
    """Random forest with sqrt(p) features per split and gini impurity."""
    return fit_forest(train, features, label, n_trees, max_depth, seed, max_bins, max_memory_mb)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, max_iter: int = 1000,
                 tol: float = 1e-4) -> tuple[LogisticRegressionModel, DataFrame]:
    """L2 logistic regression on features standardized with training statistics (population sd).

    The objective 0.5|w|^2 + C sum(logloss) equals Spark's mean(logloss) + regParam/2 |w|^2 with
    regParam = 1 / (C n).  Returns the model and the training statistics (for scaling new rows).
    """
    stats = moment_stats(train, features)
    z = standardize(train, features, stats, keep=[label])
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0,
                            standardization=False, tol=tol)
    model = fit_cached(lr, assemble(z, features).select("features", F.col(label).cast("double").alias(label)), n, keep=False)  # it keeps blocks of its own
    return model, stats


def predict_rf(model: Forest, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return predict_forest(model, df, features, keep)


def predict_logistic(model: LogisticRegressionModel, stats: DataFrame, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    z = standardize(df, features, stats, keep=keep)
    out = model.transform(assemble(z, features))
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"))


def display_name(feature: str) -> str:
    """Words of a feature name without the marker of its encoding."""
    words = feature.removesuffix("_enc").removesuffix("_ord").split("_")
    return " ".join(w.capitalize() for w in words if w)


def feature_importance(model: Forest, features: Sequence[str], spark, top: int = 12) -> DataFrame:
    """Top-``top`` gini importances with display names, plus the mean of the shown ones."""
    imp = model.importances.tolist()
    df = spark.createDataFrame([(f, display_name(f), float(v)) for f, v in zip(features, imp)], "feature string, name string, importance double")
    shown = df.orderBy(F.desc("importance"), F.asc("feature")).limit(top)
    mean = shown.agg(F.avg("importance")).scalar()
    return shown.select("feature", "name", "importance", mean.alias("mean_shown"))


def compare(metrics: Mapping[str, DataFrame], score: str, first_wins_ties: str) -> DataFrame:
    """Union of per-model metric rows with the winner by ``score`` (ties go to ``first_wins_ties``)."""
    parts = [m.select(F.lit(name).alias("model"), "*") for name, m in metrics.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    winner = F.max_by("model", F.struct(F.col(score), F.when(F.col("model") == first_wins_ties, 1).otherwise(0)))
    return out.withColumn("winner", winner.over(Window.partitionBy(F.lit(1))))  # as many rows as models


#: What a caller may choose, and the models fitted for it.
CHOICES = {"rf": ("Random Forest",), "lr": ("Logistic Regression",), "both": ("Random Forest", "Logistic Regression")}


def train_and_score(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, choice: str = "both", n_trees: int = 100, max_depth: int = 10, c: float = 1.0, seed: int = 42
) -> DataFrame:
    """Metrics on ``test`` of the chosen models ('rf', 'lr' or 'both'), with the winner by F1; a model that is not chosen is not fitted."""
    if choice not in CHOICES:
        raise ValueError(f"choice is one of {sorted(CHOICES)}, not {choice!r}")
    scored: dict[str, DataFrame] = {}
    for name in CHOICES[choice]:
        if name == "Random Forest":
            model = fit_random_forest(train, features, label, n_trees, max_depth, seed)
            predicted = predict_rf(model, test, features, [label])
        else:
            lr, stats = fit_logistic(train, features, label, c)
            predicted = predict_logistic(lr, stats, test, features, [label])
        scored[name] = binary_metrics(predicted, label, "prediction")
    return compare(scored, "f1", CHOICES[choice][0])

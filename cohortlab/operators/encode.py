"""Feature encoding: ordinal codes, label codes, category catalogue, z-scores, feature matrix,
a hash-based train/test split and the documented target formulas.

Statistics (means, population sds) are one-row aggregates passed as scalar
subqueries; label codes are distributed ranks of the distinct values, joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.config import ORDINAL_SCALES, SURVEY, SurveyColumns
from cohortlab.functions.exprs import is_test_row, normal, ordinal_code, present, split_hash, without_nan
from cohortlab.session import ensure_checkpoint_dir

#: Rows of a partition of a fit's input at most.
PART_ROWS = 250_000
MISSING_LABEL = "nan"  # how a missing nominal answer is spelled before label encoding


def ordinal_encode(df: DataFrame, scales: Mapping[str, Mapping[str, int]] = ORDINAL_SCALES, missing: int = 0) -> DataFrame:
    """Add ``<c>_ord`` for every configured scale column present; unknown/missing -> ``missing``."""
    cols = present(df, list(scales))
    return df.withColumns({f"{c}_ord": ordinal_code(c, scales[c], missing) for c in cols})


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, code)``: position of each value among the sorted distinct values of its column, from 0.

    The distinct (column, value) pairs - deduplicated map-side - are sorted once over all executors; a pair's
    number is its place within its partition plus the sizes of the partitions before it (one row per partition).
    The sorted table is checkpointed, so both uses see the same partitions.  No limit on the number of values.
    """
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias("value")) for c in columns])).alias("kv")
    ).select("kv.*").distinct()
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()  # partition number in the upper bits, place within it in the lower 33
    ranked = pairs.sort("feature", "value").select("feature", "value", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).checkpoint()
    sizes = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = ranked.join(offsets, "part").select("feature", "value", (F.col("before") + F.col("at")).alias("number"))
    first = numbered.groupBy("feature").agg(F.min("number").alias("first"))
    return numbered.join(first, "feature").select("feature", "value", (F.col("number") - F.col("first")).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Add ``<c>_enc`` (int) for each column; a missing value is the category ``'nan'``.

    ``codes`` (from ``label_codes``) fits once and encodes other rows; a value it does not know gets the next free code.
    Ordinary joins on the value: small code tables are broadcast by their size, large ones are shuffled.
    """
    cols = present(df, columns)
    if not cols:
        return df
    table = label_codes(df, cols) if codes is None else codes
    out = df
    for c in cols:
        own = table.where(F.col("feature") == c).select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"{c}_enc"))
        out = out.withColumn(f"__v_{c}", F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL))).join(own, f"__v_{c}", "left").drop(f"__v_{c}")
        if codes is not None:
            free = table.where(F.col("feature") == c).agg(F.coalesce(F.max("code") + 1, F.lit(0))).scalar()
            out = out.withColumn(f"{c}_enc", F.coalesce(f"{c}_enc", free))
    return out


def category_catalog(df: DataFrame, columns: Sequence[str], shown: int = 3) -> DataFrame:
    """Per column: number of categories and the first ``shown`` in sorted order (", "-joined, "..." if more).

    Distinct (column, value) pairs, then a ``row_number() <= shown`` window that
    Spark turns into a per-partition top-k before the shuffle (WindowGroupLimit).
    """
    pairs = (
        df.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias("value")) for c in columns])
            ).alias("kv")
        )
        .select("kv.*")
        .distinct()
    )
    n = pairs.groupBy("feature").agg(F.count(F.lit(1)).cast("long").alias("n_categories"))
    w = Window.partitionBy("feature").orderBy("value")
    first = (
        pairs.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= shown)
        .groupBy("feature")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]), ", ").alias("first"))
    )
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i + 1))])
    return n.join(first, "feature").select(
        F.element_at(order, F.col("feature")).alias("position"),
        "feature",
        "n_categories",
        F.concat(F.col("first"), F.when(F.col("n_categories") > shown, F.lit("...")).otherwise(F.lit(""))).alias("example_classes"),
    )


def moment_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column mean and population sd (what a z-score needs); NaN counts as missing."""
    df = without_nan(df, columns)
    return df.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]
    )


def standardize(df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """z = (x - mean) / population sd; zero variance gives 0, NULL stays NULL.

    ``stats`` (from ``moment_stats``) lets a test set be scaled with training statistics.  NaN is missing: NULL, and in no statistic.
    """
    df = without_nan(df, columns)
    st = (stats if stats is not None else moment_stats(df, columns)).select(F.struct(*columns).alias("s")).scalar()
    # statistics projected once as a column: one subquery in the plan, read by every z-score
    base = df.select(*[F.col(k) for k in keep], *[F.col(c) for c in columns if c not in keep], st.alias("__st"))
    out = [F.col(k) for k in keep]
    for c in columns:
        mean, sd = F.col("__st")[c]["mean"], F.col("__st")[c]["sd"]
        z = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - mean) / sd)
        out.append(F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(z).alias(c))
    return base.select(*out)


def scale_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample sd before scaling (2 places) and after (4 places, sd shows sqrt(n/(n-1)))."""
    df = without_nan(df, columns)
    z = standardize(df, columns)
    before = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    after = z.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    b_row = before.select(F.struct(*columns).alias("b"))
    both = b_row.select("b", after.select(F.struct(*columns).alias("x")).scalar().alias("a"))
    b, a = F.col("b"), F.col("a")
    cells = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(c).alias("feature"),
            (F.bround(b[c]["m"], 2) + F.lit(0.0)).alias("mean_before"),
            (F.bround(b[c]["s"], 2) + F.lit(0.0)).alias("std_before"),
            (F.bround(a[c]["m"], 4) + F.lit(0.0)).alias("mean_after"),
            (F.bround(a[c]["s"], 4) + F.lit(0.0)).alias("std_after"),
        )
        for i, c in enumerate(columns)
    ]
    return both.select(F.inline(F.array(*cells)))


def encoded_frame(df: DataFrame, c: SurveyColumns = SURVEY) -> DataFrame:
    """Survey + ``_ord`` + ``_enc`` columns (ordinal codes and label codes of the nominal columns)."""
    return label_encode(ordinal_encode(df), list(c.nominal))


def feature_columns(df: DataFrame, c: SurveyColumns = SURVEY) -> list[str]:
    return present(df, list(c.model_features))


def feature_matrix(df: DataFrame, c: SurveyColumns = SURVEY, keep: Sequence[str] = ()) -> DataFrame:
    """The model features in fixed order as doubles, missing (NULL, NaN) -> 0."""
    enc = encoded_frame(without_nan(df), c)
    feats = feature_columns(enc, c)
    return enc.select(*[F.col(k) for k in keep], *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats])


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)


def spread(df: DataFrame, partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """Input of an iterative fit, dealt evenly over the cores (one shuffle of the narrow fit input); with ``rows``, its number of rows, over as
    many partitions as keep one at ``PART_ROWS`` or less: a fit holds, writes and reads back whole partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(partitions or max(cores, -(-(rows or 0) // PART_ROWS)))


def fit_cached(estimator, data: DataFrame, rows: int | None = None, keep: bool = True):
    """Fit an iterative estimator on ``spread(data)`` cached for the fit only (released afterwards); without ``keep``, for one that
    reads its input once or keeps it itself, it is only spread."""
    if not keep:
        return estimator.fit(spread(data, rows=rows))
    d = spread(data, rows=rows).cache()
    try:
        return estimator.fit(d)
    finally:
        d.unpersist()


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` ('train' / 'test') from a hash of ``seed:key`` — stable under repartitioning and retries."""
    return df.withColumn("split", F.when(is_test_row(key, test_fraction, seed), F.lit("test")).otherwise(F.lit("train")))


def exact_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ceil(test_fraction * n) rows are 'test', those with the smallest hash of ``seed:key`` (ties: smallest key).

    The hash of the last test row is selected without sorting the table: rows are counted by the upper 16 bits of the hash, then, in the
    one bucket where the needed rank falls, by the lower 16 bits - two tables of at most 65,536 counts, whose running sums are one small task each.
    Only the rows that share the last hash (n / 2^32 of them where keys are distinct) are ordered by key.  All of it is part of the plan:
    nothing runs before the result is asked for.  Rows with the same key share a hash; they are told apart only as far as the key goes, so
    keys should be distinct.  A NULL key comes last.
    """
    h = F.coalesce(split_hash(key, seed), F.lit(1 << 32))
    wanted = F.ceil(F.lit(float(test_fraction)) * F.count(F.lit(1))).cast("long")

    def last_bucket(counts: DataFrame, place: str, needed: Column) -> DataFrame:
        """The bucket that holds the needed rank, and how many rows are needed of it."""
        below = F.sum("n").over(Window.orderBy(place)) - F.col("n")
        marked = counts.select(place, "n", below.alias("below"), needed.alias("needed"))
        hit = marked.where((F.col("below") < F.col("needed")) & (F.col("below") + F.col("n") >= F.col("needed")))
        return hit.agg(F.struct(F.max(place).alias("bucket"), F.max(F.col("needed") - F.col("below")).alias("needed")).alias("hit"))

    n = F.count(F.lit(1)).alias("n")
    keyed = df.select(h.alias("h"), F.col(key).alias("k"))
    upper = last_bucket(keyed.groupBy(F.shiftright("h", 16).alias("b")).agg(n), "b", keyed.agg(wanted).scalar()).scalar()
    low = keyed.withColumn("u", upper).where(F.shiftright("h", 16) == F.col("u.bucket"))
    lower = last_bucket(low.groupBy("h").agg(n, F.max("u.needed").alias("u")), "h", F.col("u")).scalar()
    tied = keyed.withColumn("l", lower).where(F.col("h") == F.col("l.bucket"))
    place = F.row_number().over(Window.orderBy(F.col("k").asc_nulls_last()))
    edge = tied.select("k", "l", place.alias("p")).where(F.col("p") <= F.col("l.needed"))
    edge = edge.agg(F.struct(F.max("l.bucket").alias("h"), F.max("k").alias("k")).alias("edge")).scalar()
    out = df.withColumn("__edge", edge)  # the selection is one value, projected once
    tie = F.col("__edge.k").isNull() | (F.col(key) <= F.col("__edge.k"))
    test = F.coalesce((h < F.col("__edge.h")) | ((h == F.col("__edge.h")) & tie), F.lit(False))
    return out.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("__edge")


def derive_targets(
    df: DataFrame,
    c: SurveyColumns = SURVEY,
    threshold: float = 3.2,
    weights: Mapping[str, float] | None = None,
    monthly_penalty: float = 0.1,
    fatigue_weight: float = 0.05,
    billing_discount: Mapping[str, float] | None = None,
    noise: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """The documented target formulas with explicit parameters:

    score = sum(w * ordinal code) over trust, difficulty, fatigue and tier; subscribe = score > threshold;
    churn = clip(1 - tier/3 * 0.4 + monthly_penalty [Monthly] + fatigue_weight * fatigue, 0, 1);
    mrr = wtp * subscribe * billing discount.

    ``noise`` adds normal noise of that standard deviation to the score (before the threshold) and of a tenth of it to churn (before
    clipping).  It is a function of seed and key, so a row's noise does not change with partitioning or retries.
    """
    w = weights or {
        "trust_concern_frequency_ord": 0.25,
        "difficulty_finding_tools_ord": 0.25,
        "subscription_fatigue_ord": 0.25,
        "preferred_subscription_tier_ord": 0.25,
    }
    disc = billing_discount or {"Monthly": 1.0, "Half-Yearly": 0.9, "Yearly": 0.8}
    enc = ordinal_encode(df)
    score: Column = F.lit(0.0)
    for col, wt in w.items():
        score = score + F.col(col).cast("double") * F.lit(wt)
    if noise:
        score = score + F.lit(noise) * normal(c.id, seed, 0)
    sub = F.when(score > F.lit(threshold), 1).otherwise(0)
    churn = (
        F.lit(1.0)
        - F.col("preferred_subscription_tier_ord").cast("double") / F.lit(3.0) * F.lit(0.4)
        + F.when(F.col("preferred_billing_cadence") == "Monthly", F.lit(monthly_penalty)).otherwise(F.lit(0.0))
        + F.lit(fatigue_weight) * F.col("subscription_fatigue_ord").cast("double")
    )
    if noise:
        churn = churn + F.lit(noise / 10) * normal(c.id, seed, 1)
    churn = F.least(F.greatest(churn, F.lit(0.0)), F.lit(1.0))
    factor = F.lit(None).cast("double")
    for k, v in reversed(list(disc.items())):
        factor = F.when(F.col("preferred_billing_cadence") == F.lit(k), F.lit(v)).otherwise(factor)
    mrr = F.coalesce(F.col(c.wtp), F.lit(0.0)) * sub * F.coalesce(factor, F.lit(1.0))
    return enc.select(
        c.id,
        score.alias("subscription_score"),
        sub.alias("will_subscribe_derived"),
        churn.alias("churn_risk_derived"),
        mrr.alias("estimated_mrr_derived"),
    )

"""Customer segments: multi-start K-Means, squared silhouette, personas, scatter bins and bisecting K-Means.

Scale notes
* Every fit reads a cached, assembled feature frame; K-Means / bisecting K-Means are
  Spark ML (distributed Lloyd iterations, k-means|| seeding).
* The silhouette is the squared-Euclidean one (Spark's ``ClusteringEvaluator``
  definition): per-cluster sums (k rows) are passed as a scalar subquery and each
  point computes its distance to every cluster from them — O(n k), no pairs.
  The Euclidean silhouette is in ``silhouette`` (a stated sample against all points), Ward in ``ward``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.config import PERSONA_NAMES, SURVEY, SurveyColumns
from cohortlab.functions.broadcast import broadcast_if_small
from cohortlab.functions.exprs import without_nan
from cohortlab.operators.encode import assemble, fit_cached, ordinal_encode, spread, standardize

#: Rows of all starts that run at a time, for each core.
CORE_ROWS = 4_000_000


def cluster_input(
    df: DataFrame, c: SurveyColumns = SURVEY, features: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Cluster features with missing (NULL, NaN) -> 0, then z-scored (population sd): ``(id, *keep, f1..fk)``.

    ``keep`` carries other columns through (no join back to the source later).
    """
    feats = list(features or c.cluster_features)
    enc = ordinal_encode(without_nan(df, feats))
    carried = [c.id, *[k for k in keep if k != c.id and k not in feats]]
    filled = enc.select(*carried, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats])
    return standardize(filled, feats, keep=carried), feats


def fit_kmeans(vectors: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
               features_col: str = "features", parallel: int = 4, feature_variance: float = 1.0, rows: int | None = None) -> KMeansModel:
    """Best of ``n_init`` K-Means runs (seeds seed..seed+n_init-1) by within-cluster sum of squares.

    ``tol`` is the usual relative criterion: stop when the summed squared centre shift is at
    most ``tol`` x mean feature variance (1 for z-scores).  Spark stops when every centre moves
    less than its ``tol`` (a distance), so each centre may move sqrt(tol x variance / k).

    The block solver holds the points of a start as dense blocks of numbers, not as an object each, and takes the same steps.

    The starts are independent Spark jobs submitted from ``parallel`` driver threads, so their
    (small, latency-bound) iterations overlap on the cluster; ties keep the lowest seed.  Each start holds blocks of
    all points, so fewer run at a time (at last one) where ``rows`` of them would not fit beside each other.
    """
    import math
    from concurrent.futures import ThreadPoolExecutor

    spark_tol = math.sqrt(tol * feature_variance / k)

    def one(i: int):
        km = KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=spark_tol, initMode="k-means||", featuresCol=features_col, solver="block")
        m = km.fit(vectors)
        return m.summary.trainingCost, i, m

    if rows:
        parallel = min(parallel, vectors.sparkSession.sparkContext.defaultParallelism * CORE_ROWS // rows)
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, n_init))) as pool:
        fits = list(pool.map(one, range(n_init)))
    return min(fits, key=lambda t: (t[0], t[1]))[2]


def silhouette_spark(assigned: DataFrame, label: str = "cluster", features_col: str = "features") -> float:
    """Spark's squared-Euclidean silhouette (``ClusteringEvaluator``)."""
    ev = ClusteringEvaluator(predictionCol=label, featuresCol=features_col, metricName="silhouette", distanceMeasure="squaredEuclidean")
    return ev.evaluate(assigned)


def _cluster_sums(pts: DataFrame, dims: int) -> DataFrame:
    return pts.groupBy("lab").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)]).alias("s"),
        F.sum(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)).alias("q"),
    )


def _silhouette_value(a: Column, b: Column, n_own: Column) -> Column:
    return (
        F.when(n_own <= 1, F.lit(0.0))
        .when(b.isNull(), F.lit(0.0))
        .when(a < b, F.lit(1.0) - a / b)
        .when(a > b, b / a - F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def silhouette_points(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per point squared-Euclidean silhouette ``s`` (0 for a point alone in its cluster).

    a = mean squared distance to the other points of its cluster = D(x, own) n/(n-1),
    b = min over other clusters of D(x, c), with D(x, c) = |x|^2 + Q_c/n_c - 2 x.S_c/n_c.

    The per-cluster sums (one row per cluster) reach the points as one array (a scalar subquery, evaluated once);
    distances, a and b are projected one after the other, each computed once per point.
    """
    pts = df.where(F.col(label).isNotNull()).select(F.col(label).alias("lab"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    sums = _cluster_sums(pts, len(features)).agg(F.collect_list(F.struct("lab", "n", "s", "q")).alias("cl")).scalar()
    pts = pts.withColumn("cl", sums).withColumn("norm", F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v))

    def dist(c: Column) -> Column:
        dot = F.aggregate(F.zip_with("x", c["s"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return F.struct(c["lab"].alias("lab"), c["n"].alias("n"), (F.col("norm") + c["q"] / c["n"] - F.lit(2.0) * dot / c["n"]).alias("d"))

    pts = pts.select("lab", F.transform("cl", dist).alias("ds"))
    pts = pts.select("lab", F.get(F.filter("ds", lambda c: c["lab"] == F.col("lab")), F.lit(0)).alias("own"), F.filter("ds", lambda c: c["lab"] != F.col("lab")).alias("others"))
    n_own = F.col("own")["n"]
    alone = F.when(n_own > 1, F.col("own")["d"] * n_own / (n_own - F.lit(1.0)))
    pts = pts.select("lab", n_own.alias("n_own"), alone.alias("a"), F.array_min(F.transform("others", lambda c: c["d"])).alias("b"))
    return pts.select("lab", _silhouette_value(F.col("a"), F.col("b"), F.col("n_own")).alias("s"))


def silhouette(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mean squared-Euclidean silhouette over all points: one row ``(silhouette, n)``."""
    p = silhouette_points(df, features, label)
    return p.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).cast("long").alias("n"))


def raw_profile(df: DataFrame, segment: str, c: SurveyColumns = SURVEY) -> DataFrame:
    """Unrounded mean spend, WTP and subscribe rate per segment."""
    return df.where(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.avg(c.spend).alias("spend"), F.avg(c.wtp).alias("wtp"), F.avg(c.subscribe).alias("sub")
    )


def name_personas(df: DataFrame, segment: str, spend: str, names: Sequence[str] = PERSONA_NAMES) -> DataFrame:
    """Rank segments by mean spend (desc, ties by segment) and give the i-th name; the last name repeats.

    The window runs over the segment profile (one row per segment).
    """
    prof = df.where(F.col(segment).isNotNull()).groupBy(segment).agg(F.avg(spend).alias("mean_spend"))
    w = Window.orderBy(F.desc("mean_spend"), F.asc(segment))
    arr = F.array(*[F.lit(n) for n in names])
    rn = F.row_number().over(w)
    return prof.select(segment, rn.alias("spend_rank"), F.element_at(arr, F.least(rn, F.lit(len(names)))).alias("persona"))


def with_persona(df: DataFrame, personas: DataFrame, segment: str) -> DataFrame:
    """``df`` with the persona of its segment (one row per segment; broadcast after a count of those rows)."""
    return df.join(broadcast_if_small(personas.select(segment, "persona")), segment, "left")


def persona_rates(df: DataFrame, persona: str, flag: str) -> DataFrame:
    return df.where(F.col(persona).isNotNull()).groupBy(persona).agg((F.avg(flag) * 100).alias("rate_pct"), F.count(F.lit(1)).alias("n"))


def scatter_bins(df: DataFrame, x: str, y: str, segment: str, bins: int = 20) -> DataFrame:
    """2-D histogram per segment (the data behind a scatter at scale): equal-width bins over each axis' range."""
    rng = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    r = F.col("__r")

    def b(col: str, lo: Column, hi: Column) -> Column:
        return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col(col) - lo) / (hi - lo) * bins), F.lit(bins - 1))).cast("int")

    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(segment).isNotNull()).select(
        segment, x, y, rng.select(F.struct("*").alias("r")).scalar().alias("__r")  # ranges projected once
    )
    return base.groupBy(segment, b(x, r["x0"], r["x1"]).alias("x_bin"), b(y, r["y0"], r["y1"]).alias("y_bin")).agg(
        F.count(F.lit(1)).cast("long").alias("n")
    )


# --------------------------------------------------------------------------- bisecting K-Means
def bisecting_segments(vectors: DataFrame, key: str, k: int = 4, seed: int = 42) -> DataFrame:
    """Bisecting K-Means: ``(key, cluster, features)``.

    Spark starts the two halves of a cluster at its centre plus and minus noise in proportion to the centre's norm; z-scores are centred on
    0, where both halves would start at one point and nothing would ever be split.  Distances do not change when all points
    move alike, so the fit sees every feature moved by 1.
    """
    moved = vectors.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda x: x + 1)))
    m = fit_cached(BisectingKMeans(k=k, seed=seed), moved.select("features"), moved.count())
    out = m.transform(moved).withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda x: x - 1)))
    return out.select(key, F.col("prediction").cast("int").alias("cluster"), "features")


def features_to_columns(df: DataFrame, features: Sequence[str], vec: str = "features") -> DataFrame:
    arr = vector_to_array(F.col(vec))
    return df.select("*", *[arr[i].alias(f) for i, f in enumerate(features)])

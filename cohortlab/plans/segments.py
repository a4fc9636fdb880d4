"""Segment queries (A6-A8, A11, C1-C9).

Oracled queries segment by ``user_type`` (a labelling both engines share);
K-Means, Ward and bisecting K-Means results are checked by row counts only.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.config import PERSONA_NAMES, SURVEY
from cohortlab.operators import aggregate as agg
from cohortlab.operators import segment as seg
from cohortlab.operators import ward
from cohortlab.operators.encode import assemble, spread
from cohortlab.operators.silhouette import euclidean_silhouette
from cohortlab.plans.encoding import ord_sql
from cohortlab.plans.registry import cached, register, survey, table_name, use_materialized_survey
from cohortlab.plans.survey_sql import with_survey
from cohortlab.session import materialize
from cohortlab.sources.survey import SURVEY_COLUMNS

C = SURVEY
FEATS = list(C.cluster_features)
K = 4


def _cluster_frame(spark, sf_dir):
    """The survey's columns (``raw__`` and their name where a feature bears it) and the z-scored cluster features, written once per session and state
    of the data: fits, labels and silhouettes read numbers, not the derivation of each number from the order tables."""

    def build():
        s = use_materialized_survey(spark, sf_dir)
        s = s.select(*s.columns, *[F.col(c).alias(f"raw__{c}") for c in s.columns if c in FEATS])
        return materialize(seg.cluster_input(s, keep=s.columns)[0], table_name(sf_dir, "cluster_frame"))

    return cached(spark, sf_dir, "cluster_frame", build)


def _z_cte() -> str:
    """``z``: respondent_id, user_type and the 7 cluster features filled with 0 and z-scored."""
    raw = []
    for f in FEATS:
        src = ord_sql(f[: -len("_ord")]) if f.endswith("_ord") else f
        raw.append(f"coalesce(CAST({src} AS DOUBLE), 0.0) AS {f}")
    zs = ", ".join(
        f"CASE WHEN (SELECT stddev_pop({f}) FROM r) = 0 THEN 0.0 ELSE ({f} - (SELECT avg({f}) FROM r)) / (SELECT stddev_pop({f}) FROM r) END AS {f}"
        for f in FEATS
    )
    return f"r AS (SELECT respondent_id, user_type, {', '.join(raw)} FROM survey), z AS (SELECT respondent_id, user_type, {zs} FROM r)"


def _silhouette_sql() -> str:
    sums = ", ".join(f"sum({f}) AS s_{f}" for f in FEATS)
    norm = " + ".join(f"{f} * {f}" for f in FEATS)
    dot = " + ".join(f"p.{f} * c.s_{f}" for f in FEATS)
    return with_survey(
        f"""
SELECT round(avg(s), 6) AS silhouette, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT respondent_id,
         CASE WHEN max(CASE WHEN own THEN n END) <= 1 THEN 0.0
              WHEN min(CASE WHEN NOT own THEN d END) IS NULL THEN 0.0
              ELSE (min(CASE WHEN NOT own THEN d END) - max(CASE WHEN own THEN d * n / (n - 1) END))
                   / greatest(min(CASE WHEN NOT own THEN d END), max(CASE WHEN own THEN d * n / (n - 1) END)) END AS s
  FROM (
    SELECT p.respondent_id, p.user_type = c.user_type AS own, c.n,
           p.norm + c.q / c.n - 2.0 * ({dot}) / c.n AS d
    FROM (SELECT *, {norm} AS norm FROM z WHERE user_type IS NOT NULL) p
    CROSS JOIN cs c
  ) GROUP BY respondent_id
)""",
        _z_cte(),
        f"cs AS (SELECT user_type, CAST(count(*) AS DOUBLE) AS n, {sums}, sum({norm}) AS q FROM z WHERE user_type IS NOT NULL GROUP BY user_type)",
    )


@register("silhouette_by_user_type", _silhouette_sql())
def silhouette_by_user_type(spark, sf_dir):
    z, feats = seg.cluster_input(survey(spark, sf_dir), keep=[C.user_type])
    s = seg.silhouette(z, feats, C.user_type)
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n")


SILHOUETTE_SAMPLE = 1_000


def _euclidean_sql(size: int) -> str:
    square = " + ".join(f"(p.{f} - q.{f}) * (p.{f} - q.{f})" for f in FEATS)
    return with_survey(
        """
SELECT round(sum(N / t * m), 6) AS silhouette, round(sqrt(sum((N / t) * (N / t) * (1 - c / N) * v / c)), 6) AS std_error,
       CAST(sum(c) AS BIGINT) AS n_sample, CAST(max(t) AS BIGINT) AS n
FROM (SELECT user_type, any_value(N) AS N, any_value(t) AS t, count(*) AS c, avg(s) AS m, coalesce(var_samp(s), 0.0) AS v FROM s GROUP BY user_type)""",
        _z_cte(),
        "w AS (SELECT * FROM z WHERE user_type IS NOT NULL)",
        f"""rk AS (SELECT *, count(*) OVER (PARTITION BY user_type) AS N, count(*) OVER () AS t,
  row_number() OVER (PARTITION BY user_type ORDER BY CAST('0x' || substr(md5('42:' || CAST(respondent_id AS VARCHAR)), 1, 8) AS BIGINT), respondent_id) AS place FROM w)""",
        f"sam AS (SELECT * FROM rk WHERE place <= greatest(ceil({size} * N / t), 2))",
        f"""d AS (SELECT p.respondent_id, p.user_type, any_value(p.N) AS N, any_value(p.t) AS t, q.user_type AS other, sum(sqrt({square})) AS d, count(*) AS m
  FROM sam p CROSS JOIN w q GROUP BY 1, 2, q.user_type)""",
        """ab AS (SELECT respondent_id, user_type, any_value(N) AS N, any_value(t) AS t, max(CASE WHEN user_type = other AND m > 1 THEN d / (m - 1) END) AS a,
  min(CASE WHEN user_type <> other THEN d / m END) AS b FROM d GROUP BY 1, 2)""",
        "s AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)",
    )


@register("silhouette_euclidean", _euclidean_sql(SILHOUETTE_SAMPLE))
def silhouette_euclidean(spark, sf_dir):
    """Euclidean silhouette of the user types: a stratified sample of points, each against all points, and the standard error."""
    s = euclidean_silhouette(_cluster_frame(spark, sf_dir), C.id, FEATS, C.user_type, SILHOUETTE_SAMPLE)
    return s.select(*[F.round(c, 6).alias(c) for c in ("silhouette", "std_error")], "n_sample", "n")


_PERSONA_CTE = (
    "pn AS (SELECT user_type, CAST(row_number() OVER (ORDER BY avg(monthly_spend_on_ai_usd) DESC, user_type ASC) AS INTEGER) AS spend_rank "
    "FROM survey WHERE user_type IS NOT NULL GROUP BY user_type), "
    "pp AS (SELECT user_type, spend_rank, CASE least(spend_rank, 4) "
    + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(PERSONA_NAMES))
    + " END AS persona FROM pn)"
)


@register("persona_names", with_survey("SELECT user_type, spend_rank, persona FROM pp", _PERSONA_CTE))
def persona_names(spark, sf_dir):
    return seg.name_personas(survey(spark, sf_dir), C.user_type, C.spend)


@register(
    "persona_rates",
    with_survey(
        "SELECT persona, round(avg(will_subscribe) * 100, 6) AS rate_pct, CAST(count(*) AS BIGINT) AS n FROM survey JOIN pp USING (user_type) GROUP BY persona",
        _PERSONA_CTE,
    ),
)
def persona_rates(spark, sf_dir):
    s = survey(spark, sf_dir)
    p = seg.with_persona(s, seg.name_personas(s, C.user_type, C.spend), C.user_type)
    r = seg.persona_rates(p, "persona", C.subscribe)
    return r.select("persona", F.round("rate_pct", 6).alias("rate_pct"), "n")


def _bin_sql(col: str, lo: str, hi: str, bins: int = 20) -> str:
    return f"CAST(CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({col} - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1}) END AS INTEGER)"


@register(
    "scatter_bins",
    with_survey(
        f"""
SELECT user_type, {_bin_sql('monthly_spend_on_ai_usd', 'x0', 'x1')} AS x_bin, {_bin_sql('wtp_monthly_usd', 'y0', 'y1')} AS y_bin, CAST(count(*) AS BIGINT) AS n
FROM survey, (SELECT min(monthly_spend_on_ai_usd) x0, max(monthly_spend_on_ai_usd) x1, min(wtp_monthly_usd) y0, max(wtp_monthly_usd) y1 FROM survey)
WHERE monthly_spend_on_ai_usd IS NOT NULL AND wtp_monthly_usd IS NOT NULL AND user_type IS NOT NULL
GROUP BY 1, 2, 3"""
    ),
)
def scatter_bins(spark, sf_dir):
    return seg.scatter_bins(survey(spark, sf_dir), C.spend, C.wtp, C.user_type)


# ----------------------------------------------------------------------------- fitted segmentations (rows-only)
def _kmeans(spark, sf_dir, k=K):
    """Labelled survey (all columns + cluster + features), assignments and model.

    The fit reads only the cached feature vectors and is shared by the queries of one
    session; the labels are attached by ``transform`` on a frame that carries every
    survey column, so no query joins the assignments back to the survey.
    """
    z = _cluster_frame(spark, sf_dir)
    vec = assemble(z, FEATS)

    def fit():
        rows = z.count()
        fit_input = spread(vec.select(C.id, "features"), rows=rows).cache()
        try:
            return seg.fit_kmeans(fit_input, k, rows=rows)
        finally:
            fit_input.unpersist()

    model = cached(spark, sf_dir, f"kmeans_{k}", fit)
    orig = [F.col(f"raw__{c}").alias(c) if f"raw__{c}" in z.columns else F.col(c) for c in SURVEY_COLUMNS]
    labelled = model.transform(vec).select(*orig, F.col("prediction").cast("int").alias("cluster"), "features")
    return labelled, labelled.select(C.id, "cluster", "features"), model


@register("kmeans_assignments")
def kmeans_assignments(spark, sf_dir):
    _, a, _ = _kmeans(spark, sf_dir)
    return a.select(C.id, "cluster")


@register("kmeans_profile")
def kmeans_profile(spark, sf_dir):
    s, _, _ = _kmeans(spark, sf_dir)
    return agg.segment_profile(s, "cluster")


@register("kmeans_personas")
def kmeans_personas(spark, sf_dir):
    s, _, _ = _kmeans(spark, sf_dir)
    return seg.name_personas(s, "cluster", C.spend)


@register("kmeans_silhouette")
def kmeans_silhouette(spark, sf_dir):
    _, a, _ = _kmeans(spark, sf_dir)
    pts = seg.features_to_columns(a, FEATS)
    return seg.silhouette(pts, FEATS, "cluster")


@register("kmeans_silhouette_euclidean")
def kmeans_silhouette_euclidean(spark, sf_dir):
    _, a, _ = _kmeans(spark, sf_dir)
    return euclidean_silhouette(seg.features_to_columns(a, FEATS), C.id, FEATS, "cluster", SILHOUETTE_SAMPLE)


@register("kmeans_industry_crosstab")
def kmeans_industry_crosstab(spark, sf_dir):
    s, _, _ = _kmeans(spark, sf_dir)
    return agg.crosstab_long(s, "cluster", C.industry)


def _vectors(spark, sf_dir):
    return assemble(_cluster_frame(spark, sf_dir), FEATS).select(C.id, "features")


@register("ward_assignments")
def ward_assignments(spark, sf_dir):
    return ward.ward_segments(_vectors(spark, sf_dir), C.id, k=K).select(C.id, "cluster")


@register("ward_sizes", with_survey("SELECT CAST(4 AS BIGINT) AS clusters, CAST(count(*) AS BIGINT) AS n, true AS radius_known FROM survey"))
def ward_sizes(spark, sf_dir):
    """Ward's clusters hold every respondent, and each knows how far its feature is from its points."""
    w = ward.ward_segments(_vectors(spark, sf_dir), C.id, k=K)
    return w.agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("n"), F.min(F.col("leaf_radius") >= 0).alias("radius_known"))


@register("bisecting_assignments")
def bisecting_assignments(spark, sf_dir):
    return seg.bisecting_segments(_vectors(spark, sf_dir), C.id, k=K).select(C.id, "cluster")


@register("clustering_comparison")
def clustering_comparison(spark, sf_dir):
    """Euclidean silhouette of K-Means and Ward (k = 4) on the same sample of points, with standard errors; tie -> K-Means."""
    _, km, _ = _kmeans(spark, sf_dir)
    tree = ward.ward_segments(_vectors(spark, sf_dir), C.id, k=K)
    parts = []
    for name, a in (("K-Means", km), ("Agglomerative (Ward)", tree)):
        sil = euclidean_silhouette(seg.features_to_columns(a, FEATS), C.id, FEATS, "cluster", SILHOUETTE_SAMPLE)
        parts.append(sil.select(F.lit(name).alias("method"), "*"))
    both = parts[0].unionByName(parts[1])
    best = F.max_by("method", F.struct("silhouette", F.when(F.col("method") == "K-Means", 1).otherwise(0))).over(Window.partitionBy(F.lit(1)))  # two rows
    return both.select("method", *[F.round(c, 4).alias(c) for c in ("silhouette", "std_error")], "n_sample", "n", best.alias("winner"))


@register("kmeans_persona_rates")
def kmeans_persona_rates(spark, sf_dir):
    """Subscribe rate of the K-Means personas."""
    s, _, _ = _kmeans(spark, sf_dir)
    return seg.persona_rates(seg.with_persona(s, seg.name_personas(s, "cluster", C.spend), "cluster"), "persona", C.subscribe)


@register("kmeans_scatter_bins")
def kmeans_scatter_bins(spark, sf_dir):
    s, _, _ = _kmeans(spark, sf_dir)
    return seg.scatter_bins(s, C.spend, C.wtp, "cluster")


@register("ward_scatter_bins")
def ward_scatter_bins(spark, sf_dir):
    raw = [F.col(f"raw__{c}" if c in FEATS else c).alias(name) for c, name in ((C.spend, "raw_x"), (C.wtp, "raw_y"))]
    w = ward.ward_segments(assemble(_cluster_frame(spark, sf_dir), FEATS).select(C.id, "features", *raw), C.id, k=K, keep=["raw_x", "raw_y"])
    return seg.scatter_bins(w, "raw_x", "raw_y", "cluster")


@register(
    "raw_profile",
    with_survey(
        "SELECT user_type, round(avg(monthly_spend_on_ai_usd), 6) AS spend, round(avg(wtp_monthly_usd), 6) AS wtp, "
        "round(avg(will_subscribe), 6) AS sub FROM survey WHERE user_type IS NOT NULL GROUP BY user_type"
    ),
)
def raw_profile(spark, sf_dir):
    """Unrounded means behind persona naming (spend, WTP, subscribe) per segment."""
    p = seg.raw_profile(survey(spark, sf_dir), C.user_type)
    return p.select(C.user_type, *[F.round(c, 6).alias(c) for c in ("spend", "wtp", "sub")])


@register("kmeans_raw_profile")
def kmeans_raw_profile(spark, sf_dir):
    s, _, _ = _kmeans(spark, sf_dir)
    return seg.raw_profile(s, "cluster")


@register("kmeans_silhouette_evaluator")
def kmeans_silhouette_evaluator(spark, sf_dir):
    """Spark's ClusteringEvaluator (squared Euclidean) on the K-Means labels, next to our per-point version."""
    _, a, _ = _kmeans(spark, sf_dir)
    ours = seg.silhouette(seg.features_to_columns(a, FEATS), FEATS, "cluster")
    return ours.select(F.lit(seg.silhouette_spark(a, "cluster")).alias("evaluator"), F.col("silhouette").alias("per_point_mean"), "n")


@register("kmeans_cluster_values")
def kmeans_cluster_values(spark, sf_dir):
    """Distinct cluster ids (the facet values of the segment charts)."""
    _, a, _ = _kmeans(spark, sf_dir)
    return a.select("cluster").distinct()

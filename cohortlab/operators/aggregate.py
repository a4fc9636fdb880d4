"""Grouped answers of the overview and explorer: KPIs, rates, ordered counts, describe, crosstab.

Every operator here is one hash aggregation (partial + final, so a hot group is
combined map-side) or a single-row aggregation followed by ``unpivot``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.config import SURVEY, TOOL_LABELS, SurveyColumns
from cohortlab.functions.exprs import col_of, without_nan
from cohortlab.functions.quantiles import quantile_wide


def kpis(df: DataFrame, c: SurveyColumns = SURVEY) -> DataFrame:
    """Headline row: respondents, subscribe rate, mean WTP, mean tools used, mean MRR."""
    df = without_nan(df)
    return df.agg(
        F.count(F.lit(1)).alias("n_respondents"),
        F.avg(c.subscribe).alias("subscribe_rate"),
        F.avg(c.wtp).alias("avg_wtp"),
        F.avg(c.tools_count).alias("avg_tools_used"),
        F.avg(c.mrr).alias("avg_mrr"),
    )


def rate_by(df: DataFrame, key: str, flag: str, name: str = "rate_pct") -> DataFrame:
    """Mean of a 0/1 flag x 100 per group, ascending; NULL group keys are dropped."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg((F.avg(flag) * 100).alias(name), F.count(F.lit(1)).alias("n"))
        .orderBy(name, key)
    )


def ordered_counts(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts of ``column`` in a fixed category order; an absent category gives NULL.

    One pass: a conditional count per category, then ``unpivot`` to rows.
    """
    row = df.agg(*[F.count_if(F.col(column) == F.lit(v)).alias(f"c{i}") for i, v in enumerate(order)])
    cells = [F.struct(F.lit(i + 1).alias("position"), F.lit(v).alias("category"), F.nullif(F.col(f"c{i}"), F.lit(0)).alias("n"))
             for i, v in enumerate(order)]
    return row.select(F.inline(F.array(*cells))).select("position", "category", F.col("n").cast("long").alias("n"))


def flag_rates(df: DataFrame, labels: Mapping[str, str] = TOOL_LABELS) -> DataFrame:
    """Share (x100) of rows with each flag set, with its display label, ascending."""
    row = df.agg(*[(F.avg(f) * 100).alias(f"r{i}") for i, f in enumerate(labels)])
    cells = [F.struct(F.lit(f).alias("flag"), F.lit(lab).alias("label"), F.col(f"r{i}").alias("rate_pct"))
             for i, (f, lab) in enumerate(labels.items())]
    return row.select(F.inline(F.array(*cells))).orderBy("rate_pct", "flag")


def describe(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """count, mean, sample sd, min, 25/50/75 % (exact, interpolated), max per column, rounded; NaN is missing."""
    df = without_nan(df, columns)
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(f"m{i}")
            for i, c in enumerate(columns)
        ]
    )
    moments = moments.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}.*")) for i, c in enumerate(columns)]))
    )
    q = quantile_wide(df, list(columns), {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    r = lambda x: F.bround(F.col(x), digits)
    return moments.join(F.broadcast(q), "column").select(
        F.col("column").alias("feature"),
        F.col("count").cast("long").alias("count"),
        r("mean").alias("mean"),
        r("std").alias("std"),
        r("min").alias("min"),
        r("p25").alias("p25"),
        r("p50").alias("p50"),
        r("p75").alias("p75"),
        r("max").alias("max"),
    )


def segment_profile(df: DataFrame, segment: str, c: SurveyColumns = SURVEY) -> DataFrame:
    """Size and rounded means per segment; subscribe rate also as the dashboard's percent text."""
    sub2 = F.bround(F.avg(c.subscribe), 2)
    return (
        without_nan(df).where(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(
            F.count(c.id).alias("size"),
            F.bround(F.avg(c.spend), 2).alias("avg_monthly_spend"),
            F.bround(F.avg(c.wtp), 2).alias("avg_wtp"),
            F.bround(F.avg(c.tools_count), 2).alias("avg_tools_used"),
            sub2.alias("subscribe_rate"),
            F.bround(F.avg(c.subscribe) * 100, 1).alias("subscribe_rate_pct"),
            F.concat(F.bround(sub2 * 100, 1).cast("string"), F.lit("%")).alias("subscribe_rate_label"),
            F.bround(F.avg(c.mrr), 2).alias("avg_mrr"),
        )
    )


def crosstab_long(df: DataFrame, rows: str, cols: str, zeros: bool = True) -> DataFrame:
    """Counts of ``rows`` x ``cols`` in long form; ``zeros`` adds the absent pairs.

    The counts are one hash aggregate, whatever the numbers of values.  Zero cells are part of the result
    by definition: the two sides' distinct values, joined, and joined to the counts; nothing of it passes through the driver.
    """
    base = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    counts = base.groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n"))
    if not zeros:
        return counts
    one = F.lit(1).alias("__one")
    grid = counts.select(rows, one).distinct().join(counts.select(cols, one).distinct(), "__one").drop("__one")
    return grid.join(counts, [rows, cols], "left").select(rows, cols, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ordered_group_stats(df: DataFrame, key: str, value: str | Column, order: Sequence[str], digits: int = 2) -> DataFrame:
    """mean, sum and count of ``value`` per key in a fixed order; absent keys give NULLs (one pass)."""
    v = col_of(value)
    aggs = []
    for i, k in enumerate(order):
        hit = F.when(F.col(key) == F.lit(k), v)
        aggs += [F.avg(hit).alias(f"a{i}"), F.sum(hit).alias(f"s{i}"), F.count(hit).alias(f"n{i}")]
    row = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(k).alias(key),
            F.bround(F.col(f"a{i}"), digits).alias("avg_value"),
            F.bround(F.col(f"s{i}"), digits).alias("total_value"),
            F.nullif(F.col(f"n{i}"), F.lit(0)).cast("long").alias("n"),
        )
        for i, k in enumerate(order)
    ]
    return row.select(F.inline(F.array(*cells)))


def facet_filter(df: DataFrame, facets: Mapping[str, Sequence[str]]) -> DataFrame:
    """``isin`` per facet, AND between facets; an empty list means no filter (pushes into Parquet)."""
    out = df
    for col, vals in facets.items():
        if vals:
            out = out.where(F.col(col).isin(list(vals)))
    return out


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each facet column (NULL included), long form ``(facet, value)``."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("kv")
    ).select("kv.facet", "kv.value")
    return long.distinct()


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))

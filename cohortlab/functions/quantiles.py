"""Exact quantiles (linear interpolation, the ``quantile_cont`` definition) by distributed selection.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a whole-table quantile ends in one task holding the
column.  Here only ranks are needed — for probability q over n values, the
values at ranks floor((n-1)q) and ceil((n-1)q) — and they are found by range
refinement, with every task's memory bounded:

1. A sketch job per open *window* (a value range of one column, with the number
   of values below it): count and HyperLogLog distinct count (bounded sketches,
   partial + final aggregation); approximate cut points (``percentile_approx``)
   only for windows too large to rank directly.
2. A window with at most ``max_exact`` distinct values is finished exactly:
   ``groupBy(window, value).count()`` (map-side combine: a value held by a third
   of the rows is one row), a running count over a window partitioned by the
   range gives every value's rank, and only the rows holding a needed rank reach
   the driver.
3. A larger window is split at its cut points (literals — a recomputed task
   buckets identically), and a cut value v is a bucket of its own, ``[v, next double after v)``.  So a value that
   holds most rows is found without ranking anything, and the next round cuts the rest *without* it.
   ``groupBy(window, bucket).count()`` (at most #windows x 2 ``buckets`` rows) tells which bucket holds each
   needed rank, and that bucket becomes the next window.  Every round splits every window, and the distinct values of a
   window shrink about ``buckets``-fold per round, so even 10^12 of them need two or three rounds of scans.

No task ranks more than ``max_exact`` distinct values (a sketch with 2 % error decides), whatever the distribution.
NaN counts as missing, like NULL.

The result is small (#columns x #probabilities rows) and returned as a literal
frame, like ``DataFrame.approxQuantile``; later plans never re-run the ranking.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

@dataclass
class _Win:
    column: str
    lo: float | None  # inclusive lower bound (None: unbounded)
    hi: float | None  # exclusive upper bound (None: unbounded)
    offset: int  # number of values of the column below ``lo``
    ranks: set[int] = field(default_factory=set)

    def single(self) -> bool:
        """Whether the window holds one double only."""
        return self.lo is not None and self.hi is not None and self.hi <= math.nextafter(self.lo, math.inf)

    def cond(self) -> Column:
        c = F.col("column") == F.lit(self.column)
        if self.lo is not None:
            c = c & (F.col("value") >= F.lit(self.lo))
        if self.hi is not None:
            c = c & (F.col("value") < F.lit(self.hi))
        return c


def _bucket_expr(value: Column, cuts: list[float]) -> Column:
    """Number of cut points <= value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value >= F.lit(cuts[mid - 1]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    return tree(0, len(cuts))


def _long_values(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    exprs = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    wide = df.select(*[e.cast("double").alias(name) for name, e in exprs.items()])
    long = wide.unpivot([], list(exprs), "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _tag(long: DataFrame, wins: list[_Win]) -> DataFrame:
    """Rows inside one of the windows, with the window's index."""
    wid = F.lit(None).cast("int")
    for i in range(len(wins) - 1, -1, -1):
        wid = F.when(wins[i].cond(), F.lit(i)).otherwise(wid)
    return long.select(wid.alias("wid"), "value").where(F.col("wid").isNotNull())


def _sketch(long: DataFrame, wins: list[_Win]) -> dict:
    """Count and HyperLogLog distinct count per window (cheap, bounded)."""
    rows = _tag(long, wins).groupBy("wid").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("value", 0.02).alias("nd")).collect()
    return {r["wid"]: r for r in rows}


def _cut_points(long: DataFrame, wins: list[_Win], fractions: list[float], accuracy: int) -> list[list[float]]:
    """Approximate cut points strictly inside each window (only for windows too large to rank)."""
    rows = {r["wid"]: r["cuts"] for r in _tag(long, wins).groupBy("wid").agg(F.percentile_approx("value", fractions, accuracy).alias("cuts")).collect()}
    out = []
    for i, w in enumerate(wins):
        cuts = {float(x) for x in rows.get(i) or []}
        cuts |= {math.nextafter(x, math.inf) for x in cuts}
        out.append(sorted(x for x in cuts if (w.lo is None or x > w.lo) and (w.hi is None or x < w.hi)))
    return out


def _exact(long: DataFrame, wins: list[_Win]) -> dict[tuple[str, int], float]:
    """Values at the needed ranks of small windows (window partitions bounded by ``max_exact``)."""
    counts = _tag(long, wins).groupBy("wid", "value").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("wid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    offs = F.create_map(*[x for i, win in enumerate(wins) for x in (F.lit(i), F.lit(win.offset))])
    ranked = counts.withColumn("run", F.sum("cnt").over(w)).select(
        "wid",
        "value",
        (offs[F.col("wid")] + F.col("run") - F.col("cnt")).alias("r_lo"),  # ranks [r_lo, r_hi) hold this value
        (offs[F.col("wid")] + F.col("run")).alias("r_hi"),
    )
    need = F.create_map(*[x for i, win in enumerate(wins) for x in (F.lit(i), F.array(*[F.lit(r) for r in sorted(win.ranks)]))])
    hits = ranked.select(
        "wid", "value", F.explode(F.filter(need[F.col("wid")], lambda r: (r >= F.col("r_lo")) & (r < F.col("r_hi")))).alias("rank")
    )
    return {(wins[r["wid"]].column, int(r["rank"])): r["value"] for r in hits.collect()}


def _refine(long: DataFrame, wins: list[_Win], cuts: list[list[float]]) -> list[_Win]:
    """Split windows at their cut points; the bucket holding each needed rank becomes a window."""
    bucket = F.lit(0)
    for i, cs in enumerate(cuts):
        bucket = F.when(F.col("wid") == F.lit(i), _bucket_expr(F.col("value"), cs)).otherwise(bucket)
    rows = _tag(long, wins).groupBy("wid", bucket.alias("b")).agg(F.count(F.lit(1)).alias("cnt")).collect()
    per: dict[int, dict[int, int]] = {}
    for r in rows:
        per.setdefault(r["wid"], {})[r["b"]] = r["cnt"]
    nxt: dict[tuple, _Win] = {}
    for i, win in enumerate(wins):
        bounds = [win.lo, *cuts[i], win.hi]
        below = win.offset
        for b in range(len(cuts[i]) + 1):
            cnt = per.get(i, {}).get(b, 0)
            inside = {r for r in win.ranks if below <= r < below + cnt}
            if inside:
                nw = nxt.setdefault((win.column, bounds[b], bounds[b + 1]), _Win(win.column, bounds[b], bounds[b + 1], below))
                nw.ranks |= inside
            below += cnt
    return list(nxt.values())


def quantile_neighbours(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Sequence[float],
    buckets: int = 256,
    max_exact: int = 2_000_000,
) -> list[dict]:
    """What a quantile is interpolated from: for each column and probability ``column, q, n``, the values at the ranks around (n - 1) q
    (``lower``, ``upper``) and the ``share`` of the way between them; None where there are no values.

    ``max_exact`` bounds the distinct values one task ranks; ``buckets`` is the split factor of a refinement round.
    """
    long = _long_values(df, columns)
    names = list(columns) if not isinstance(columns, Mapping) else list(columns.keys())
    fractions = [i / buckets for i in range(1, buckets)]
    accuracy = max(10_000, 8 * buckets)

    wins = [_Win(c, None, None, 0) for c in names]
    sk = _sketch(long, wins)
    totals = {w.column: (sk[i]["n"] if i in sk else 0) for i, w in enumerate(wins)}
    for w in wins:
        n = totals[w.column]
        for q in probs if n else ():
            h = (n - 1) * float(q)
            w.ranks |= {math.floor(h), math.ceil(h)}
    open_ = [(w, sk[i]) for i, w in enumerate(wins) if w.ranks]

    found: dict[tuple[str, int], float] = {}
    while open_:
        for w, _ in open_:
            if w.single():
                found.update({(w.column, r): w.lo + 0.0 for r in w.ranks})
        small = [w for w, s in open_ if not w.single() and s["nd"] <= max_exact]
        large = [w for w, s in open_ if not w.single() and s["nd"] > max_exact]
        if small:
            found.update(_exact(long, small))
        if not large:
            break
        nxt = _refine(long, large, _cut_points(long, large, fractions, accuracy))
        sk = _sketch(long, nxt)
        open_ = [(w, sk[i]) for i, w in enumerate(nxt)]

    rows = []
    for c in names:
        n = totals.get(c, 0)
        for q in probs:
            h = (n - 1) * float(q) if n else 0.0
            lower, upper = (found[c, math.floor(h)], found[c, math.ceil(h)]) if n else (None, None)
            rows.append({"column": c, "q": float(q), "n": n, "lower": lower, "upper": upper, "share": h - math.floor(h)})
    return rows


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Sequence[float],
    buckets: int = 256,
    max_exact: int = 2_000_000,
) -> DataFrame:
    """Exact ``quantile_cont`` of each column for each probability.

    Returns one row per (column, q): ``column string, q double, value double, n long``.
    NULLs are ignored; a column without values gives ``value = NULL``.
    """
    rows = []
    for r in quantile_neighbours(df, columns, probs, buckets, max_exact):
        lo, hi, share = r["lower"], r["upper"], r["share"]
        value = None if lo is None else lo if share == 0 else lo + (hi - lo) * share
        rows.append((r["column"], r["q"], value, r["n"]))
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double, n long")


def quantile_wide(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Mapping[str, float],
    buckets: int = 256,
    max_exact: int = 2_000_000,
) -> DataFrame:
    """``exact_quantiles`` pivoted to one row per column with one field per named probability."""
    long = exact_quantiles(df, columns, list(probs.values()), buckets, max_exact)
    aggs = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(name) for name, q in probs.items()]
    return long.groupBy("column").agg(*aggs, F.max("n").alias("n"))

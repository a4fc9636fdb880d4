"""Data-quality profile and repairs: missing values, column census, duplicates, business rules,
IQR outliers, winsorizing, box statistics, imputation and an audit with real counts.

Per-column statistics (fences, medians, modes) are computed once into a small
map (at most one entry per column) and handed to the row-level expressions as a
*scalar subquery*: evaluated once, no join against the big table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.config import (
    ACTION_IMPUTE,
    ACTION_NONE,
    AUDIT_STEPS,
    CHECK_CHURN_RANGE,
    CHECK_FLAGS,
    CHECK_FREE_WTP,
    CHECK_NEG_SPEND,
    CHECK_NONSUB_MRR,
    OUTLIER_CAP,
    OUTLIER_RETAIN,
    STATUS_CLEAN,
    STATUS_FOUND,
    SURVEY,
    SurveyColumns,
)
from cohortlab.functions.exprs import not_binary, without_nan
from cohortlab.functions.quantiles import quantile_neighbours, quantile_wide

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _cells(pairs: list[Column]) -> Column:
    return F.inline(F.array(*pairs))


# --------------------------------------------------------------------------- missing values
def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or not a number in a floating-point column."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def missing_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """Per column: missing count, percent of rows (rounded; NULL for an empty table), suggested action — one scan."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    cells = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("feature"), F.col(f"m{i}").alias("missing_count"), F.col("__n").alias("n"))
        for i, c in enumerate(cols)
    ]
    long = row.select(_cells(cells))
    return long.select(
        "position",
        "feature",
        F.col("missing_count").cast("long").alias("missing_count"),
        F.bround(F.try_divide("missing_count", "n") * 100, digits).alias("missing_pct"),
        F.when(F.col("missing_count") == 0, F.lit(ACTION_NONE)).otherwise(F.lit(ACTION_IMPUTE)).alias("action"),
    )


def missing_total(df: DataFrame) -> DataFrame:
    total = None
    for c in df.columns:
        e = F.count_if(is_missing(df, c))
        total = e if total is None else total + e
    return df.agg(total.cast("long").alias("total_missing"))


# --------------------------------------------------------------------------- column census
def dtype_display(dt: T.DataType) -> tuple[str, bool]:
    if isinstance(dt, T.StringType):
        return "Categorical (string)", True
    if isinstance(dt, (T.IntegerType, T.LongType)):
        return "Integer", True
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "Float", True
    return dt.simpleString(), False


def _as_text(f: T.StructField) -> Column:
    """Value as text for distinct counting; -0.0 folded into 0.0 as Spark's grouping does."""
    c = F.col(f.name)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    return c.cast("string")


def column_profile(df: DataFrame, key: str, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Per column: display type, distinct non-NULL count, sample (value of the smallest key), status.

    Exact distinct counts come from one unpivoted ``(feature, value)`` frame:
    ``groupBy(feature, value)`` (deduplicated map-side, so a hot value costs one
    row per task) then ``count`` per feature — one shuffle for all columns instead
    of one expanded copy of every row per column.  ``exact=False`` uses
    HyperLogLog++ sketches (no shuffle of values at all).
    """
    df = without_nan(df)
    fields = df.schema.fields
    samples = df.agg(*[F.min_by(F.col(f.name).cast("string"), F.col(key)).alias(f"s{i}") for i, f in enumerate(fields)])
    if exact:
        long = df.select(
            F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _as_text(f).alias("v")) for i, f in enumerate(fields)])).alias("kv")
        ).select("kv.i", "kv.v").where(F.col("v").isNotNull())
        nd = long.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("nd"))
        counts = nd.agg(F.map_from_entries(F.collect_list(F.struct("i", "nd"))).alias("m")).scalar()
        distinct = lambda i, f: F.coalesce(F.col("__nd")[F.lit(i)], F.lit(0)).cast("long")
        row = samples.select("*", counts.alias("__nd"))  # one subquery in the plan
    else:
        row = samples.crossJoin(df.agg(*[F.approx_count_distinct(f.name, rsd).alias(f"d{i}") for i, f in enumerate(fields)]))
        distinct = lambda i, f: F.col(f"d{i}").cast("long")
    cells = []
    for i, f in enumerate(fields):
        disp, ok = dtype_display(f.dataType)
        cells.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f.name).alias("feature"),
                F.lit(disp).alias("dtype"),
                distinct(i, f).alias("unique_values"),
                F.col(f"s{i}").alias("sample"),
                F.lit("Correct" if ok else "Review").alias("status"),
            )
        )
    return row.select(_cells(cells))


def type_census(df: DataFrame) -> DataFrame:
    """Rows, and numbers of numeric, text and other columns (from the schema)."""
    kinds = ["numeric" if isinstance(f.dataType, NUMERIC_TYPES) else "text" if isinstance(f.dataType, T.StringType) else "other" for f in df.schema.fields]
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows")).select(
        "n_rows", *[F.lit(kinds.count(k)).cast("long").alias(f"n_{k}") for k in ("numeric", "text", "other")], F.lit(len(kinds)).cast("long").alias("n_columns")
    )


# --------------------------------------------------------------------------- business rules
@dataclass(frozen=True)
class Rule:
    name: str
    flagged: Column  # count expression (an aggregate)
    action: str


def survey_rules(c: SurveyColumns = SURVEY) -> list[Rule]:
    bad_flags = None
    for f in c.tools:
        e = F.count_if(not_binary(f))
        bad_flags = e if bad_flags is None else bad_flags + e
    return [
        Rule(CHECK_FREE_WTP[0], F.count_if((F.col(c.tier) == "Free") & (F.col(c.wtp) > 50)), CHECK_FREE_WTP[1]),
        Rule(CHECK_NONSUB_MRR[0], F.count_if((F.col(c.subscribe) == 0) & (F.col(c.mrr) > 0)), CHECK_NONSUB_MRR[1]),
        Rule(CHECK_CHURN_RANGE[0], F.count_if((F.col(c.churn) < 0) | (F.col(c.churn) > 1)), CHECK_CHURN_RANGE[1]),
        Rule(CHECK_NEG_SPEND[0], F.count_if(F.col(c.spend) < 0), CHECK_NEG_SPEND[1]),
        Rule(CHECK_FLAGS[0], bad_flags, CHECK_FLAGS[1]),
    ]


def run_checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All rules in one aggregation: (position, check, flagged, action, status).  A missing value (NULL, NaN) breaks no range rule."""
    row = without_nan(df).agg(*[r.flagged.cast("long").alias(f"r{i}") for i, r in enumerate(rules)])
    cells = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(r.name).alias("check"),
            F.col(f"r{i}").alias("flagged"),
            F.lit(r.action).alias("action"),
            F.when(F.col(f"r{i}") > 0, F.lit(STATUS_FOUND)).otherwise(F.lit(STATUS_CLEAN)).alias("status"),
        )
        for i, r in enumerate(rules)
    ]
    return row.select(_cells(cells))


def checks_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if(F.col("status") == STATUS_CLEAN).cast("long").alias("checks_passed"),
        F.count(F.lit(1)).cast("long").alias("checks_total"),
    )


# --------------------------------------------------------------------------- duplicates
def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each equal group: whole row, key only, all but the key.  NULLs compare equal.

    Only the key and a 128-bit hash of the other columns are shuffled for all rows; whole rows are then compared among those whose hash
    another row has, so the counts do not rest on the hash.  Copies of a row are combined map-side before they are shuffled.
    """
    others, n = [c for c in df.columns if c != key], F.count(F.lit(1))
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    values = [F.col(c) + F.lit(0.0) if c in floats else F.col(c) for c in others]  # 0.0 and -0.0 are one value, as in grouping
    mark = [F.xxhash64(*values).alias("__h"), F.xxhash64(F.lit(1), *reversed(values)).alias("__g")]
    narrow = df.select(key, *mark)
    ids = narrow.groupBy(key).agg(n.alias("copies")).agg((F.sum("copies") - n).alias("extra"))
    alike = narrow.groupBy("__h", "__g").agg(n.alias("copies")).where("copies > 1").select("__h", "__g")
    rows = df.select(*df.columns, *mark).join(alike, ["__h", "__g"], "left_semi").groupBy(*df.columns).agg(n.alias("copies"))
    same = rows.agg((F.sum("copies") - n).alias("extra"))
    answers = rows.groupBy(*others).agg(F.sum("copies").alias("copies")).agg((F.sum("copies") - n).alias("extra"))
    row = same.select(F.col("extra").alias("full_row"), ids.scalar().alias("id"), answers.scalar().alias("answers_without_id"))
    cells = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("n_duplicates"))
        for i, k in enumerate(row.columns)
    ]
    return row.select(_cells(cells))


def drop_duplicates_exact(df: DataFrame) -> DataFrame:
    """Remove whole-row copies (deterministic: nothing to choose between equal rows)."""
    return df.distinct()


def drop_duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the smallest one in column order (NULLs first) - the same whatever the partitioning.

    A grouped minimum with map-side combine, so a key with very many copies costs a row per task.
    """
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("__row")).select(*[F.col(c) if c == key else F.col("__row")[c].alias(c) for c in df.columns])


# --------------------------------------------------------------------------- IQR outliers
def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Exact Q1/Q3 (linear interpolation) and fences Q1 - k IQR, Q3 + k IQR per column (unrounded)."""
    q = quantile_wide(df, list(columns), {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i + 1))])
    return q.select(
        F.element_at(order, F.col("column")).alias("position"),
        F.col("column").alias("feature"),
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - F.lit(k) * iqr).alias("lower_fence"),
        (F.col("q3") + F.lit(k) * iqr).alias("upper_fence"),
    )


def fence_map(fences: DataFrame) -> Column:
    """Scalar subquery: map feature -> struct(lower_fence, upper_fence)."""
    m = fences.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lower_fence", "upper_fence")))).alias("m")
    )
    return m.scalar()


def clip_to_fences(c: str, fmap: Column) -> Column:
    lo = fmap[F.lit(c)]["lower_fence"]
    hi = fmap[F.lit(c)]["upper_fence"]
    x = F.col(c).cast("double")
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def outlier_summary(df: DataFrame, columns: Sequence[str], k: float = 1.5, digits: int = 2) -> DataFrame:
    """Fences (rounded), count strictly outside, percent of *all* rows, cap-or-retain policy."""
    df = without_nan(df, columns)
    fences = iqr_fences(df, columns, k)
    fm = F.col("__fm")
    row = df.select(*columns, fence_map(fences).alias("__fm")).agg(
        F.count(F.lit(1)).alias("__n"),
        *[
            F.count_if((F.col(c) < fm[F.lit(c)]["lower_fence"]) | (F.col(c) > fm[F.lit(c)]["upper_fence"])).alias(f"o{i}")
            for i, c in enumerate(columns)
        ],
    )
    counts = row.select(
        _cells([F.struct(F.lit(c).alias("feature"), F.col(f"o{i}").alias("outliers"), F.col("__n").alias("n")) for i, c in enumerate(columns)])
    )
    pct = F.try_divide("outliers", "n") * 100  # NULL for an empty table
    r = lambda x: F.bround(F.col(x), digits)
    return fences.join(F.broadcast(counts), "feature").select(
        "position",
        "feature",
        r("q1").alias("q1"),
        r("q3").alias("q3"),
        r("lower_fence").alias("lower_fence"),
        r("upper_fence").alias("upper_fence"),
        F.col("outliers").cast("long").alias("outliers"),
        F.when(pct.isNotNull(), F.format_string("%.1f%%", F.bround(pct, 1))).alias("outlier_pct"),
        F.when(pct > 1, F.lit(OUTLIER_CAP)).otherwise(F.lit(OUTLIER_RETAIN)).alias("action"),
    )


def winsorize(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Clip each column to its IQR fences; NULL stays NULL (as does NaN), no row is removed (clipped columns become double)."""
    df = without_nan(df, columns)
    base = df.select("*", fence_map(iqr_fences(df, columns, k)).alias("__fm"))  # fences projected once
    return base.select(*[clip_to_fences(c, F.col("__fm")).alias(c) if c in columns else F.col(c) for c in df.columns])


def box_stats(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Data behind before/after box plots: quartiles, whiskers (extreme values within k IQR), flier count.

    Quartiles are ranked once: clipping to the fences keeps the order, so the quartiles after it are interpolated between the clipped values at the
    same ranks.  Whiskers and fliers of both stages are conditional aggregates of one more scan.
    """
    df = without_nan(df, columns)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    known = {(r["column"], r["q"]): r for r in quantile_neighbours(df, list(columns), list(probs.values()))}

    def between(lo: float, hi: float, share: float) -> float:
        return lo if share == 0 else lo + (hi - lo) * share

    rows, aggs, cells = [], [], []
    for i, c in enumerate(columns):
        if not known[c, 0.25]["n"]:
            continue
        before = {name: between(*(known[c, q][x] for x in ("lower", "upper", "share"))) for name, q in probs.items()}
        iqr = before["q3"] - before["q1"]
        low, high = before["q1"] - k * iqr, before["q3"] + k * iqr
        after = {name: between(*(min(max(known[c, q][x], low), high) for x in ("lower", "upper")), known[c, q]["share"]) for name, q in probs.items()}
        x = F.col(c).cast("double")
        clipped = F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)
        for stage, v, q in (("before", x, before), ("after", clipped, after)):
            lo, hi = q["q1"] - k * (q["q3"] - q["q1"]), q["q3"] + k * (q["q3"] - q["q1"])
            at = f"{i}_{stage}"
            aggs += [F.min(F.when(v >= lo, v)).alias(f"l{at}"), F.max(F.when(v <= hi, v)).alias(f"h{at}"), F.count_if((v < lo) | (v > hi)).cast("long").alias(f"n{at}")]
            values = [F.lit(float(q[name])).alias(name) for name in probs]
            cells.append(F.struct(F.lit(c).alias("feature"), F.lit(stage).alias("stage"), *values, F.col(f"l{at}").alias("whisker_low"), F.col(f"h{at}").alias("whisker_high"), F.col(f"n{at}").alias("fliers")))
    if not cells:
        doubles = [F.lit(None).cast("double").alias(x) for x in (*probs, "whisker_low", "whisker_high")]
        return df.limit(0).select(F.lit("").alias("feature"), F.lit("").alias("stage"), *doubles, F.lit(0).cast("long").alias("fliers"))
    return df.agg(*aggs).select(_cells(cells))


def box_stats_plain(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and flier count of each column as it is (no before/after)."""
    df = without_nan(df, columns)
    qs = quantile_wide(df, list(columns), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "v").where(F.col("v").isNotNull())
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - F.lit(k) * iqr, F.col("q3") + F.lit(k) * iqr
    v = F.col("v")
    out = (
        long.join(F.broadcast(qs), "column")
        .groupBy("column", "q1", "median", "q3")
        .agg(
            F.min(F.when(v >= lo, v)).alias("whisker_low"),
            F.max(F.when(v <= hi, v)).alias("whisker_high"),
            F.count_if((v < lo) | (v > hi)).cast("long").alias("fliers"),
        )
    )
    return out.select(F.col("column").alias("feature"), "q1", "median", "q3", "whisker_low", "whisker_high", "fliers")


# --------------------------------------------------------------------------- repairs
def impute_median_mode(df: DataFrame, columns: Sequence[str] | None = None, c: SurveyColumns = SURVEY) -> DataFrame:
    """Missing (NULL, NaN) numeric -> exact median; NULL string -> most frequent value (ties -> smallest value).

    ``columns`` defaults to all but the key and the targets.  Only columns that have NULLs are touched: one scan
    counts them, quantiles and modes are computed for those alone, and a whole-number column becomes
    double only if it has something to fill.  Modes come from one ``groupBy(feature, value).count()``.
    """
    wanted = [x for x in (columns or df.columns) if columns or x not in (c.id, c.subscribe, c.mrr)]
    df = without_nan(df, wanted)
    have = df.agg(*[F.max(F.col(x).isNull()).alias(x) for x in wanted]).first() if wanted else None
    holes = [x for x in wanted if have[x]]
    num = [f.name for f in df.schema.fields if f.name in holes and isinstance(f.dataType, NUMERIC_TYPES)]
    txt = [f.name for f in df.schema.fields if f.name in holes and isinstance(f.dataType, T.StringType)]
    med = None
    if num:
        medians = quantile_wide(df, num, {"median": 0.5})
        med = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("m")).scalar()
    mode = None
    if txt:
        long = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in txt])).alias("kv")
        ).select("kv.*").where(F.col("value").isNotNull())
        counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
        best = counts.groupBy("feature").agg(F.min_by("value", F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("mode"))
        mode = best.agg(F.map_from_entries(F.collect_list(F.struct("feature", "mode"))).alias("m")).scalar()
    # fill values projected once as columns (one subquery each in the plan)
    base = df.select("*", *([med.alias("__med")] if med is not None else []), *([mode.alias("__mode")] if mode is not None else []))
    out = []
    for x in df.columns:
        if x in num:
            out.append(F.coalesce(F.col(x).cast("double"), F.col("__med")[F.lit(x)]).alias(x))
        elif x in txt:
            out.append(F.coalesce(F.col(x), F.col("__mode")[F.lit(x)]).alias(x))
        else:
            out.append(F.col(x))
    return base.select(*out)


def drop_sparse_rows(df: DataFrame, max_missing_share: float = 0.30) -> DataFrame:
    """Remove rows with more than ``max_missing_share`` of their fields missing (NULL or NaN)."""
    nulls = None
    for c in df.columns:
        e = is_missing(df, c).cast("int")
        nulls = e if nulls is None else nulls + e
    return df.where(nulls / F.lit(len(df.columns)) <= F.lit(max_missing_share))


def repair_expressions(c: SurveyColumns = SURVEY) -> dict[str, Column]:
    """The check actions: Free & WTP > 50 -> WTP 5; non-subscriber MRR -> 0; churn clipped
    to [0, 1]; negative spend -> 0; flags rounded and clipped to {0, 1} (NULL stays NULL)."""
    out = {
        c.wtp: F.when((F.col(c.tier) == "Free") & (F.col(c.wtp) > 50), F.lit(5.0)).otherwise(F.col(c.wtp)),
        c.mrr: F.when((F.col(c.subscribe) == 0) & (F.col(c.mrr) > 0), F.lit(0.0)).otherwise(F.col(c.mrr)),
        c.churn: F.when(F.col(c.churn) < 0, F.lit(0.0)).when(F.col(c.churn) > 1, F.lit(1.0)).otherwise(F.col(c.churn)),
        c.spend: F.when(F.col(c.spend) < 0, F.lit(0.0)).otherwise(F.col(c.spend)),
    }
    for f in c.tools:
        clipped = F.least(F.greatest(F.round(F.col(f)), F.lit(0)), F.lit(1)).cast("int")
        out[f] = F.when(F.col(f).isNotNull(), clipped)  # greatest() skips NULL, so it has to be kept apart
    return out


def repair_rules(df: DataFrame, c: SurveyColumns = SURVEY) -> DataFrame:
    """Apply ``repair_expressions``; NaN becomes NULL."""
    df = without_nan(df)
    fixed = repair_expressions(c)
    return df.select(*[fixed[x].alias(x) if x in fixed else F.col(x) for x in df.columns])


def pipeline_audit(df: DataFrame, c: SurveyColumns = SURVEY) -> DataFrame:
    """Rows in, rows out and columns affected of each cleaning step, and a row of totals, measured on ``df``.

    Winsorizing and repairs are applied to the de-duplicated rows and compared with them in one pass: a column
    counts as affected if a step changes a value of it.  Encodings and targets count the columns they really add.

    ``df`` is read once: its distinct rows are written with the number of their copies, and everything is counted from that table.
    """
    from cohortlab.operators.encode import derive_targets, ordinal_encode
    from cohortlab.session import materialize

    df = without_nan(df)
    names, n = df.columns, F.count(F.lit(1)).cast("long")
    copies = F.col("__copies")
    counted = materialize(df.groupBy(*names).agg(n.alias("__copies")), "audit_rows")
    total_copies = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    raw = counted.agg(total_copies(copies).alias("n"), *[total_copies(F.when(is_missing(counted, x), copies)).alias(x) for x in names])
    missing = sum(((F.col(x) > 0).cast("long") for x in names), F.lit(0).cast("long"))
    raw = raw.select(F.struct("n", missing.alias("missing")).alias("raw"))

    rows = counted.select(*names)
    fences = fence_map(iqr_fences(rows, c.outlier_cols))
    base = rows.select("*", fences.alias("__fm"))
    clipped = {x: ~clip_to_fences(x, F.col("__fm")).eqNullSafe(F.col(x).cast("double")) for x in c.outlier_cols}
    fixed = repair_expressions(c)
    repaired = {x: ~e.eqNullSafe(F.col(x)) for x, e in fixed.items()}
    marks = {f"o_{x}": e for x, e in clipped.items()} | {f"r_{x}": e for x, e in repaired.items()}
    found = base.agg(n.alias("d"), *[F.coalesce(F.max(e), F.lit(False)).alias(k) for k, e in marks.items()])

    def total(*columns: Column) -> Column:
        return sum((x.cast("long") for x in columns), F.lit(0).cast("long"))

    outliers = total(*[F.col(f"o_{x}") for x in clipped])
    repairs = total(*[F.col(f"r_{x}") for x in repaired])
    both = total(*[F.coalesce(F.col(f"o_{x}") if x in clipped else F.lit(False), F.lit(False)) | (F.col(f"r_{x}") if x in repaired else F.lit(False)) for x in {**clipped, **repaired}])
    found = found.select("d", outliers.alias("outliers"), repairs.alias("repairs"), both.alias("both"), raw.scalar().alias("raw"))

    typed = sum(dtype_display(f.dataType)[1] for f in df.schema.fields)
    ordinal = len(ordinal_encode(rows).columns) - len(names)
    nominal = len([x for x in c.nominal if x in names])
    scaled = len([x for x in c.scale_cols if x in names])
    targets = len(derive_targets(rows, c).columns) - 2  # next to the key and the score
    count = lambda k: F.lit(k).cast("long")
    first, d = F.col("raw")["n"], F.col("d")
    counts = [
        (first, first, count(len(names))),
        (first, first, F.col("raw")["missing"]),
        (first, d, count(len(names))),
        (d, d, count(typed)),
        (d, d, F.col("outliers")),
        (d, d, F.col("repairs")),
        (d, d, count(ordinal)),
        (d, d, count(nominal)),
        (d, d, count(scaled)),
        (d, d, count(targets)),
        (first, d, F.col("both") + count(ordinal + nominal)),
    ]
    steps = [(k, title, *c) for (k, title), c in zip(AUDIT_STEPS, counts, strict=True)]
    cells = [
        F.struct(F.lit(k).alias("step"), F.lit(p).alias("process"), a.alias("rows_in"), b.alias("rows_out"), x.alias("cols_affected"))
        for k, p, a, b, x in steps
    ]
    return found.select(_cells(cells))

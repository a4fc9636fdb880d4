"""Association rules for product bundles.

Flag path (few binary columns, the dashboard's case).  Each row becomes a
bitmask; ``groupBy(mask).count()`` collapses the table to at most 2^k rows with
map-side combine — one scan, however skewed the baskets.  Itemsets are the
subsets (size <= max_size) of each distinct mask, exploded from that tiny table
and summed.  Rules join itemsets to their antecedent / consequent supports; all
of these tables are bounded by sum_{s<=max_size} C(k, s) rows, so broadcasting
them is safe.  Unlike Spark's ``associationRules``, consequents may hold several
items (every non-empty proper subset is an antecedent), as in the dashboard.

Beyond 62 flags a mask is an array of longs and item sets are mined level by level (``wide_itemsets``): only pairs of
frequent items, and only larger sets whose pairs are all frequent, are ever counted.

Basket path (many items, arrays).  ``pyspark.ml.fpm.FPGrowth`` (parallel FP-growth)
mines the frequent itemsets; thresholds are re-checked exactly as ``count / n``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.config import TOOL_LABELS
from cohortlab.functions.broadcast import broadcast_if_bounded
from cohortlab.functions.exprs import WORD, bit, bitmask, has_bit, mask_items, proper_subsets, subsets_upto, wide_items, wide_minus, wide_of
from cohortlab.session import ensure_checkpoint_dir

DEFAULT_SUPPORT = 0.15
DEFAULT_CONFIDENCE = 0.50
MAX_SIZE = 3


def _n_itemsets(k: int, max_size: int) -> int:
    from math import comb

    return sum(comb(k, s) for s in range(1, max_size + 1))


# --------------------------------------------------------------------------- flag path
def mask_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """``(mask long, cnt long)``: one row per distinct basket; the empty basket is mask 0.

    Checkpointed in the shared folder: the source is scanned once however many itemset and rule steps
    read the table, and nothing of it goes through the driver.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.select(bitmask(flags).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("cnt")).checkpoint()


def label_of(mask: Column, labels: Sequence[str], sep: str) -> Column:
    if len(labels) > WORD:
        return label_of_items(wide_items(mask, len(labels)), labels, sep)
    return F.array_join(mask_items(mask, labels), sep)


def label_of_items(items: Column, labels: Sequence[str], sep: str) -> Column:
    names = F.array(*[F.lit(x) for x in labels])
    return F.array_join(F.transform(items, lambda i: F.element_at(names, i + 1)), sep)


def wide_itemsets(masks: DataFrame, labels: Sequence[str], min_support: float = 0.0, max_size: int = MAX_SIZE, sep: str = " + ") -> DataFrame:
    """``itemset_support`` of array masks, sets with ``min_support`` only.

    Baskets are cut down to their frequent items and grouped again.  Level s joins a basket's frequent sets of s - 1 items with its
    frequent pairs that go on from their last item; sets whose first and last item are no frequent pair are dropped before they are counted.
    """
    k, n = len(labels), masks.agg(F.sum("cnt").alias("n")).scalar()
    ensure_checkpoint_dir(masks.sparkSession)

    def frequent(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("set").agg(F.sum("cnt").alias("count"))
        return counts.where(F.col("count") / n >= F.lit(min_support)).checkpoint()  # mined once, read by the next level and the result

    single = masks.select(F.explode(wide_items(F.col("mask"), k)).alias("i"), "cnt").select(F.array("i").alias("set"), "cnt")
    levels = [frequent(single)]
    often = levels[0].agg(F.collect_set(F.col("set")[0])).scalar()  # at most the number of flags
    baskets = masks.select(F.array_intersect(wide_items(F.col("mask"), k), often).alias("items"), "cnt").where(F.size("items") > 1)
    baskets = baskets.groupBy("items").agg(F.sum("cnt").alias("cnt")).select(F.monotonically_increasing_id().alias("basket"), "items", "cnt").checkpoint()
    pair = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.greatest(F.size("items") - i - 1, F.lit(0))), lambda y: F.array(x, y))))
    rows = baskets.select("basket", "cnt", F.explode(pair).alias("set"))
    pairs = grown = None
    for size in range(2, max_size + 1):
        if size > 2:
            step = pairs.select("basket", F.col("set")[0].alias("last"), F.col("set")[1].alias("next"))
            rows = grown.withColumn("last", F.element_at("set", -1)).join(step, ["basket", "last"]).select("basket", "cnt", F.concat("set", F.array("next")).alias("set"))
            ends = levels[1].select(F.col("set")[0].alias("_a"), F.col("set")[1].alias("_b"))
            rows = rows.join(ends, (F.element_at("set", 1) == F.col("_a")) & (F.element_at("set", -1) == F.col("_b")), "left_semi")
        levels.append(frequent(rows))
        grown = rows.join(levels[-1].select("set"), "set", "left_semi")
        pairs = grown if size == 2 else pairs
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select(
        wide_of(F.col("set"), k).alias("itemset"),
        label_of_items(F.col("set"), labels, sep).alias("items"),
        F.size("set").alias("size"),
        F.col("count").cast("long").alias("count"),
        (F.col("count") / n).alias("support"),
    )


def itemset_support(masks: DataFrame, labels: Sequence[str], max_size: int = MAX_SIZE, sep: str = " + ") -> DataFrame:
    """Support of every itemset (size 1..max_size) that occurs: ``(itemset, items, size, count, support)``.

    The denominator counts every row, empty baskets included.
    """
    k = len(labels)
    if k > WORD:
        return wide_itemsets(masks, labels, 0.0, max_size, sep)
    n = masks.agg(F.sum("cnt").alias("n")).scalar()
    subs = masks.select(F.explode(subsets_upto(F.col("mask"), k, max_size)).alias("itemset"), "cnt")
    agg = subs.groupBy("itemset").agg(F.sum("cnt").alias("count"))
    return agg.select(
        "itemset",
        label_of(F.col("itemset"), labels, sep).alias("items"),
        F.bit_count("itemset").alias("size"),
        F.col("count").cast("long").alias("count"),
        (F.col("count") / n).alias("support"),
    )


def frequent_itemsets(itemsets: DataFrame, min_support: float = DEFAULT_SUPPORT) -> DataFrame:
    return itemsets.where(F.col("support") >= F.lit(min_support))


def rules_from_itemsets(
    frequent: DataFrame,
    n_items: int,
    labels: Sequence[str],
    min_confidence: float = DEFAULT_CONFIDENCE,
    sep: str = " + ",
    max_size: int = MAX_SIZE,
    digits: int = 4,
) -> DataFrame:
    """Every non-empty proper subset of a frequent itemset as antecedent, the rest as consequent.

    conf = sup(S) / sup(A) (0 if sup(A) = 0), lift = conf / sup(C) (0 if sup(C) = 0);
    kept when the unrounded confidence >= ``min_confidence``; values rounded half-even.
    """
    bound = _n_itemsets(n_items, max_size)
    sup = broadcast_if_bounded(frequent.select(F.col("itemset").alias("sub"), F.col("support").alias("sub_support")), bound)
    larger = frequent.where(F.col("size") >= 2)
    if n_items > WORD:
        chosen = F.explode(F.sequence(F.lit(1).cast("long"), bit(F.col("size")) - 2)).alias("chosen")  # bit i: item i of the set is in the antecedent
        parts = larger.select("support", "itemset", wide_items(F.col("itemset"), n_items).alias("set"), chosen)
        ant = F.filter("set", lambda _, i: has_bit(F.col("chosen"), i))
        pairs = parts.select("support", "itemset", wide_of(ant, n_items).alias("ant")).withColumn("con", wide_minus(F.col("itemset"), F.col("ant")))
    else:
        pairs = larger.select(F.col("itemset"), F.col("support"), F.explode(proper_subsets(F.col("itemset"), n_items, max_size)).alias("ant")).withColumn(
            "con", F.col("itemset").bitwiseAND(F.bitwise_not(F.col("ant")))
        )
    a = sup.select(F.col("sub").alias("ant"), F.col("sub_support").alias("ant_support"))
    c = sup.select(F.col("sub").alias("con"), F.col("sub_support").alias("con_support"))
    j = pairs.join(a, "ant", "left").join(c, "con", "left")
    conf = F.when(F.col("ant_support") > 0, F.col("support") / F.col("ant_support")).otherwise(F.lit(0.0))
    lift = F.when(F.col("con_support") > 0, F.col("conf") / F.col("con_support")).otherwise(F.lit(0.0))
    r = j.withColumn("conf", conf).withColumn("lift_raw", lift).where(F.col("conf") >= F.lit(min_confidence))
    return r.select(
        "ant",
        "con",
        label_of(F.col("ant"), labels, sep).alias("antecedent"),
        label_of(F.col("con"), labels, sep).alias("consequent"),
        F.bround("support", digits).alias("support"),
        F.bround("conf", digits).alias("confidence"),
        F.bround("lift_raw", digits).alias("lift"),
    )


def mine_flag_rules(
    df: DataFrame,
    labels: Mapping[str, str] = TOOL_LABELS,
    min_support: float = DEFAULT_SUPPORT,
    min_confidence: float = DEFAULT_CONFIDENCE,
    sep: str = " + ",
    max_size: int = MAX_SIZE,
) -> DataFrame:
    """Rules over 0/1 flag columns (``labels``: flag column -> display label, in item order)."""
    flags, names = list(labels), list(labels.values())
    masks = mask_counts(df, flags)
    items = wide_itemsets(masks, names, min_support, max_size, sep) if len(flags) > WORD else itemset_support(masks, names, max_size, sep)
    return rules_from_itemsets(frequent_itemsets(items, min_support), len(flags), names, min_confidence, sep, max_size)


def rule_order() -> list[Column]:
    return [F.desc("lift"), F.desc("confidence"), F.desc("support"), F.asc("antecedent"), F.asc("consequent")]


def top_rules(rules: DataFrame, k: int) -> DataFrame:
    """k strongest rules by lift; ties broken by confidence, support, antecedent, consequent."""
    return rules.orderBy(*rule_order()).limit(k)


def rule_kpis(rules: DataFrame, capped: DataFrame) -> DataFrame:
    """Count, max lift, mean confidence of the capped list (as displayed) and of all rules."""
    a = capped.agg(
        F.count(F.lit(1)).cast("long").alias("rules_shown"),
        F.max("lift").alias("max_lift_shown"),
        F.avg("confidence").alias("avg_confidence_shown"),
    )
    b = rules.agg(
        F.count(F.lit(1)).cast("long").alias("rules_total"),
        F.max("lift").alias("max_lift_total"),
        F.avg("confidence").alias("avg_confidence_total"),
    )
    both = a.select("*", b.select(F.struct("*").alias("s")).scalar().alias("__b"))
    bs = F.col("__b")
    return both.select(
        "rules_shown", "max_lift_shown", "avg_confidence_shown",
        bs["rules_total"].alias("rules_total"), bs["max_lift_total"].alias("max_lift_total"), bs["avg_confidence_total"].alias("avg_confidence_total"),
    )


def cooccurrence(df: DataFrame, labels: Mapping[str, str] = TOOL_LABELS) -> DataFrame:
    """Full k x k support matrix in long form (diagonal = single support), from the mask table."""
    flags, names = list(labels), list(labels.values())
    masks = mask_counts(df, flags)
    if len(flags) > WORD:
        return _wide_cooccurrence(masks, names)
    cells = []
    for i in range(len(flags)):
        for j in range(len(flags)):
            bits = (1 << i) | (1 << j)
            cells.append((i, j, F.sum(F.when(F.col("mask").bitwiseAND(bits) == bits, F.col("cnt")).otherwise(0))))
    row = masks.agg(F.sum("cnt").alias("__n"), *[e.alias(f"c{i}_{j}") for i, j, e in cells])
    structs = [
        F.struct(F.lit(names[i]).alias("item_a"), F.lit(names[j]).alias("item_b"), (F.col(f"c{i}_{j}") / F.col("__n")).alias("support"))
        for i, j, _ in cells
    ]
    return row.select(F.inline(F.array(*structs)))


def _wide_cooccurrence(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """The pairs of each distinct basket, counted; as many cells as flags squared by definition, absent ones 0."""
    k, n = len(names), masks.agg(F.sum("cnt").alias("n")).scalar()
    items = masks.select(wide_items(F.col("mask"), k).alias("items"), "cnt").select(F.explode("items").alias("a"), "items", "cnt").select("a", F.explode("items").alias("b"), "cnt")
    counts = items.groupBy("a", "b").agg(F.sum("cnt").alias("count"))
    grid = masks.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("a"), (F.col("id") % k).cast("int").alias("b"))
    label = F.array(*[F.lit(x) for x in names])
    j = grid.join(counts, ["a", "b"], "left")
    return j.select(F.element_at(label, F.col("a") + 1).alias("item_a"), F.element_at(label, F.col("b") + 1).alias("item_b"), (F.coalesce("count", F.lit(0)) / n).alias("support"))


# --------------------------------------------------------------------------- basket path
def flag_baskets(df: DataFrame, labels: Mapping[str, str] = TOOL_LABELS) -> DataFrame:
    """0/1 flags -> ``items`` array of labels (empty array for no flag set)."""
    arr = F.array(*[F.when(F.col(f) == 1, F.lit(lab)) for f, lab in labels.items()])
    return df.select(F.filter(arr, lambda x: x.isNotNull()).alias("items"))


def fpgrowth_itemsets(baskets: DataFrame, min_support: float, items_col: str = "items", max_size: int | None = None, partitions: int | None = None) -> DataFrame:
    """Frequent itemsets by parallel FP-growth, thresholds re-checked exactly: ``(items, size, count, support)``.

    Items are de-duplicated per basket (FPGrowth rejects repeats); empty baskets
    count in the denominator, NULL baskets do not.
    """
    b = baskets.where(F.col(items_col).isNotNull()).select(F.array_distinct(F.col(items_col)).alias("items"))
    n = F.lit(float(b.count()))
    fp = FPGrowth(itemsCol="items", minSupport=max(min_support * 0.999, 0.0), minConfidence=0.0)
    if partitions:
        fp = fp.setNumPartitions(partitions)
    model = fp.fit(b)
    ensure_checkpoint_dir(baskets.sparkSession)
    # the model's item sets are recomputed by every action: a reliable checkpoint (shared folder)
    # mines once and cuts the lineage, so a lost executor does not re-run the mining
    f = model.freqItemsets.checkpoint().select(F.array_sort("items").alias("items"), F.col("freq").alias("count"))
    f = f.where((F.col("count") / n) >= F.lit(min_support))
    if max_size:
        f = f.where(F.size("items") <= max_size)
    return f.select("items", F.size("items").alias("size"), F.col("count").cast("long").alias("count"), (F.col("count") / n).alias("support"))


def itemsets_to_masks(itemsets: DataFrame, labels: Sequence[str], sep: str = " + ") -> DataFrame:
    """Array itemsets over a known item list -> the mask form used by ``rules_from_itemsets``."""
    arr = F.array(*[F.lit(x) for x in labels])
    mask = F.aggregate(
        F.transform(F.col("items"), lambda it: bit(F.array_position(arr, it).cast("int") - 1)),
        F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(x),
    )
    return itemsets.select(
        mask.alias("itemset"), label_of(mask, labels, sep).alias("items"), "size", "count", "support"
    )


def basket_rules(baskets: DataFrame, min_support: float, min_confidence: float, items_col: str = "items", digits: int = 4, max_size: int | None = MAX_SIZE) -> DataFrame:
    """Rules of many-item baskets from FP-growth itemsets (exact supports): every non-empty proper subset of a
    frequent itemset is an antecedent, the rest its consequent.

    conf = count(S) / count(A), lift = conf / support(C); joins on the sorted item arrays.
    """
    f = fpgrowth_itemsets(baskets, min_support, items_col, max_size)
    subset = F.explode(F.sequence(F.lit(1).cast("long"), bit(F.col("size")) - 2)).alias("subset")  # bit i: item i is in the antecedent
    split = f.where(F.col("size") >= 2).select(F.col("items").alias("itemset"), F.col("count").alias("s_count"), "support", subset)
    cand = split.select(
        "s_count",
        "support",
        F.filter("itemset", lambda _, i: has_bit(F.col("subset"), i)).alias("ant_items"),
        F.filter("itemset", lambda _, i: ~has_bit(F.col("subset"), i)).alias("con_items"),
    )
    a = f.select(F.col("items").alias("ant_items"), F.col("count").alias("a_count"))
    c = f.select(F.col("items").alias("con_items"), F.col("support").alias("c_support"))
    j = cand.join(a, "ant_items").join(c, "con_items")
    r = j.withColumn("conf", F.col("s_count") / F.col("a_count")).where(F.col("conf") >= F.lit(min_confidence))
    return r.select(
        F.array_join("ant_items", ", ").alias("antecedent"),
        F.array_join("con_items", ", ").alias("consequent"),
        F.bround("support", digits).alias("support"),
        F.bround("conf", digits).alias("confidence"),
        F.bround(F.col("conf") / F.col("c_support"), digits).alias("lift"),
    )


def miner_comparison(rule_sets: Mapping[str, DataFrame]) -> DataFrame:
    """Per method: rules, max lift, mean confidence, mean support (3 places)."""
    parts = []
    for method, r in rule_sets.items():
        parts.append(
            r.agg(
                F.count(F.lit(1)).cast("long").alias("rules"),
                F.bround(F.max("lift"), 3).alias("max_lift"),
                F.bround(F.avg("confidence"), 3).alias("avg_confidence"),
                F.bround(F.avg("support"), 3).alias("avg_support"),
            ).select(F.lit(method).alias("method"), "*")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_difference(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """``(only_in, copies, *columns)``: rules that one list has and the other lacks, both ways, copies counted.

    One grouped count with a sign for each list instead of two differences: each list is read once.
    """
    columns = [c for c in first.columns if c in second.columns]
    signed = first.select(*columns, F.lit(1).alias("sign")).unionByName(second.select(*columns, F.lit(-1).alias("sign")))
    more = signed.groupBy(*columns).agg(F.sum("sign").alias("more")).where("more <> 0")
    return more.select(F.when(F.col("more") > 0, F.lit(names[0])).otherwise(F.lit(names[1])).alias("only_in"), F.abs("more").cast("long").alias("copies"), *columns)


def top_per_method(rule_sets: Mapping[str, DataFrame], k: int = 8, ant_chars: int = 18, con_chars: int = 12) -> DataFrame:
    """Top-k rules by lift per method with the chart label ``ant[:18] -> con[:12]``."""
    parts = []
    for method, r in rule_sets.items():
        t = top_rules(r, k).select(
            F.lit(method).alias("method"),
            "antecedent",
            "consequent",
            "lift",
            F.concat(F.substring("antecedent", 1, ant_chars), F.lit("->"), F.substring("consequent", 1, con_chars)).alias("label"),
        )
        parts.append(t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_frequency(itemsets: DataFrame) -> DataFrame:
    """Single items by descending support (the second miner's item order)."""
    w = Window.orderBy(F.desc("support"), F.asc("items"))
    return itemsets.where(F.col("size") == 1).select(
        F.row_number().over(w).alias("rank"), F.col("items").alias("item"), "count", "support"
    )

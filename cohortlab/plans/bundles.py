"""Bundle discovery queries (B1-B10, K2, K3, K6) with DuckDB oracles.

The oracle enumerates every itemset of the seven flags explicitly (63 filtered
counts) — the brute force the dashboard runs — while the Spark side mines the
bitmask table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cohortlab.config import TOOL_LABELS
from cohortlab.operators import rules as ar
from cohortlab.plans.registry import register, survey
from cohortlab.plans.survey_sql import with_survey
from cohortlab.sources.baskets import basket_brand, basket_event
from cohortlab.sources.tables import table

FLAGS = list(TOOL_LABELS)
NAMES = list(TOOL_LABELS.values())
SUP, CONF = ar.DEFAULT_SUPPORT, ar.DEFAULT_CONFIDENCE
BRAND_SUP, BRAND_CONF = 0.02, 0.10
EVENT_SUP, EVENT_CONF = 0.05, 0.30


# ----------------------------------------------------------------------------- oracle SQL pieces
def _combos(max_size: int = 3):
    for s in range(1, max_size + 1):
        yield from combinations(range(len(FLAGS)), s)


def _mask(ix) -> int:
    return sum(1 << i for i in ix)


def _isup_cte() -> str:
    parts = []
    for ix in _combos():
        cond = " AND ".join(f"{FLAGS[i]} = 1" for i in ix)
        parts.append(
            f"SELECT {_mask(ix)} AS itemset, {len(ix)} AS size, count(*) FILTER (WHERE {cond}) AS cnt, count(*) AS n FROM survey"
        )
    return "isup AS (SELECT itemset, size, cnt, cnt / n AS support FROM (" + " UNION ALL ".join(parts) + "))"


def _labels_cte(sep: str, name: str) -> str:
    rows = ", ".join(f"({_mask(ix)}, '{sep.join(NAMES[i] for i in ix)}')" for ix in _combos())
    return f"{name}(itemset, label) AS (VALUES {rows})"


def _pairs_cte() -> str:
    rows = []
    for ix in _combos():
        if len(ix) < 2:
            continue
        for s in range(1, len(ix)):
            for ant in combinations(ix, s):
                con = [i for i in ix if i not in ant]
                rows.append(f"({_mask(ix)}, {_mask(ant)}, {_mask(con)})")
    return "pairs(itemset, ant, con) AS (VALUES " + ", ".join(rows) + ")"


def _rules_ctes(sep: str = " + ", method: str | None = None) -> list[str]:
    m = f", '{method}' AS method" if method else ""
    return [
        _isup_cte(),
        _labels_cte(sep, "lab"),
        _pairs_cte(),
        f"""rules AS (
  SELECT la.label AS antecedent, lc.label AS consequent, round_even(x.s_support, 4) AS support,
         round_even(x.conf, 4) AS confidence, round_even(CASE WHEN x.c_support > 0 THEN x.conf / x.c_support ELSE 0 END, 4) AS lift{m}
  FROM (
    SELECT p.ant, p.con, s.support AS s_support, c.support AS c_support,
           CASE WHEN a.support > 0 THEN s.support / a.support ELSE 0 END AS conf
    FROM pairs p
    JOIN isup s ON s.itemset = p.itemset
    JOIN isup a ON a.itemset = p.ant
    JOIN isup c ON c.itemset = p.con
    WHERE s.support >= {SUP}
  ) x
  JOIN lab la ON la.itemset = x.ant
  JOIN lab lc ON lc.itemset = x.con
  WHERE x.conf >= {CONF})""",
    ]


_TOP = "ORDER BY lift DESC, confidence DESC, support DESC, antecedent ASC, consequent ASC"


def _flag_rules(spark, sf_dir, sep=" + "):
    return ar.mine_flag_rules(survey(spark, sf_dir), TOOL_LABELS, SUP, CONF, sep=sep)


def _fp_rules(spark, sf_dir, sep="+"):
    items = ar.fpgrowth_itemsets(ar.flag_baskets(survey(spark, sf_dir)), SUP, max_size=ar.MAX_SIZE)
    return ar.rules_from_itemsets(ar.itemsets_to_masks(items, NAMES, sep), len(NAMES), NAMES, CONF, sep=sep)


# ----------------------------------------------------------------------------- queries
@register(
    "itemset_support",
    with_survey(
        "SELECT i.itemset, l.label AS items, i.size, CAST(i.cnt AS BIGINT) AS count, round(i.support, 6) AS support FROM isup i JOIN lab l USING (itemset) WHERE i.cnt > 0",
        _isup_cte(),
        _labels_cte(" + ", "lab"),
    ),
)
def itemset_support(spark, sf_dir):
    s = ar.itemset_support(ar.mask_counts(survey(spark, sf_dir), FLAGS), NAMES)
    return s.select("itemset", "items", "size", "count", F.round("support", 6).alias("support"))


@register(
    "frequent_itemsets",
    with_survey(
        f"SELECT l.label AS items, i.size, CAST(i.cnt AS BIGINT) AS count, round(i.support, 6) AS support FROM isup i JOIN lab l USING (itemset) WHERE i.support >= {SUP}",
        _isup_cte(),
        _labels_cte(" + ", "lab"),
    ),
)
def frequent_itemsets(spark, sf_dir):
    s = ar.frequent_itemsets(ar.itemset_support(ar.mask_counts(survey(spark, sf_dir), FLAGS), NAMES), SUP)
    return s.select("items", "size", "count", F.round("support", 6).alias("support"))


@register("association_rules", with_survey("SELECT * FROM rules", *_rules_ctes()))
def association_rules(spark, sf_dir):
    return _flag_rules(spark, sf_dir).drop("ant", "con")


@register("rules_top30", with_survey(f"SELECT * FROM rules {_TOP} LIMIT 30", *_rules_ctes()))
def rules_top30(spark, sf_dir):
    return ar.top_rules(_flag_rules(spark, sf_dir).drop("ant", "con"), 30)


@register(
    "rule_kpis",
    with_survey(
        f"""
SELECT CAST(count(*) AS BIGINT) AS rules_shown, max(lift) AS max_lift_shown, round(avg(confidence), 6) AS avg_confidence_shown,
       (SELECT CAST(count(*) AS BIGINT) FROM rules) AS rules_total, (SELECT max(lift) FROM rules) AS max_lift_total,
       (SELECT round(avg(confidence), 6) FROM rules) AS avg_confidence_total
FROM (SELECT * FROM rules {_TOP} LIMIT 30)""",
        *_rules_ctes(),
    ),
)
def rule_kpis(spark, sf_dir):
    r = _flag_rules(spark, sf_dir)
    k = ar.rule_kpis(r, ar.top_rules(r, 30))
    return k.select(
        "rules_shown", "max_lift_shown", F.round("avg_confidence_shown", 6).alias("avg_confidence_shown"),
        "rules_total", "max_lift_total", F.round("avg_confidence_total", 6).alias("avg_confidence_total"),
    )


_co = " UNION ALL ".join(
    f"SELECT '{NAMES[i]}' AS item_a, '{NAMES[j]}' AS item_b, round(count(*) FILTER (WHERE {FLAGS[i]} = 1 AND {FLAGS[j]} = 1) / count(*), 6) AS support FROM survey"
    for i in range(len(FLAGS))
    for j in range(len(FLAGS))
)


@register("cooccurrence", with_survey(_co))
def cooccurrence(spark, sf_dir):
    c = ar.cooccurrence(survey(spark, sf_dir), TOOL_LABELS)
    return c.select("item_a", "item_b", F.round("support", 6).alias("support"))


@register(
    "bundle_top5",
    with_survey(f"SELECT antecedent, consequent, confidence, lift FROM (SELECT * FROM rules {_TOP} LIMIT 30) {_TOP} LIMIT 5", *_rules_ctes()),
)
def bundle_top5(spark, sf_dir):
    top30 = ar.top_rules(_flag_rules(spark, sf_dir).drop("ant", "con"), 30)
    return ar.top_rules(top30, 5).select("antecedent", "consequent", "confidence", "lift")


@register(
    "item_frequency",
    with_survey(
        "SELECT CAST(row_number() OVER (ORDER BY i.support DESC, l.label ASC) AS INTEGER) AS rank, l.label AS item, CAST(i.cnt AS BIGINT) AS count, "
        "round(i.support, 6) AS support FROM isup i JOIN lab l USING (itemset) WHERE i.size = 1",
        _isup_cte(),
        _labels_cte(" + ", "lab"),
    ),
)
def item_frequency(spark, sf_dir):
    s = ar.itemset_support(ar.mask_counts(survey(spark, sf_dir), FLAGS), NAMES)
    f = ar.item_frequency(s)
    return f.select("rank", "item", "count", F.round("support", 6).alias("support"))


@register(
    "fpgrowth_itemsets",
    with_survey(
        f"SELECT l.label AS items, i.size, CAST(i.cnt AS BIGINT) AS count, round(i.support, 6) AS support FROM isup i JOIN lab l USING (itemset) WHERE i.support >= {SUP}",
        _isup_cte(),
        _labels_cte(" + ", "lab"),
    ),
)
def fpgrowth_itemsets(spark, sf_dir):
    items = ar.fpgrowth_itemsets(ar.flag_baskets(survey(spark, sf_dir)), SUP, max_size=ar.MAX_SIZE)
    m = ar.itemsets_to_masks(items, NAMES, " + ")
    return m.select("items", "size", "count", F.round("support", 6).alias("support"))


@register("fpgrowth_rules", with_survey("SELECT * FROM rules", *_rules_ctes("+", "FP-Growth")))
def fpgrowth_rules(spark, sf_dir):
    return _fp_rules(spark, sf_dir).drop("ant", "con").withColumn("method", F.lit("FP-Growth"))


def _comparison_sql() -> str:
    parts = []
    for method in ("Apriori", "FP-Growth"):
        parts.append(
            f"SELECT '{method}' AS method, CAST(count(*) AS BIGINT) AS rules, round_even(max(lift), 3) AS max_lift, "
            "round_even(avg(confidence), 3) AS avg_confidence, round_even(avg(support), 3) AS avg_support FROM rules"
        )
    return with_survey(" UNION ALL ".join(parts), *_rules_ctes("+"))


@register("miner_comparison", _comparison_sql())
def miner_comparison(spark, sf_dir):
    return ar.miner_comparison({"Apriori": _flag_rules(spark, sf_dir, "+"), "FP-Growth": _fp_rules(spark, sf_dir, "+")})


RULE = ["antecedent", "consequent", "support", "confidence", "lift"]


@register("miner_difference", with_survey("SELECT 'Apriori' AS only_in, CAST(1 AS BIGINT) AS copies, * FROM (SELECT * FROM rules EXCEPT ALL SELECT * FROM rules)", *_rules_ctes("+")))
def miner_difference(spark, sf_dir):
    """Rules that only one of the two miners finds: none."""
    one, two = _flag_rules(spark, sf_dir, "+").select(*RULE), _fp_rules(spark, sf_dir, "+").select(*RULE)
    return ar.rule_difference(one, two, ("Apriori", "FP-Growth"))


_STRICT = 0.6


@register(
    "rules_lost_by_confidence",
    with_survey(f"SELECT 'at {CONF}' AS only_in, CAST(1 AS BIGINT) AS copies, * FROM rules WHERE confidence < {_STRICT}", *_rules_ctes()),
)
def rules_lost_by_confidence(spark, sf_dir):
    """The difference of two lists that do differ: rules at the usual confidence and at a stricter one."""
    s = survey(spark, sf_dir)
    one, two = (ar.mine_flag_rules(s, TOOL_LABELS, SUP, c).select(*RULE) for c in (CONF, _STRICT))
    return ar.rule_difference(one, two, (f"at {CONF}", f"at {_STRICT}"))


# ----------------------------------------------------------------------------- more flags than a word has bits
FIRST_YEAR, MONTHS = 1995, 80


def month_flags(spark, sf_dir):
    """A row per customer with an order: flag m is set if the customer ordered in month m."""
    o = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") - FIRST_YEAR) * 12 + F.month("o_orderdate") - 1
    return o.groupBy("o_custkey").agg(*[F.max((month == m).cast("int")).alias(f"m{m}") for m in range(MONTHS)])


MONTH_LABELS = {f"m{m}": f"{FIRST_YEAR + m // 12}-{m % 12 + 1:02d}" for m in range(MONTHS)}
_MONTH_CTES = (
    "WITH o AS (SELECT DISTINCT o_custkey AS c, strftime(o_orderdate, '%Y-%m') AS m FROM orders), n AS (SELECT count(DISTINCT c) AS n FROM o), f AS ("
    "SELECT m AS items, 1 AS size, count(*) AS cnt FROM o GROUP BY 1 UNION ALL "
    "SELECT a.m || ' + ' || b.m, 2, count(*) FROM o a JOIN o b ON a.c = b.c AND a.m < b.m GROUP BY 1)"
)
MONTH_SUP = 0.014


@register(
    "month_itemsets",
    f"{_MONTH_CTES} SELECT items, size, CAST(cnt AS BIGINT) AS count, round(cnt / n, 6) AS support FROM f, n WHERE cnt / n >= {MONTH_SUP}",
)
def month_itemsets(spark, sf_dir):
    """80 flags (months with an order): frequent sets of up to two months, masks as arrays of longs."""
    masks = ar.mask_counts(month_flags(spark, sf_dir), list(MONTH_LABELS))
    found = ar.wide_itemsets(masks, list(MONTH_LABELS.values()), MONTH_SUP, 2)
    return found.select("items", "size", "count", F.round("support", 6).alias("support"))


@register(
    "rules_top8",
    with_survey(
        " UNION ALL ".join(
            f"(SELECT '{m}' AS method, antecedent, consequent, lift, substr(antecedent, 1, 18) || '->' || substr(consequent, 1, 12) AS label FROM rules {_TOP} LIMIT 8)"
            for m in ("Apriori", "FP-Growth")
        ),
        *_rules_ctes("+"),
    ),
)
def rules_top8(spark, sf_dir):
    return ar.top_per_method({"Apriori": _flag_rules(spark, sf_dir, "+"), "FP-Growth": _fp_rules(spark, sf_dir, "+")}, 8)


# ----------------------------------------------------------------------------- many-item baskets
def _basket_sql(base_cte: str, min_sup: float) -> list[str]:
    return [
        base_cte,
        "bi AS (SELECT DISTINCT basket_id, item FROM (SELECT basket_id, unnest(items) AS item FROM bk))",
        "nb AS (SELECT count(*) AS n FROM bk WHERE items IS NOT NULL)",
        f"""fi AS (
  SELECT item AS items, 1 AS size, count(*) AS cnt FROM bi GROUP BY item
  UNION ALL SELECT a.item || ', ' || b.item, 2, count(*) FROM bi a JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY 1
  UNION ALL SELECT a.item || ', ' || b.item || ', ' || c.item, 3, count(*) FROM bi a
     JOIN bi b ON a.basket_id = b.basket_id AND a.item < b.item JOIN bi c ON c.basket_id = a.basket_id AND b.item < c.item GROUP BY 1)""",
        f"freq AS (SELECT items, size, cnt, cnt / (SELECT n FROM nb) AS support FROM fi WHERE cnt / (SELECT n FROM nb) >= {min_sup})",
    ]


_BRAND_BASE = (
    "bk AS (SELECT l_orderkey AS basket_id, list(DISTINCT p_brand) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"
)
_EVENT_BASE = "bk AS (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS basket_id, list(DISTINCT event_type) AS items FROM events GROUP BY user_id, CAST(ts AS DATE))"

_FREQ_SELECT = "SELECT items, size, CAST(cnt AS BIGINT) AS count, round(support, 6) AS support FROM freq"


def _basket_rules_sql(conf: float) -> str:
    return f"""
SELECT a.items AS antecedent, c.items AS consequent, round_even(s.support, 4) AS support,
       round_even(s.cnt / a.cnt, 4) AS confidence, round_even(s.cnt / a.cnt / c.support, 4) AS lift
FROM freq s
JOIN freq a ON a.size < s.size AND list_has_all(string_split(s.items, ', '), string_split(a.items, ', '))
JOIN freq c ON c.items = array_to_string(list_filter(string_split(s.items, ', '), lambda x: NOT list_contains(string_split(a.items, ', '), x)), ', ')
WHERE s.size >= 2 AND s.cnt / a.cnt >= {conf}"""


def _fp_itemsets_out(baskets, min_sup):
    f = ar.fpgrowth_itemsets(baskets, min_sup, max_size=ar.MAX_SIZE)
    return f.select(F.array_join("items", ", ").alias("items"), "size", "count", F.round("support", 6).alias("support"))


@register("brand_itemsets", "WITH " + ",\n".join(_basket_sql(_BRAND_BASE, BRAND_SUP)) + "\n" + _FREQ_SELECT)
def brand_itemsets(spark, sf_dir):
    return _fp_itemsets_out(basket_brand(spark, sf_dir), BRAND_SUP)


@register("brand_rules", "WITH " + ",\n".join(_basket_sql(_BRAND_BASE, BRAND_SUP)) + "\n" + _basket_rules_sql(BRAND_CONF))
def brand_rules(spark, sf_dir):
    return ar.basket_rules(basket_brand(spark, sf_dir), BRAND_SUP, BRAND_CONF)


@register("event_itemsets", "WITH " + ",\n".join(_basket_sql(_EVENT_BASE, EVENT_SUP)) + "\n" + _FREQ_SELECT)
def event_itemsets(spark, sf_dir):
    return _fp_itemsets_out(basket_event(spark, sf_dir), EVENT_SUP)


@register("event_rules", "WITH " + ",\n".join(_basket_sql(_EVENT_BASE, EVENT_SUP)) + "\n" + _basket_rules_sql(EVENT_CONF))
def event_rules(spark, sf_dir):
    return ar.basket_rules(basket_event(spark, sf_dir), EVENT_SUP, EVENT_CONF)

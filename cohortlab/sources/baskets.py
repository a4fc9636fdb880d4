"""Many-item market baskets for the FP-growth path.

``basket_brand``: distinct part brands per order (lineitem joined to part on the
part key — a shuffle join at scale, AQE may switch it to broadcast when part is
small).  ``collect_set`` per order is bounded by the lines of one order.
``basket_event``: distinct event types per (user, UTC day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.sources.tables import table


def basket_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy(F.col("l_orderkey").alias("basket_id"))
        .agg(F.array_sort(F.collect_set("p_brand")).alias("items"))
    )


def basket_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("items"))

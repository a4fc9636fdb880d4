"""Registry of named queries (callables ``(spark, sf_dir) -> DataFrame``) and their DuckDB oracles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from cohortlab.session import materialize
from cohortlab.sources.survey import survey_dirty, survey_view

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
#: Tables that the survey and its fits are derived from.
SOURCES = ("region", "nation", "customer", "orders", "lineitem")
_CACHES: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files of a folder's tables: another value as soon as the data changes."""
    jvm = spark._jvm
    found = []
    for t in SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            files = fs.listFiles(path, True)  # partition folders included
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]):
    """``build()`` once per session and state of the data.  The results live as long as the session object."""
    store = _CACHES.setdefault(spark, {})
    key = (sf_dir, fingerprint(spark, sf_dir), what)
    if key not in store:
        store[key] = build()
    return store[key]


def _has(spark: SparkSession, sf_dir: str, what: str) -> bool:
    return (sf_dir, fingerprint(spark, sf_dir), what) in _CACHES.get(spark, {})


def table_name(sf_dir: str, what: str) -> str:
    return f"{what}_{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}"


def use_materialized_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the survey view once under the shared checkpoint folder; later queries of this
    session read the written table (lineage cut, survives executor loss)."""
    return cached(spark, sf_dir, "survey", lambda: materialize(survey_view(spark, sf_dir), table_name(sf_dir, "survey")))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    if _has(spark, sf_dir, "survey"):
        return use_materialized_survey(spark, sf_dir)
    return survey_view(spark, sf_dir)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_dirty(spark, sf_dir, survey(spark, sf_dir))

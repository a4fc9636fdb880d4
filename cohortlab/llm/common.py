"""Shared helpers of the corpus operators: tables, scratch folder, words, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import ensure_checkpoint_dir, shuffle_partitions

#: Rows and bytes of an Arrow batch. Rows can be long; a Python task holds one batch at a time, the JVM a buffer of that size each way.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Bytes of a table (estimated) that a written file is worth.
FILE_BYTES = 64 << 20
#: Distinct words whose hashes a Python task keeps; beyond it the cache starts anew (nothing is lost but time).
WORD_CACHE = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python tasks on long texts (a session setting, left alone if already smaller)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and what one task held would stay with the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within it a side of a join is broadcast where its size as shuffled is small, never by the optimizer's estimate, which takes an
    exploded or well compressed table for far smaller than it is.  Plans run within it; a plan that is returned needs a hint of its own."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (planned, measured)}
    spark.conf.set(measured, before[measured] or spark.conf.get(planned))
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder; a run id keeps concurrent users apart."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than two a core, or than its size (as the optimizer estimates it) asks for.

    What is written or returned has a file for each partition, and small tables would come in as many files as there are shuffle
    partitions; creating, listing and opening them costs more than their rows.  A plan that has fewer partitions stays as it is.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(2 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)), 1 << 30))


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: lineage ends here and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    few_files(df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def spread_pairs(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of numbers of blocks, dealt over all tasks pair by pair (the last number of a sequence is one too many and finds no block)."""
    return pairs.repartition(shuffle_partitions(pairs.sparkSession), *columns)


def discard(df: DataFrame | None) -> None:
    """Delete a table written by ``save`` that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text as UTF-8 bytes; ``lower`` lower-cases A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """64-bit hash of each word, computed once while the word stays in the cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (so that sums of products become independent-looking hashes)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (empty when there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = mix(acc + h[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return acc


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every node of ``edges(src long, dst long)``: the smallest id that links reach.

    Alternating large-star and small-star steps on the edge table; every step is a grouped minimum (partial
    aggregation takes the load off hot nodes) and a join that adaptive execution can split.  Each round is written
    to the shared folder, so lineage stays short.  The number of rounds grows with the logarithm of the
    longest chain; if ``max_rounds`` does not do, the function raises rather than return half a result.
    """
    e = save(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "cc",
    )
    before = None
    for _ in range(max_rounds):
        # large star: every neighbour above u goes to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u")
        small = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hop.select("u", F.col("m").alias("v")))
        nxt = save(small.where("u <> v").distinct(), "cc")
        state = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        discard(e)
        e, now = nxt, (state["n"], state["s"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).groupBy("id").agg(F.min("component").alias("component"))

"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by the order of (id, checksum, size) with two passes - a range partitioning, then the prefix sum of the
partitions' counts (one row per partition).  Row number r goes to position p = permute(r, n); its shard is ``p mod shards``, its slot
``p div shards``.  So shards differ by one row at most, slots have no gap, and shard and slot of a row number - and the row number
behind a shard and slot - are computable without the table.  The result does not depend on files or partitions.

Null ids come first in the order; a null text has size 16 and the checksum of the empty string.  Rows that repeat are rows of their own
(they take neighbouring numbers; which of them takes which does not show in the result).  An empty table gives no row.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.broadcast import broadcast_if_small
from cohortlab.llm.common import mix, save
from cohortlab.session import shuffle_partitions

SHARDS, SEED, ROUNDS = 40, 20240229, 6


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _half_bits(n: int) -> int:
    """Half the bits of the smallest even-bit domain that holds ``n`` values (fewer than four times as many)."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 at ``rows`` (or its inverse); values that leave the range walk on along their cycle."""
    half = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed)[::-1] if inverse else _keys(seed)
    out = np.array(rows, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            if inverse:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number behind a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def _number(batches):
    before = 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(before, before + n, dtype=np.int64))], names=["doc_id", "size", "text_crc32", "part", "before"])
        before += n


def _place(batches, n: int, shards: int, seed: int):
    for batch in batches:
        p = permute(batch.column(3).to_numpy(zero_copy_only=False), n, seed)
        cols = [pa.array((p % shards).astype(np.int32)), pa.array(p // shards)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["doc_id", "size", "text_crc32", "shard", "slot"])


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row (law ``rows``)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("any"),  # deals rows that repeat over several ranges
    )
    order = ["doc_id", "text_crc32", "size", "any"]
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # the partition's number comes from the plan: a task that writes several partitions numbers each by itself
    dealt = dealt.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"))
    numbered = save(dealt.mapInArrow(_number, "doc_id long, size long, text_crc32 long, part int, before long"), "shard-rows")
    totals = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    n = totals.agg(F.sum("n")).first()[0] or 0
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = numbered.join(broadcast_if_small(offsets), "part").select("doc_id", "size", "text_crc32", (F.col("base") + F.col("before")).alias("row"))
    out = placed.mapInArrow(partial(_place, n=n, shards=shards, seed=seed), "doc_id long, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

r"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact verification.

1. Words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; the set of a document is its distinct 5-word shingles.  One pass
   turns every document into (size of the set, 128-bit key of the set, SetSketch).  Register i of a SetSketch is the
   truncated exponentially spaced minimum ``clip(floor(1 - log_b(min h_i)), 0, q + 1)`` with ``h_i ~ Exp(a)``; merging two
   sketches is the element-wise maximum, so sketches of parts of a text combine.
2. Documents with equal sets form a class, represented by the smallest id; only classes go on.
3. Bands of registers are bucket keys.  With 32 bands of 4 registers a pair at the threshold 0.75 shares a bucket with
   probability 1 - (1 - 0.75^4)^32 > 0.999994.
4. Candidates never multiply within a bucket: first every class is held against the smallest class it shares a bucket
   with, then - only where a bucket still spans several components - against pivots of the bucket, at last the
   remaining pairs of *different components* within blocks of bounded size; there pairs stay in the task and only links
   leave it.  A pair of one component need not be tested: it cannot change the components.  So no link that could
   join two components is left out.
5. Each candidate is estimated jointly by maximum likelihood over (greater, smaller, equal) registers given both set sizes;
   pairs far below the threshold go, the others are verified on the full sets: ``100 * |A & B| >= 75 * |A | B|``.
6. Components over the links by large-star/small-star steps.

Nulls, empties and ties.  A null or empty text (or one of white space only) has the empty set: it is linked with
nothing.  A row whose id is null has no component (null) and is kept.  Rows that repeat an id are one node: they get the same
component.  Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import WordHashes, connected_components, give_back, measured_broadcasts, mix, save, small_batches, split_words, spread_pairs, window_hashes

BASE, RATE, TOP = 1.001, 20.0, 65535  # SetSketch parameters b, a and q + 1 (two bytes a register)
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: Standard deviation of the estimate at 0.75 is sqrt(0.75 * 0.25 / 128) = 0.038; the filter stands 5 of them lower.
FILTER = 0.75 - 5 * 0.0383
#: Equal registers below which a pair is not estimated at all (at 0.75 their number is 96 with standard deviation 4.9).
LEAST_EQUAL = 57
#: Shingles sketched at once (bounds the memory of a task; long texts are sketched in parts and merged).
PART = 1 << 16
#: Members, and shingles of all members, in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 256, 100_000

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingle_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer than ``k`` words the whole sequence is one shingle."""
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(words) < k:
        return mix(window_hashes(h, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(h, k))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Per non-empty set and register the smallest hash (n x REGISTERS)."""
    out = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    todo: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if not todo:
            return
        who = np.array([i for i, _ in todo])
        values = np.concatenate([x for _, x in todo])
        starts = np.cumsum([0] + [len(x) for _, x in todo[:-1]])
        for r in range(REGISTERS):
            v = values * _MULTIPLIERS[r] + _OFFSETS[r]
            v ^= v >> np.uint64(29)
            low = np.minimum.reduceat(v, starts)
            np.minimum.at(out[:, r], who, low)  # parts of one set merge here

    for i, s in enumerate(sets):
        for at in range(0, len(s), PART):
            todo.append((i, s[at : at + PART]))
            size += len(todo[-1][1])
            if size >= PART:
                flush()
                todo, size = [], 0
    flush()
    return out


def registers(low: np.ndarray) -> np.ndarray:
    """SetSketch registers from the smallest hashes."""
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(">u2")


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketch rows given the set sizes."""
    up, down = (ka > kb).sum(1), (ka < kb).sum(1)
    same = ka.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return up * np.log(a) + down * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave: ternary search
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(a) < likelihood(b)
        lo, hi = np.where(left, a, lo), np.where(left, hi, b)
    return (lo + hi) / 2


def _sketches(batches):
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes) for t in batch.column(1).to_pylist()]
        regs = registers(minima(sets))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([regs[i].tobytes() if len(s) else None for i, s in enumerate(sets)], pa.binary()),
            ],
            names=["id", "n", "set_key", "sketch"],
        )
    del hashes
    give_back()


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n (set size), set_key, sketch`` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sketches, "id long, n long, set_key binary, sketch binary")


def _sets(batches):
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
        at = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
        flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), flat)], names=["id", "shingles"])
    del hashes
    give_back()


def _likely(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        ka, kb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS).astype(np.uint16) for c in ("ka", "kb"))
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
        ok = pa.array(estimate(ka, kb, na, nb) >= FILTER)
        yield batch.select(["a", "b", "na", "nb"]).filter(ok)


def _side(row: dict, name: str) -> tuple:
    side = row[name]
    return (
        np.array([x["id"] for x in side]),
        np.array([x["component"] for x in side]),
        np.array([x["n"] for x in side], float),
        np.frombuffer(b"".join(x["sketch"] for x in side), ">u2").reshape(-1, REGISTERS).astype(np.uint16),
        [frozenset(x["shingles"]) for x in side],
    )


def _block_links(batches, num: int, den: int):
    """Links between components across two blocks of a bucket (or within one): likelihood filter, then the full sets.

    A pair that several buckets hold is taken in the one of its first common band.  Pairs stay in the task, and once a link has
    joined two components no further pair of them is looked at; so at most as many links leave as there are members.
    """
    for batch in batches:
        found: list[tuple[int, int]] = []
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            ia, ca, na, ka, sa = left = _side(row, "left")
            same_block = row["right"] is None
            ib, cb, nb, kb, sb = left if same_block else _side(row, "right")
            root: dict[int, int] = {}

            def find(c: int, root: dict[int, int] = root) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            apart = ca[:, None] != cb[None, :]
            if same_block:
                apart &= ia[:, None] < ib[None, :]
            apart &= den * np.minimum(na[:, None], nb[None, :]) >= num * np.maximum(na[:, None], nb[None, :])
            at, to = np.nonzero(apart)
            for some in range(0, len(at), 1 << 15):
                x, y = at[some : some + (1 << 15)], to[some : some + (1 << 15)]
                same = ka[x] == kb[y]
                likely = np.flatnonzero(same.sum(1) >= LEAST_EQUAL)
                x, y, same = x[likely], y[likely], same[likely]
                first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == row["band"]
                x, y = x[first], y[first]
                ok = estimate(ka[x], kb[y], na[x], nb[y]) >= FILTER
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    u, v = find(int(ca[i])), find(int(cb[j]))
                    if u == v:
                        continue
                    common = len(sa[i] & sb[j])
                    if den * common >= num * (len(sa[i]) + len(sb[j]) - common):
                        root[max(u, v)] = min(u, v)
                        found.append((int(ia[i]), int(ib[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["src", "dst"])


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``src, dst`` among candidate pairs ``a < b``: likelihood filter, then the full sets."""

    def of(side: str) -> DataFrame:
        return classes.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"k{side}"))

    likely = pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_likely, "a long, b long, na long, nb long")
    full = likely.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"
    )
    both = full.select("a", "b", (F.col("na") + F.col("nb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(f"{den} * common >= {num} * (total - common)").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` (similarity at least ``num / den``)."""
    spark = docs.sparkSession
    with measured_broadcasts(spark):
        base = save(sketch_documents(docs, id_col, text_col), "dedup-sketch")
        known = base.where("id is not null")
        classes = save(
            known.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
            "dedup-classes",
        )
        band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
        keys = classes.select("rep", "n", "sketch", band.alias("band")).select(
            "rep", "n", "band", F.expr(f"xxhash64(band, substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS}))").alias("bucket")
        )
        buckets = keys.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
        members = save(keys.join(buckets, "bucket").select("bucket", "band", "rep", "n", "pivot", "size"), "dedup-members")
        needed = members.select("rep").distinct()
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
        texts = rows.join(needed.withColumnRenamed("rep", "id"), "id", "left_semi")
        sets = save(texts.mapInArrow(_sets, "id long, shingles array<long>").dropDuplicates(["id"]), "dedup-sets")

        # a) every class against the smallest class of its buckets: one pair each
        tested = save(members.where("pivot < rep").groupBy("rep").agg(F.min("pivot").alias("a")).select("a", F.col("rep").alias("b")), "dedup-pairs")
        links = save(_verified(tested, classes, sets, num, den), "dedup-links")
        labels = save(connected_components(links), "dedup-labels")

        # b) where a bucket spans several components: members against two pivots of the bucket that are in another one
        def open_members(least: int) -> tuple[DataFrame, DataFrame]:
            now = members.where(F.col("size") >= least).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
            now = now.select("bucket", "band", "rep", "n", "size", F.coalesce("component", "rep").alias("component"))
            return now, now.groupBy("bucket").agg(
                F.min_by(F.struct("rep", "component"), "rep").alias("p0"),
                F.min_by(F.struct("rep", "component"), F.xxhash64("rep")).alias("p1"),
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.sum("n").alias("weight"),
            ).where("low < high")

        now, open_ = open_members(2)
        pivots = now.join(open_, "bucket").select("rep", "component", F.explode(F.array("p0", "p1")).alias("p"))
        pairs = pivots.where("p.component <> component").select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"))
        pairs = save(pairs.join(tested, ["a", "b"], "left_anti").distinct(), "dedup-pairs")
        found = save(_verified(pairs, classes, sets, num, den), "dedup-links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = save(connected_components(links), "dedup-labels")

        # c) what is left: pairs of different components, block by block, with the full sets
        now, open_ = open_members(3)
        rest = now.join(open_.select("bucket", "weight"), "bucket")
        rest = rest.join(classes.select("rep", "sketch"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
        number = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("long")
        rest = rest.withColumn("blocks", number).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")))
        member = F.struct(F.col("rep").alias("id"), "component", "n", "sketch", "shingles")
        blocks = save(rest.groupBy("bucket", "band", "blocks", "block").agg(F.collect_list(member).alias("left")), "dedup-blocks")
        several = blocks.where("blocks > 1")
        # pairs of block numbers first, each dealt out by itself: the pairs of one bucket are work for many tasks
        pairs = several.select("bucket", "band", "block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks"))).alias("block2"))
        other = several.select("bucket", "band", F.col("block").alias("block2"), F.col("left").alias("right"))
        between = spread_pairs(pairs, ["bucket", "block", "block2"]).join(several.select("bucket", "band", "block", "left"), ["bucket", "band", "block"])
        between = between.join(other, ["bucket", "band", "block2"]).select("band", "left", "right")
        within = blocks.select("band", "left").withColumn("right", F.lit(None).cast(between.schema["right"].dataType))
        found = save(within.unionByName(between).mapInArrow(partial(_block_links, num=num, den=den), "src long, dst long"), "dedup-links")
        if not found.isEmpty():
            labels = save(connected_components(links.unionByName(found)), "dedup-labels")

    # of no bounded size on either side, and run by the caller: no broadcast by an estimate
    doc_class = known.where("n > 0").select("id", "set_key").join(classes.select("set_key", "rep").hint("merge"), "set_key").select("id", "rep").distinct()
    per_class = classes.select("rep").join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep").where("component < rep")
    moved = doc_class.where("id <> rep").unionByName(per_class.select(F.col("rep").alias("id"), "rep")).distinct()
    moved = moved.join(per_class.hint("merge"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return base.select("id", "n").join(moved.hint("merge"), "id", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )

"""Least-squares gradient boosting: from the mean of the label, every tree fitted to the residuals and shrunk alike.

Features are cut into bins once (at the midpoints of their values, or at quantiles where there are more than ``max_bins``), and a narrow
table of bins and residuals is written, in blocks of ``BLOCK`` rows that hold a byte per row and feature, feature by feature, so that a pass
works on whole columns.  A level of a tree is one pass: every task adds up count and residual by node, feature and bin,
Spark adds up the tasks' sums, and the driver gets nodes x features x bins numbers, however many rows there are.  The leaves' values follow from
the last level's sums, so a tree of depth d is d passes.  Residuals are those of the written table less the trees since; after
``every`` trees they are written anew, which cuts lineage and bounds the work of a pass.

Ties go to the first feature and the lowest cut.  Missing features count as 0.  Rows without a label take no part in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialize

MAX_BINS, EVERY = 64, 10
#: Rows a task of a pass is worth at least; numbers of the tasks' sums that the driver adds up itself (else Spark does).
TASK_ROWS, DRIVER_SUMS = 20_000, 1_000_000
#: Rows of a block at most.
BLOCK = 16_384


@dataclass
class Tree:
    """A complete binary tree: node i has children 2i + 1 and 2i + 2; rows with feature <= cut go left."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Place of the leaf of each row; ``x`` is features x rows."""
        at = np.zeros(x.shape[1], np.uint8 if len(self.feature) < 256 else np.int64)
        first, width = 0, 1
        while first < len(self.feature):
            right = np.zeros(len(at), bool)
            for i in range(width):
                f = int(self.feature[first + i])
                if f >= 0:
                    above = x[f] > cuts[first + i].item()
                    right |= above if width == 1 else above & (at == i)
            at = 2 * at + right
            first, width = first + width, 2 * width
        return at


@dataclass
class Boosted:
    mean: float
    rate: float
    trees: list[Tree] = field(default_factory=list)
    #: Sum of squared residuals before each tree and after the last.
    losses: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows x features."""
        out = np.full(len(x), self.mean)
        for begin in range(0, len(x), BLOCK):
            columns, part = np.ascontiguousarray(x[begin : begin + BLOCK].T), out[begin : begin + BLOCK]
            for t in self.trees:
                part += self.rate * t.value[t.leaf(columns, t.cut)]
        return out


def _numbers(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for f in features]


def cut_points(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """For each feature its cuts, ascending: midpoints of all values if there are ``max_bins`` at most, else approximate quantiles."""
    wide = df.select(*[c.alias(f"f{i}") for i, c in enumerate(_numbers(features))])
    fractions = [i / max_bins for i in range(1, max_bins)]
    about = wide.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in wide.columns]).first()
    few = [c for c in wide.columns if about[c] <= 1.3 * max_bins]
    values: dict[str, list[float]] = {c: [] for c in few}
    if few:  # at most about 1.5 x max_bins values each
        for r in wide.unpivot([], few, "c", "v").distinct().collect():
            values[r["c"]].append(r["v"])
    many = [c for c in wide.columns if c not in values or len(values[c]) > max_bins]
    row = wide.agg(*[F.percentile_approx(c, fractions, 10_000).alias(c) for c in many]).first() if many else {}
    out = []
    for c in wide.columns:
        known = sorted(values.get(c, []))
        if c not in many:
            out.append(np.array([a + (b - a) / 2 for a, b in zip(known, known[1:], strict=False)]))
        else:
            out.append(np.unique(np.array(row[c] or [], float)))
    return out


def _rows(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.Table]:
    """The rows of the batches, ``most`` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= most:
            yield pa.Table.from_batches([*held, batch.slice(0, most - n)])
            batch, held, n = batch.slice(most - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _block(bins: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary())], names=["bins", "r"])


def _to_bins(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], mean: float) -> Iterator[pa.RecordBatch]:
    for rows in _rows(batches):
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column(0).chunks]).reshape(rows.num_rows, len(cuts))
        bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8)
        yield _block(bins, rows.column(1).to_numpy() - mean)


def _unpack(batch: pa.RecordBatch, p: int, trees: list[Tree], rate: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins (features x rows) and residuals of each block."""
    for bins, r in zip(batch.column(0), batch.column(1), strict=True):
        x, r = np.frombuffer(bins.as_buffer(), np.uint8).reshape(p, -1), np.frombuffer(r.as_buffer()).copy()
        for t in trees:
            r -= (rate * t.value)[t.leaf(x, t.bin)]
        yield x, r


def _level(batches: Iterator[pa.RecordBatch], p: int, bins: int, trees: list[Tree], rate: float, top: Tree) -> Iterator[pa.RecordBatch]:
    """Count, sum of residuals (and of their squares, as the last row) by node, feature and bin."""
    nodes = len(top.feature) + 1  # of the level below the split nodes
    count, total, square = np.zeros((p, nodes * bins)), np.zeros((p, nodes * bins)), 0.0
    for batch in batches:
        for x, r in _unpack(batch, p, trees, rate):
            square += float(r @ r)
            first = top.leaf(x, top.bin).astype(np.intp) * bins
            for j in range(p):
                place = first + x[j]
                count[j] += np.bincount(place, minlength=nodes * bins)
                total[j] += np.bincount(place, r, minlength=nodes * bins)
    by_node = [np.append(m.reshape(p, nodes, bins).transpose(1, 0, 2), last) for m, last in ((count, 0.0), (total, square))]
    kept = np.flatnonzero((by_node[0] > 0) | (by_node[1] != 0))
    if len(kept):
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), *[pa.array(m[kept]) for m in by_node]], names=["place", "n", "s"])


def _residuals(batches: Iterator[pa.RecordBatch], p: int, trees: list[Tree], rate: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, r in _unpack(batch, p, trees, rate):
            yield _block(x, r)


def best_splits(n: np.ndarray, s: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the feature (-1: none) and bin of the best split, and sums ``(nodes, 2 sides, 2)`` of count and residual."""
    nodes = len(n)
    feature, bin_, sides = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((nodes, 2, 2))
    for v in range(nodes):
        count, total = n[v, 0].sum(), s[v, 0].sum()
        sides[v, 0] = count, total
        if count < 2:
            continue
        left_n, left_s = np.cumsum(n[v], 1)[:, :-1], np.cumsum(s[v], 1)[:, :-1]
        right_n, right_s = count - left_n, total - left_s
        ok = (left_n > 0) & (right_n > 0)
        for j, c in enumerate(cuts):
            ok[j, len(c) :] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left_s**2 / left_n + right_s**2 / right_n - total**2 / count, -np.inf)
        most = gain.max()
        if not most > 1e-12 * max(1.0, total**2 / count):
            continue
        j, b = np.argwhere(gain >= most - 1e-9 * abs(most))[0]  # sums of doubles differ in their last bits from run to run
        feature[v], bin_[v] = j, b
        sides[v] = (left_n[j, b], left_s[j, b]), (right_n[j, b], right_s[j, b])
    return feature, bin_, sides


def fit_boosting(
    train: DataFrame, features: Sequence[str], label: str, n_trees: int = 100, learning_rate: float = 0.1, max_depth: int = 3, max_bins: int = MAX_BINS, every: int = EVERY
) -> Boosted:
    """Boosted regression trees: mean + learning_rate * sum of trees."""
    if not 2 <= max_bins <= 256:
        raise ValueError("2 to 256 bins")
    known = train.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    spark, p = train.sparkSession, len(features)
    narrow = materialize(known.select(F.array(*_numbers(features)).alias("x"), F.col(label).cast("double").alias("y")), "boosting_input")
    stats = narrow.agg(F.avg("y").alias("mean"), F.count("y").alias("n")).first()
    if not stats["n"]:
        raise ValueError("no labelled rows")
    mean = float(stats["mean"])
    # small tables in few tasks (a pass is mostly start-up there), large ones over all cores in tasks of bounded size
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-stats["n"] // TASK_ROWS)), -(-stats["n"] // (50 * TASK_ROWS)))
    cuts = cut_points(narrow.select(*[F.col("x")[i].alias(f) for i, f in enumerate(features)]), features, max_bins)
    bins = max([len(c) for c in cuts], default=0) + 1
    # dealt out as blocks: a byte per row and feature moves, not a double
    binned = narrow.mapInArrow(partial(_to_bins, cuts=cuts, mean=mean), "bins binary, r binary").repartition(tasks)
    data = materialize(binned, "boosting_bins")
    model = Boosted(mean, learning_rate)
    since: list[Tree] = []

    def sums(top: Tree) -> tuple[np.ndarray, np.ndarray, float]:
        nodes = len(top.feature) + 1
        step = partial(_level, p=p, bins=bins, trees=since, rate=learning_rate, top=top)
        found = data.mapInArrow(step, "place long, n double, s double")
        n, s = np.zeros(nodes * p * bins + 1), np.zeros(nodes * p * bins + 1)
        if tasks * len(n) > DRIVER_SUMS:
            found = found.groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        sums_ = found.toArrow()
        place = sums_.column("place").to_numpy()
        np.add.at(n, place, sums_.column("n").to_numpy())
        np.add.at(s, place, sums_.column("s").to_numpy())
        return n[:-1].reshape(nodes, p, bins), s[:-1].reshape(nodes, p, bins), float(s[-1])

    def empty() -> Tree:
        return Tree(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))

    for _ in range(n_trees):
        tree, sides = empty(), np.zeros((1, 2, 2))
        for level in range(max_depth):
            n, s, square = sums(tree)
            if level == 0:
                model.losses.append(square)
            feature, bin_, sides = best_splits(n, s, cuts)
            cut = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature, bin_, strict=True)])
            tree = Tree(np.r_[tree.feature, feature], np.r_[tree.bin, bin_], np.r_[tree.cut, cut], tree.value)
        leaves = sides.reshape(-1, 2)
        tree.value = np.where(leaves[:, 0] > 0, leaves[:, 1] / np.maximum(leaves[:, 0], 1), 0.0)
        model.trees.append(tree)
        since.append(tree)
        if len(since) == every:
            data = materialize(data.mapInArrow(partial(_residuals, p=p, trees=since, rate=learning_rate), "bins binary, r binary"), "boosting_bins")
            since = []
    model.losses.append(sums(empty())[2])
    return model


def predict_boosting(model: Boosted, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    @F.arrow_udf("double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(model.predict(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)), pa.float64())

    return df.select(*keep, predict(F.array(*_numbers(features))).alias("prediction"))

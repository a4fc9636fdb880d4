"""Quality by pairwise ranking (Bradley-Terry).

A document's quality is w . x of its features x; that of two labelled documents one is preferred has probability
1 / (1 + exp(-w . (x_good - x_bad))).  ``fit`` pairs documents of either label, learns w from the pairs by logistic loss on the feature
differences (Newton steps, ridge) and sets the threshold at the quantile of the labelled documents' scores that leaves the fewest of them on the
wrong side.  The distance from the threshold becomes a probability by a slope, also fitted; 0.5 is the threshold itself.

Features look at the form of a text only: its length, shares of capitals, digits, marks, symbols and bars, words that end in
several signs, words that repeat at once or nearby, distinct words, lines that repeat, length of words.  Shares go in as such and as
their square roots, so that a small share of junk counts as well as a large one.

The fit takes every labelled document that is not held out, each in ``PAIRS`` pairs or a few more.  Features are computed where the texts are and
joined to the labels (texts do not move); feature vectors and differences are written in chunks of ``CHUNK`` rows, and a Newton step, a step of the
slope or a moment is one pass that sends a sum per chunk to the driver, which adds them up in the order of the chunks (so the partitioning
changes no bit).  The threshold comes from running counts over the sorted strengths, a range of them to a task.  Scoring covers every row,
reads each text once and needs no shuffle.

Null and empty texts have the features of no word and are scored.  Null labels do not take part in the fit; of labels of one id
that contradict each other the larger holds; of several texts of one labelled id the one with the smallest features.  A null id is held out and scored.  Rows
that repeat score alike.  An empty table gives no row; without labels of both kinds every score is the share of label 1
(0 without labels).  Columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import small_batches
from cohortlab.session import materialize

PAIRS, RIDGE = 4, 1e-3
#: Rows whose vectors are held together.
CHUNK = 16_384
#: Words that are looked at together for repetition nearby.
NEARBY = 64

_SYMBOLS, _MARKS, _STOPS = b"#*$%&<>@^~=+{}[]\\_", b"!?", b".,;:'\"()-"
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(_SYMBOLS + _MARKS + _STOPS + b"|")] = True
SHARES = ("capitals", "digits", "symbols", "bangs", "marks", "stops", "bars", "beyond_ascii", "several_signs", "lone_signs", "repeats", "second_repeats", "distinct_nearby", "repeated_lines")
FEATURES = ("words", "word_length", "line_length", *SHARES, *(f"root_{s}" for s in SHARES))


def features(raw: bytes) -> list[float]:
    """Features of a UTF-8 text."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(raw, np.uint8)
    count = np.bincount(codes, minlength=256)
    chars = int(count.sum() - count[_SPACE].sum())
    sign = _SIGN[codes]
    ends = np.r_[_SPACE[codes[1:]], True] & ~_SPACE[codes]  # last byte of each word
    several = int((ends[1:] & sign[1:] & sign[:-1]).sum())
    lone = int((ends & sign & np.r_[True, _SPACE[codes[:-1]]]).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nearby = sum(len(set(words[i : i + NEARBY])) for i in range(0, n, NEARBY))
    shares = [
        count[65:91].sum() / chars,
        count[48:58].sum() / chars,
        count[list(_SYMBOLS)].sum() / chars,
        count[33] / chars,
        count[63] / chars,
        count[list(_STOPS)].sum() / chars,
        count[124] / chars,
        count[128:].sum() / chars,
        several / n,
        lone / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        nearby / n,
        1 - len(set(lines)) / len(lines),
    ]
    return [float(np.log1p(n)), chars / n, float(np.log1p(n / len(lines))), *map(float, shares), *map(float, np.sqrt(shares))]


@dataclass
class Ranking:
    """``weights`` on standardized features; a document is kept from ``threshold`` on."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray | None = None
    threshold: float = 0.0
    slope: float = 1.0
    share: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.threshold), -30, 30)))


def preference_pairs(good: int, bad: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the better and the worse one of each pair: every document of the larger class in ``pairs`` pairs, with as many partners."""
    most, least = max(good, bad), min(good, bad)
    one = np.tile(np.arange(most), pairs)
    other = (one + np.repeat(np.arange(pairs), most) * max(1, least // pairs)) % least
    return (one, other) if good >= bad else (other, one)


def pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over pairs at weights ``w``: the loss, its gradient and its Hessian, in one row."""
    wrong = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # probability of the wrong order
    return np.concatenate([[np.logaddexp(0, -d @ w).sum()], -(d * wrong[:, None]).sum(0), ((d * (wrong * (1 - wrong))[:, None]).T @ d).ravel()])


def newton(sums: Callable[[list[np.ndarray]], list[np.ndarray]], n: int, k: int, ridge: float = RIDGE, rounds: int = 60) -> np.ndarray:
    """Weights that minimize the mean loss plus the ridge, by damped Newton steps; ``sums`` gives ``pair_sums`` at several weights in one pass."""

    def at(weights: list[np.ndarray]) -> list[tuple]:
        return [(w, float(s[0] / n + ridge / 2 * w @ w), s[1 : k + 1] / n + ridge * w, s[k + 1 :].reshape(k, k) / n + ridge * np.eye(k)) for w, s in zip(weights, sums(weights), strict=True)]

    ((w, now, gradient, hessian),) = at([np.zeros(k)])
    halves = [2.0**-i for i in range(20)]
    for _ in range(rounds):
        step = np.linalg.solve(hessian, gradient)
        better = [x for x in at([w - step]) if x[1] <= now] or [x for x in at([w - h * step for h in halves[1:]]) if x[1] <= now]
        if not better:
            break
        gain = now - better[0][1]
        w, now, gradient, hessian = better[0]
        if gain < 1e-12:
            break
    return w


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> np.ndarray:
    """Weights that minimize the mean of log(1 + exp(-d . w)) plus the ridge."""
    n, k = differences.shape
    return newton(lambda ws: [pair_sums(differences, w) for w in ws], n, k, ridge, rounds)


def threshold_of(strengths: np.ndarray, labels: np.ndarray) -> float:
    """Quantile of the strengths that leaves the fewest labels on the wrong side (ties: the widest gap, then the lowest)."""
    order = np.argsort(strengths, kind="stable")
    s, y = strengths[order], labels[order]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]  # threshold below s[i]
    gap = np.r_[0.0, np.diff(s), 0.0]
    wrong = np.where(gap > 0, wrong, len(y) + 1)  # only between two different strengths
    if wrong.min() > len(y):
        return float(s[0])
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[np.argmax(gap[best])])
    return float((s[i - 1] + s[i]) / 2)


def slope_sums(x: np.ndarray, labels: np.ndarray, a: float) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(a * x, -30, 30)))
    return np.array([(x * (labels - p)).sum(), (p * (1 - p) * x * x).sum()])


def slope_by(sums: Callable[[float], np.ndarray], scale: float) -> float:
    """Slope of a logistic curve through one half at distance 0; ``sums`` gives ``slope_sums`` of distances in units of ``scale``."""
    a = 1.0
    for _ in range(50):
        first, second = sums(a)
        step = (first - 1e-2 * a) / (second + 1e-2)
        a = min(max(a + step, a / 4), 4 * a)
        if abs(step) < 1e-9:
            break
    return a / scale


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([features(texts[i].as_py() or b"") for i in range(batch.num_rows)], pa.list_(pa.float64()))], names=["doc_id", "features"]
        )


def _chunked(rows: DataFrame, place: Column, name: str) -> DataFrame:
    """Vectors ``x`` written as matrices of ``CHUNK`` rows in the order of ``at``: ``kind, chunk, x``."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        x = np.concatenate([c.flatten().to_numpy() for c in table.column("x").chunks])
        return pa.table({"kind": [key[0].as_py()], "chunk": [key[1].as_py()], "x": pa.array([x.tobytes()], pa.binary())})

    keyed = rows.select("kind", F.floor(place / CHUNK).cast("long").alias("chunk"), place.alias("at"), "x")
    return materialize(keyed.groupBy("kind", "chunk").applyInArrow(pack, "kind long, chunk long, x binary"), name)


def _summed(chunks: DataFrame, of: Callable[[int, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all chunks of the arrays that ``of`` makes of one, in the order of the chunks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, chunk, x in zip(*[batch.column(i) for i in range(3)], strict=True):
                made = of(kind.as_py(), np.frombuffer(x.as_buffer()).reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (kind.as_py(), chunk.as_py())] + [pa.array([[m.tolist() for m in made]])], names=["kind", "chunk", "sums"])

    found = chunks.mapInArrow(each, "kind long, chunk long, sums array<array<double>>").collect()
    found.sort(key=lambda r: (r[0], r[1]))
    return [sum((np.array(r[2][i]) for r in found[1:]), np.array(found[0][2][i])) for i in range(len(found[0][2]))]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` in the order of kind, CRC and id with ``at``, the place within the kind."""
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    place = F.monotonically_increasing_id()
    cut = F.col("place")
    ranked = rows.select("*", order.alias("crc")).sort("kind", "crc", "doc_id").select("kind", "x", place.alias("place"))
    ranked = materialize(ranked.select("kind", "x", F.shiftright(cut, 33).alias("part"), cut.bitwiseAND(F.lit((1 << 33) - 1)).alias("within")), "ranking_rows")
    firsts = ranked.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"), F.min("within").alias("first"))
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = firsts.select("kind", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition
    return ranked.join(F.broadcast(start), ["kind", "part"]).select("kind", "x", (F.col("within") - F.col("first") + F.col("before")).alias("at"))


def _pairs(numbered: DataFrame, good: int, bad: int, pairs: int = PAIRS) -> DataFrame:
    """Differences of ``preference_pairs``: ``kind`` (0), ``at`` (number of the pair), ``x``."""
    most, least, larger = max(good, bad), min(good, bad), int(good >= bad)
    one = numbered.where(F.col("kind") == larger).select("at", F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("j"))
    one = one.select("a", (F.col("j") * F.lit(most) + F.col("at")).alias("at"), ((F.col("at") + F.col("j") * F.lit(max(1, least // pairs))) % least).alias("other"))
    other = numbered.where(F.col("kind") == 1 - larger).select(F.col("at").alias("other"), F.col("x").alias("b"))
    sign = F.lit(1.0 if larger else -1.0)
    return one.join(other, "other").select(F.lit(0).alias("kind"), "at", F.zip_with("a", "b", lambda a, b: (a - b) * sign).alias("x"))


def _threshold(strengths: DataFrame) -> float:
    """``threshold_of`` of a table ``s, y``: running counts by ranges of the sorted strengths."""
    counts = strengths.groupBy("s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    ranges = materialize(counts.sort("s").withColumn("part", F.spark_partition_id()), "ranking_strengths")
    parts = ranges.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("part").collect()
    above, below, last, starts = sum(p["bad"] for p in parts), 0.0, None, {}
    for p in parts:  # good ones below, bad ones from here on, the strength before
        starts[p["part"]] = (below, above, last)
        below, above, last = below + p["good"], above - p["bad"], p["high"]

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        s, good, bad = (table.column(c).to_numpy() for c in ("s", "good", "bad"))
        below, above, last = starts[table.column("part")[0].as_py()]
        wrong = below + np.cumsum(good) - good + above - np.cumsum(bad) + bad
        previous = np.r_[np.nan if last is None else last, s[:-1]]
        keep = slice(1 if last is None else 0, None)
        found = sorted(zip(wrong[keep], previous[keep] - s[keep], previous[keep], s[keep], strict=True), key=lambda t: t[:3])[:1]
        return pa.table({c: pa.array([f[i] for f in found], pa.float64()) for i, c in enumerate(("wrong", "gap", "a", "b"))})

    found = ranges.groupBy("part").applyInArrow(best, "wrong double, gap double, a double, b double").collect()
    if not found:
        return float(parts[0]["low"])
    r = min(found, key=lambda r: tuple(r)[:3])
    return float((r["a"] + r["b"]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """A ranking from all labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    key = F.col("doc_id")
    taught = key.isNotNull() & ~held_out(key)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("kind"))
    known = known.where(taught & F.col("kind").isin(0, 1)).groupBy("doc_id").agg(F.max("kind").alias("kind"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(taught)
    found = rows.mapInArrow(_features, "doc_id long, features array<double>").groupBy("doc_id").agg(F.min("features").alias("x"))
    numbered = _numbered(found.join(known, "doc_id"))
    sizes = {r[0]: r[1] for r in numbered.groupBy("kind").count().collect()}
    bad, good = sizes.get(0, 0), sizes.get(1, 0)
    if not bad or not good:
        return Ranking(share=float(good > 0))
    n, k = good + bad, len(FEATURES)
    points = _chunked(numbered, F.col("at"), "ranking_points")
    mean = _summed(points, lambda _, x: [x.sum(0)])[0] / n
    scale = np.sqrt(_summed(points, lambda _, x: [((x - mean) ** 2).sum(0)])[0] / n)
    scale = np.where(scale > 1e-9, scale, 1.0)
    differences = _chunked(_pairs(numbered, good, bad), F.col("at"), "ranking_pairs")
    weights = newton(lambda ws: _summed(differences, lambda _, d: [pair_sums(d / scale, w) for w in ws]), PAIRS * max(good, bad), k)
    out = Ranking(mean, scale, weights, share=good / n)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, x in zip(batch.column(0), batch.column(2), strict=True):
                s = out.strength(np.frombuffer(x.as_buffer()).reshape(-1, k))
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), float(kind.as_py())))], names=["s", "y"])

    out.threshold = _threshold(points.mapInArrow(strengths, "s double, y double"))
    away = lambda x: out.strength(x) - out.threshold
    unit = float(_summed(points, lambda _, x: [np.abs(away(x)).sum(keepdims=True)])[0][0] / n) or 1.0
    out.slope = slope_by(lambda a: _summed(points, lambda kind, x: [slope_sums(away(x) / unit, kind, a)])[0], unit)
    return out


def _score(batches: Iterator[pa.RecordBatch], ranking: Ranking) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        score = ranking.score(np.array([features(texts[i].as_py() or b"") for i in range(batch.num_rows)]).reshape(batch.num_rows, len(FEATURES)))
        held = [d is None or zlib.crc32(str(d).encode()) % 3 == 1 for d in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, ranking=ranking), "doc_id long, held_out boolean, score double, predicted int")

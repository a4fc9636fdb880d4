"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding: lower case, compatibility forms, homoglyphs (Cyrillic, Greek, full-width) to Latin letters, digits and signs that stand for
letters inside a word (``1d10t``), zero-width characters out, every run of other signs one space.  Words of one text
become `` w1 w2 ... wn `` with a space at either end, so a pattern `` idiot `` is a whole word and `` lowei`` the start of one.

Fit (``fit``), on labelled rows only: whole words and word beginnings are candidates; the weight of an entry is its smoothed
log-odds of occurring in toxic against clean texts.  An entry needs a weight of ``MIN_WEIGHT``, and as many toxic texts among its texts as chance would not
give one candidate among all of them (a Chernoff bound on the binomial tail, so the number of texts it takes follows from the data).  A beginning is dropped
if a longer entry covers nine tenths of its toxic texts, an entry if a beginning of it is an entry of no less weight.
Phrases (an entry's word with its left or right neighbour) that occur in three clean texts or more and not in toxic ones are exceptions: a
match inside them does not count.  The sum of the weights of the matches, per 100 words (with a floor on the length, so that one
word in a short text does not outweigh ten in a long one), is calibrated to a probability by a logistic curve.
The fit uses at most ``MAX_FIT_ROWS`` labelled ids, those with the smallest hash; this documented bound is the only one, lexicon and exceptions
are as large as these texts make them.  Candidates are counted by Spark, only entries that pass reach the driver.
Scoring covers every row and needs no shuffle: the lexicon goes to the tasks.

Null and empty texts have no match: they score like any text without one.  Null labels don't take part in the fit; of labels of one id that contradict
each other the larger holds; a null id is held out and scored.  Repeated rows score alike.  An empty table gives no row; without labels of both kinds the lexicon is empty and
every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import discard, save, small_batches

MAX_FIT_ROWS, MIN_WEIGHT = 40_000, 3.0
#: Candidates whose counts a task holds before it passes them on.
PART = 100_000
STEMS = range(4, 9)
LENGTH_FLOOR = 20

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгдеёзікмнопрѕтухցјԁһӏαβγεικνορτυχωϲ", "a6brdeezikmhonpstyxgjdhlabyeikvoptuxwc", strict=True))
#: Digits and signs that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_DIGIT_MAP = str.maketrans({k: v for k, v in DIGITS.items() if k.isdigit()} | HOMOGLYPHS)
_SIGN = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])|(?<![^\W_])[@$](?=[^\W\d_])")
_LATIN = re.compile("[\\x00-\\x7f¡-ſ]*")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    text = text or ""
    if not _LATIN.fullmatch(text) or "­" in text:
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return _WORD.findall(text.translate(_DIGIT_MAP))


def entries_of(words: set[str]) -> set[str]:
    """Lexicon candidates among distinct words: `` word `` and `` beginning``."""
    out = {f" {w} " for w in words if len(w) >= 3}
    for w in words:
        out.update(" " + w[:k] for k in STEMS if k <= len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    intercept: float = -30.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            a.add_word(entry, (entry, weight))
        if self.weights:
            a.make_automaton()
        b = ahocorasick.Automaton()
        for phrase in self.exceptions:
            b.add_word(phrase, phrase)
        if self.exceptions:
            b.make_automaton()
        return (a if self.weights else None), (b if self.exceptions else None)


def density(words: list[str], automata) -> float:
    """Weight of the lexicon matches per 100 words; a word counts once, with its heaviest entry."""
    matcher, exceptions = automata
    if matcher is None or not words:
        return 0.0
    text = f" {' '.join(words)} "
    found: dict[int, float] = {}
    for end, (entry, weight) in matcher.iter(text):
        start = end - len(entry) + 1
        if weight > found.get(start, 0.0):
            found[start] = weight
    if found and exceptions is not None:
        for end, phrase in exceptions.iter(text):
            for start in [s for s in found if end - len(phrase) + 1 <= s < end]:
                del found[start]
    return 100.0 * sum(found.values()) / max(len(words), LENGTH_FLOOR)


def _entry_counts(batches):
    """Texts of either label that hold a candidate, in parts of bounded size."""
    count: tuple[Counter, Counter] = Counter(), Counter()

    def parts():
        for toxic, c in enumerate(count):
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["entry", "toxic", "n"])
            c.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count[toxic].update(entries_of(set(fold(text))))
            if len(count[0]) + len(count[1]) >= PART:
                yield from parts()
    yield from parts()


def _fit_rows(batches, lexicon: Lexicon, phrases: bool):
    """Per labelled row its density; or the phrases around lexicon matches, with their label."""
    automata = lexicon.automaton()
    for batch in batches:
        a, b, c = [], [], []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = fold(text)
            if not phrases:
                a.append(""), b.append(toxic), c.append(density(words, automata))
                continue
            around = set()
            for i, w in enumerate(words):
                if any(p[0] == " " for p in (f" {w} ", *(" " + w[:k] for k in STEMS)) if p in lexicon.weights):
                    around.update(f" {' '.join(words[max(0, j):j + 2])} " for j in (i - 1, i) if 0 <= j < len(words) - 1)
            for p in around:
                a.append(p), b.append(toxic), c.append(1.0)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.float64())], names=["phrase", "toxic", "x"])


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one feature (Newton steps); ``times``: how often each row stands."""
    n = np.ones(len(x)) if times is None else times
    a, b = 0.0, math.log(((n * y).sum() + 0.5) / ((n * (1 - y)).sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(n * x * (y - p)).sum() - ridge * a, (n * (y - p)).sum() - ridge * b])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> Lexicon:
    """Lexicon, exceptions and calibration from labelled rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    key = F.col("doc_id")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(key.isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(key)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()  # the documented bound
    if not sample:
        return Lexicon()
    chosen = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in sample], "doc_id long, toxic int"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id").select("text", "toxic")
    rows = save(rows, "toxicity-sample")  # at most max_rows documents: one scan of the corpus
    by_label = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    share = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_toxic or not n_clean:
        discard(rows)
        return Lexicon(intercept=share if n_toxic else -30.0)

    counted = rows.mapInArrow(_entry_counts, "entry string, toxic int, n long").groupBy("entry")
    of_label = lambda k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0)).cast("double")
    counts = save(counted.agg(of_label(1).alias("t"), of_label(0).alias("c")), "toxicity-entries")
    candidates = counts.count()

    def odds(n: Column, of: int) -> Column:
        return F.log((n + 0.5) / (F.lit(float(of)) - n + 0.5))

    # texts of an entry that are toxic, against the share of toxic texts: n * KL bounds the log of the chance of so many
    n, base = F.col("t") + F.col("c"), n_toxic / (n_toxic + n_clean)
    part = F.col("t") / n
    clean_part = F.when(F.col("c") > 0, (1 - part) * F.log((1 - part) / (1 - base))).otherwise(F.lit(0.0))
    evidence = n * (part * F.log(part / base) + clean_part)
    passed = counts.where("t > 0").select("entry", "t", (odds(F.col("t"), n_toxic) - odds(F.col("c"), n_clean)).alias("w"), part.alias("part"), evidence.alias("evidence"))
    passed = passed.where((F.col("w") >= MIN_WEIGHT) & (F.col("part") > base) & (F.col("evidence") > math.log(max(candidates, 2)))).collect()
    discard(counts)
    in_toxic = {r["entry"]: r["t"] for r in passed}
    # rare in clean texts for what it weighs: a shared beginning of harmless words is none
    weight = {r["entry"]: r["w"] for r in passed}
    # of a beginning and a longer entry that covers nearly all its toxic texts, the longer one says what it is
    covered: dict[str, int] = {}
    for e in weight:
        for k in range(5, len(e)):
            covered[e[:k]] = max(covered.get(e[:k], 0), in_toxic[e])
    weight = {e: w for e, w in weight.items() if covered.get(e, 0) < 0.9 * in_toxic[e]}
    kept: dict[str, float] = {}
    for e in sorted(weight, key=lambda e: (len(e), e)):
        if not any(e[:k] in kept and kept[e[:k]] >= weight[e] - 1.0 for k in range(5, len(e))):
            kept[e] = weight[e]
    lexicon = Lexicon(weights=kept)

    around = rows.mapInArrow(partial(_fit_rows, lexicon=lexicon, phrases=True), "phrase string, toxic int, x double")
    by_phrase = around.groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where("t = 0 and n >= 3")
    lexicon.exceptions = tuple(sorted(r["phrase"] for r in by_phrase.collect()))

    # densities to a thousandth: as many rows as there are different ones, however often an id or a text repeats
    scored = rows.mapInArrow(partial(_fit_rows, lexicon=lexicon, phrases=False), "phrase string, toxic int, x double")
    scored = scored.groupBy("toxic", F.round(F.log1p("x"), 3).alias("x")).agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "x").collect()
    discard(rows)
    lexicon.slope, lexicon.intercept = logistic(*(np.array([float(r[c]) for r in scored]) for c in ("x", "toxic", "n")))
    return lexicon


def score_of(text: Column, lexicon: Lexicon) -> Column:
    """Score of a text column, for use inside a plan."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = lexicon.automaton()
        for texts in batches:
            x = np.log1p([density(fold(t), automata) for t in texts.to_pylist()])
            yield pa.array(1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.intercept, -30, 30))), pa.float64())

    return run(text)


def _score(batches, lexicon: Lexicon):
    automata = lexicon.automaton()
    for batch in batches:
        x = np.log1p([density(fold(t), automata) for t in batch.column(1).to_pylist()])
        score = 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.intercept, -30, 30)))
        held = [d is None or zlib.crc32(str(d).encode()) % 5 == 0 for d in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, lexicon=lexicon), "doc_id long, held_out boolean, score double, predicted int")

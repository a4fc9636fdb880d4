r"""Quality rules by distribution divergence.

Each document's histogram of character classes and of the common words of its language is compared with a language reference by
Jensen-Shannon distance (square root of the divergence to base 2, so 0 to 1).  A reference is the mean histogram over *all*
documents of a language that pass the base rules; a document without a language is held against all languages together.

1. One pass over the texts: base statistics and the two count vectors of each document (written as a narrow table).
2. References: mean histograms by language, partial sums first, so a hot language is a handful of rows; then once more over
   the documents near the first mean, so that junk does not shape what it is held against.
3. Distances and verdicts.

Guards: sampling noise makes the distance of a short text large by itself - for a text of n items and a reference of k classes by
about sqrt((k - 1) / (8 n ln 2)) - so that much is allowed on top of each limit, and below a minimum length the
rule gives no verdict (the base rules reject texts of under 20 words anyway).

Base rules (words ``[^\x20\x09-\x0D]+``): fewer than 20 words, or over 30 % of the words in 8-word windows that occur twice or more.

Null and empty texts have no words: base_failed, not kept.  Null languages and languages without reference are compared with
the reference over all.  A null id stays null.  Rows that repeat are judged one by one (and alike).
An empty table gives no row.  Columns other than id, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import WORD_CACHE, WordHashes, give_back, save, small_batches, window_hashes

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Limits of the Jensen-Shannon distances and the lengths from which they are judged (characters and words).
MAX_CHAR_DISTANCE, MIN_CHARS = 0.075, 100
MAX_WORD_DISTANCE, MIN_JUDGED_WORDS = 0.25, 50
#: Documents farther than this from the plain mean take no part in the final reference (a trimmed mean).
TRIM = 0.12

#: Character classes in order (digits count as small letters: numbers are no sign of junk); the rest is "other".
CLASSES = ("small", "capital", "space", "stop", "mark", "symbol", "other")
_STOPS, _MARKS, _SYMBOLS = ".,;:'\"()-?", "!", "#*$%&|<>"

#: Common function words; the histogram holds one class for each and one for all other words.
COMMON = {
    "en": "the of and to a in is it that for was on are with as at be this from by or an not have but".split(),
    "de": "der die das und in den von zu ist mit sich auf für nicht ein eine im dem des als auch es an werden aus er hat dass sie nach".split(),
    "fr": "le la les de des du et à un une est en que qui dans pour sur par au ne pas se ce il avec plus son sont".split(),
    "es": "el la los las de del y a en un una es que por con para se no su al lo como más pero sus le o".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
_EDGE = b".,;:'\"()-?!#*$%&|<>"
_CLASS_OF = np.full(0x3000, 6, np.int8)
for _code in range(len(_CLASS_OF)):
    _char = chr(_code)
    _CLASS_OF[_code] = (
        2 if _char in " \t\n\v\f\r"
        else 3 if _char in _STOPS
        else 4 if _char in _MARKS
        else 5 if _char in _SYMBOLS
        else 1 if _char.isupper()
        else 0 if _char.isalnum()
        else 6
    )


class CommonWords(dict):
    """Place of a word in the histogram (case folded, punctuation at the edges off); kept while the cache is small."""

    index = {w.encode(): i for i, w in enumerate(WORDS)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        place = self.index.get(word.strip(_EDGE).decode("utf-8", "replace").lower().encode(), len(WORDS))
        self[word] = place
        return place

    def counts(self, words: list[bytes]) -> np.ndarray:
        return np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), minlength=len(WORDS) + 1)


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text."""
    w = window_hashes(h, window)
    if len(w) < 2:
        return 0
    _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    if not len(hit):
        return 0
    edges = np.zeros(len(h) + 1, np.int64)
    edges[hit] += 1
    np.add.at(edges, hit + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def char_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_CLASS_OF[np.minimum(codes, len(_CLASS_OF) - 1)], minlength=len(CLASSES))


def measure(text: str | None, hashes: WordHashes, common: CommonWords) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in " \t\n\v\f\r"),
        sum(text.count(c) for c in _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(hashes.of(words)),
        char_counts(text),
        common.counts(words),
    )


def _features(batches):
    hashes, common = WordHashes(), CommonWords()
    for batch in batches:
        rows = [measure(t, hashes, common) for t in batch.column(1).to_pylist()]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        lists = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (5, 6)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *cols, *lists],
            names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"],
        )
    del hashes, common
    give_back()


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to its row of reference counts (0 where either is empty)."""
    n, m = counts.sum(1, keepdims=True), reference.sum(1, keepdims=True)
    p, q = counts / np.maximum(n, 1), reference / np.maximum(m, 1)
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / mean), 0).sum(1) + np.where(q > 0, q * np.log2(q / mean), 0).sum(1)
    return np.where((n[:, 0] > 0) & (m[:, 0] > 0), np.sqrt(np.maximum(kl / 2, 0)), 0.0)


def allowance(n: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What the distance of a sample of n items to its own distribution comes to."""
    return np.sqrt(np.maximum(classes - 1, 0) / (8 * np.maximum(n, 1) * np.log(2)))


def _judge(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        chars, words, ref_chars, ref_words = (np.array(batch.column(c).to_pylist(), float) for c in ("chars", "words", "ref_chars", "ref_words"))
        n_words = batch.column("n_words").to_numpy(zero_copy_only=False)
        repeat = batch.column("n_repeat_words").to_numpy(zero_copy_only=False)
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        by_char, by_word = distance(chars, ref_chars), distance(words, ref_words)
        bad = (chars.sum(1) >= MIN_CHARS) & (by_char > MAX_CHAR_DISTANCE + allowance(chars.sum(1), (ref_chars > 0).sum(1)))
        bad |= (n_words >= MIN_JUDGED_WORDS) & (by_word > MAX_WORD_DISTANCE + allowance(n_words, (ref_words > 0).sum(1)))
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        more = [pa.array(failed), pa.array(~failed & ~bad), pa.array(by_char), pa.array(by_word)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=[*names, "base_failed", "kept", "char_distance", "word_distance"])


def _near(batches):
    """Rows near the reference they come with (for the trimmed mean)."""
    for batch in batches:
        if batch.num_rows:
            chars, ref = (np.array(batch.column(c).to_pylist(), float) for c in ("chars", "ref_chars"))
            ok = distance(chars, ref) <= TRIM + allowance(chars.sum(1), (ref > 0).sum(1))
            yield batch.select(["lang", "chars", "words"]).filter(pa.array(ok))


SIZES = (("chars", len(CLASSES)), ("words", len(WORDS) + 1))


def _references(rows: DataFrame) -> DataFrame:
    """One row a language: the summed histograms, in parts per million.  Every document weighs the same, and whole
    numbers make the sums independent of their order."""

    def sums(column: str, size: int) -> list:
        total = F.greatest(F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
        return [F.sum(F.floor(F.lit(1e6) * F.col(column)[i] / total)).alias(f"{column}{i}") for i in range(size)]

    return save(rows.groupBy("lang").agg(*[x for c, n in SIZES for x in sums(c, n)]), "quality-reference")


def _with_reference(rows: DataFrame, by_lang: DataFrame) -> DataFrame:
    """``ref_chars`` and ``ref_words``: of the language, or over all where it has none."""
    names = [f"{c}{i}" for c, n in SIZES for i in range(n)]
    arrays = [F.array(*[F.coalesce(F.col(f"{c}{i}"), F.lit(0)) for i in range(n)]).alias(f"ref_{c}") for c, n in SIZES]
    total = by_lang.agg(*[F.sum(c).alias(c) for c in names]).select(*arrays).first()  # one row
    out = rows.join(by_lang.where("lang is not null").select("lang", *arrays), "lang", "left")
    for c, _ in SIZES:
        out = out.withColumn(f"ref_{c}", F.coalesce(f"ref_{c}", F.array(*[F.lit(int(x)).cast("long") for x in total[f"ref_{c}"]])))
    return out


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _final_references(found: DataFrame) -> DataFrame:
    """References of the measured rows: over those that pass the base rules, then over those of them near the first mean."""
    sound = found.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    first = _with_reference(sound.select("lang", "chars", "words"), _references(sound))
    return _references(first.mapInArrow(_near, "lang string, chars array<long>, words array<long>"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base statistics, distances and verdict of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = save(rows.mapInArrow(_features, f"doc_id long, lang string, {STATS}, chars array<long>, words array<long>"), "quality-features")
    references = _final_references(found)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words", "ref_chars", "ref_words"]
    return _with_reference(found, references).select(*columns).mapInArrow(
        _judge, f"doc_id long, {STATS}, base_failed boolean, kept boolean, char_distance double, word_distance double"
    )


def keep_sound(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    No join by id: each row is judged by its own text.  Rows are written once with their measures, so a text is measured once;
    references and verdicts read the measures alone.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    kinds = f"struct<{', '.join(f'{x.split()[0]}: long' for x in STATS.split(', '))}, chars: array<bigint>, words: array<bigint>>"

    @F.arrow_udf(kinds)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, common = WordHashes(), CommonWords()
        for texts in batches:
            rows = [measure(t, hashes, common) for t in texts.to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (5, 6)]
            yield pa.StructArray.from_arrays([*cols, *lists], names=[*(x.split()[0] for x in STATS.split(", ")), "chars", "words"])
        del hashes, common
        give_back()

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = save(docs.select(row, F.col(lang_col).cast("string").alias("lang"), measured(F.col(text_col).cast("string")).alias("f")), "quality-rows")
    references = _final_references(rows.select("lang", "f.*"))
    parts = [*(x.split()[0] for x in STATS.split(", ")), "chars", "words"]

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            table = pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64()), *columns], names=["doc_id", *parts, "ref_chars", "ref_words"])
            verdict = list(_judge([table]))
            yield verdict[0].column("kept") if verdict else pa.array([], pa.bool_())

    judged = _with_reference(rows.select("row", "lang", "f.*"), references)
    return judged.where(kept(*[F.col(c) for c in (*parts, "ref_chars", "ref_words")])).select("row.*")

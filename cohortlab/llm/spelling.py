"""Spelling variants: words one edit apart, found by edit-matrix rows over sorted lists.

1. **Counts.**  Each task counts the words of its texts (in parts of at most ``PART`` distinct ones), Spark adds up.  A frequent word is one row a part.
2. **Blocks.**  Of a pair one edit apart, the shorter word of length a: cut the places 0..a in halves, and all of the word but one half is the
   same in both.  So each word goes under (a, half, the rest of the word), once for the length a of its own and once for a one shorter
   (as the longer of a pair).  A block of over ``BLOCK`` words is halved again, and again, until it is small; one free place is the
   end of it, and such a block is no larger than the alphabet allows.  So no hot beginning or ending comes to one task whole.
3. **Scan.**  Spark sorts the free parts of each block.  Against one of them, the rest of the sorted list is scanned with a band of
   three cells of the edit matrix: rows of the prefix that a word shares with the one before (their LCP) stay, and as soon as every cell
   of a row is over one edit, all words with that prefix are skipped.
4. **Forms.**  A word's form is its near word with the largest count (ties: the smallest), if that count is ``RATIO`` times its own;
   forms are followed to the last one by pointer jumping.

A pair is reported in one block only, that of the first place where its words differ, so counts of near words just add up.

Null and empty texts have no word.  A null id is an id like others for counting.  Rows that repeat count each time.  An empty table
gives no row, as does one in which no word is frequent enough.  Columns other than id and text are not read.  Words may be of any length and script.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import discard, save, small_batches
from cohortlab.session import shuffle_partitions

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Distinct words a task counts before it passes them on; words of a block; rows of blocks a task scans.
PART, BLOCK, TASK_ROWS = 200_000, 1_000, 20_000

Change = Callable[[int | None, dict[str, int]], Iterable[tuple[str, int]]]


# --- counts ---------------------------------------------------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch], pattern: str, min_chars: int, change: Change | None) -> Iterator[pa.RecordBatch]:
    find = re.compile(pattern).findall
    total: Counter[str] = Counter()

    def part() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            words = find((texts[i].as_py() or b"").lower().decode())  # of bytes, lower() changes A-Z only
            if change:
                for word, n in change(doc_id, Counter(words)):
                    if len(word) >= min_chars:
                        total[word] += n
            else:
                total.update(words)
            if len(total) >= PART:
                yield part()
    if total:
        yield part()


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, min_chars: int = MIN_CHARS, change: Change | None = None
) -> DataFrame:
    """``word, n``: maximal runs of ``letters`` in the texts, A-Z lower-cased, of ``min_chars`` characters at least.

    ``change(id, counts)`` may replace the words of a text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count = partial(_counts, pattern=f"[{letters}]{{{min_chars},}}", min_chars=min_chars, change=change)
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- blocks ---------------------------------------------------------------------------------------------------------------

KEY = ["a", "lo", "hi", "head", "tail"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows ``word, n, a, lo, hi`` with what is the same in the whole block (head and tail) and the free part between."""
    size = F.char_length("word")
    return rows.select(
        "word",
        "n",
        "a",
        "lo",
        "hi",
        F.substring("word", F.lit(1), F.col("lo")).alias("head"),
        F.substring("word", size - F.col("a") + F.col("hi") + 1, F.col("a") - F.col("hi")).alias("tail"),
        F.substring("word", F.col("lo") + 1, size - F.col("a") + F.col("hi") - F.col("lo")).alias("free"),
    )


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    spans = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.select("word", "n", "a", F.explode(spans).alias("s")).select("word", "n", "a", "s.lo", "s.hi"))


def blocks(vocabulary: DataFrame, limit: int = BLOCK) -> tuple[DataFrame, int, list[DataFrame]]:
    """Words with their blocks, how many rows, and the tables written for it."""
    size = F.char_length("word")
    whole = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("a")).where("a > 0").select("word", "n", "a", F.lit(0).alias("lo"), F.col("a").alias("hi"))
    single, several = whole.where("a = 1"), whole.where("a > 1")
    level = save(_halves(several).unionByName(_keyed(single)), "spelling-block")
    parts, written, rows = [], [level], 0
    while True:
        sizes = level.groupBy(KEY).agg(F.count(F.lit(1)).alias("size"))
        large = save(sizes.where((F.col("size") > limit) & (F.col("hi") - F.col("lo") > 1)).select(KEY), "spelling-large")
        written.append(large)
        rows += level.count()
        if large.isEmpty():
            parts.append(level)
            break
        parts.append(level.join(large, KEY, "left_anti"))
        level = save(_halves(level.join(large, KEY, "left_semi")), "spelling-block")
        written.append(level)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, rows, written


# --- scan -----------------------------------------------------------------------------------------------------------------


def shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def scan(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs ``i < j`` of the sorted, distinct ``words`` that are one edit apart."""
    n = len(words)
    lcp = [0, *(shared(words[j - 1], words[j]) for j in range(1, n))]
    rows = [(9, 0, 1)] * (max(map(len, words), default=0) + 1)
    for i in range(n - 1):
        q = words[i]
        m = len(q)
        padded = f"\0{q}\0\0"  # padded[k] is the k-th character, from 1
        rows[0] = (9, 0, 1)
        known, j = 0, i + 1
        while j < n:
            word = words[j]
            d = known
            x, y, z = rows[d]
            size = len(word)
            dead = False
            while d < size:
                if d > m:
                    dead = True
                    break
                c = word[d]
                d += 1
                # cells of row d in columns d - 1, d and d + 1, over 1 is as good as any
                x = min(x + (d < 2 or padded[d - 1] != c), y + 1)
                if d <= m:
                    y = min(y + (padded[d] != c), z + 1, x + 1)
                    z = min(z + (padded[d + 1] != c), y + 1) if d < m else 9
                else:
                    y = z = 9
                if x > 1 and y > 1 and z > 1:
                    dead = True
                    break
                rows[d] = (x, y, z)
            if dead:
                j = bisect_left(words, word[:d] + "\U0010ffff", j + 1)
                if j < n:
                    known = min(lcp[j], d - 1)
                continue
            if -1 <= m - size <= 1 and (x, y, z)[m - size + 1] == 1:
                yield i, j
            j += 1
            if j < n:
                known = min(lcp[j], size)


def near_in_block(free: list[str], a: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs of a block (free parts, sorted) that are one edit apart and whose first difference lies in the block's span."""
    span = hi - lo
    for i, j in scan(free):
        p, q = len(free[i]), len(free[j])
        if p == q:
            if p == span:  # two longer words meet as the shorter ones of their own length
                yield i, j
        elif hi == a or shared(free[i], free[j]) < span:
            yield i, j


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[int], list[str]]]:
    """Blocks one after the other: key, words, counts, free parts."""
    key, words, counts, free = None, [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "word", "n", "free")]
        for *k, word, n, f in zip(*columns, strict=True):
            if k != key:
                if len(words) > 1:
                    yield key, words, counts, free
                key, words, counts, free = k, [], [], []
            words.append(word), counts.append(n), free.append(f)
    if len(words) > 1:
        yield key, words, counts, free


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (a, lo, hi, _, _), words, _, free in _groups(batches):
        found = list(near_in_block(free, a, lo, hi))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([words[p[s]] for p in found], pa.string()) for s in (0, 1)], names=["word", "near"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a block: how many near words, and the most frequent of them."""
    out: list[tuple[str, int, int, str]] = []

    def part() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

    for (a, lo, hi, _, _), words, counts, free in _groups(batches):
        best: dict[int, tuple[int, int, str]] = {}
        for pair in near_in_block(free, a, lo, hi):
            for i, j in (pair, pair[::-1]):
                seen, n, w = best.get(i, (0, 0, ""))
                if counts[j] > n or counts[j] == n and words[j] < w:
                    n, w = counts[j], words[j]
                best[i] = (seen + 1, n, w)
        out.extend((words[i], *b) for i, b in best.items())
        if len(out) >= 50_000:
            yield part()
            out.clear()
    if out:
        yield part()


def _sorted_blocks(rows: DataFrame, count: int) -> DataFrame:
    # a number of its own: adaptive execution would join small partitions by their bytes, not by the work in them
    parts = max(shuffle_partitions(rows.sparkSession), -(-count // TASK_ROWS))
    return rows.repartition(parts, *KEY).sortWithinPartitions(*KEY, "free")


def near_pairs(vocabulary: DataFrame, limit: int = BLOCK) -> DataFrame:
    """``word, near``: all pairs of distinct words of ``vocabulary`` (``word, n``) one edit apart, each pair once."""
    rows, count, written = blocks(vocabulary, limit)
    out = save(_sorted_blocks(rows, count).mapInArrow(_pairs, "word string, near string"), "spelling-pairs")
    for t in written:
        discard(t)
    return out


# --- forms ----------------------------------------------------------------------------------------------------------------


def _roots(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``word, root`` of ``links`` (``word, form``); a form is more frequent than its word, so there is no cycle."""
    roots = save(links.select("word", F.col("form").alias("root")), "spelling-root")
    for _ in range(max_rounds):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = save(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-root")
        discard(roots)
        roots = step.select("word", "root")
        roots._scratch = step._scratch
        if step.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def group_variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, limit: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``counts`` (``word, n``) that occurs ``min_count`` times."""
    vocabulary = save(counts.where(F.col("n") >= min_count).select("word", "n"), "spelling-words")
    rows, count, written = blocks(vocabulary, limit)
    found = _sorted_blocks(rows, count).mapInArrow(_near, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    has_form = -F.col("b.m") >= ratio * F.col("n")
    forms = save(
        vocabulary.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, F.col("b.best")).alias("form"),
            F.when(has_form, -F.col("b.m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(forms.where("form is not null").select("word", "form"))
    out = save(forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
    for t in (vocabulary, *written, forms, roots):
        discard(t)
    return out

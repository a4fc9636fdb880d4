r"""Periodic runs by Baier grouping: Lyndon arrays under both orders, their roots extended into runs.

A run is a stretch of words with smallest period q that no neighbouring word extends; reported are those of length >=
``min_length`` and >= ``min_exponent`` * q.

1. **Cut.**  In a run of exponent e every word occurs floor(e) times or more.  Words that occur less often in their stretch of
   the text lie in no reported run: the text is cut there and the rest is looked at again, until nothing more goes.  This loses
   nothing and leaves little of ordinary prose.  What is left of many texts is laid side by side, a separator between.
2. **Lyndon arrays.**  Phase one of Baier's suffix sorter (``lyndon_array``): suffixes start out in groups by their first symbol.
   Groups are taken from the highest down; the suffix before each member that is nearest and lower moves to a new group right above its
   old one and takes on the members' prefix, once for each member that points at it.  A group's prefix is, in the end, the
   longest Lyndon word that its suffixes start with.  No suffix array is finished and no second phase runs.  Linear time but
   for sorting the members of a group by position.  A second time with the alphabet reversed.
3. **Runs.**  Every run holds a Lyndon root of its period under one of the two orders (the runs theorem).  Each root is
   extended to both sides by longest common extensions; these are read off exact names of all blocks of 2^k words, for all roots at once.

Each text is worked on by itself inside its task: no shuffle, and a hot source or a group of copies is rows like any others.  Memory: the texts of
about ``CHUNK`` bytes, or one longer text, in time about n log n for n words, however repetitive.

Words are ``[^\x20\x09-\x0D]+``, compared as they are.  Null and empty texts have no word and no run, their kept text is empty.
A null id stays null.  Rows that repeat are answered one by one (and alike).  An empty table gives no row.  Columns other than id
and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import small_batches

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Bytes of text that are looked at together.
CHUNK = 1 << 20


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position (a prefix sorts before the longer word), by grouping suffixes."""
    n = len(ranks)
    by_rank = np.argsort(ranks, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ranks[by_rank]) != 0])
    sizes = np.diff(np.r_[first, n])
    group_of = np.empty(n, np.int64)
    group_of[by_rank] = np.repeat(first, sizes)
    place_of = np.empty(n, np.int64)
    place_of[by_rank] = np.arange(n)
    suffixes, place, group, length = by_rank.tolist(), place_of.tolist(), group_of.tolist(), [1] * n
    size = [0] * n  # of the group that starts at this place
    for at, k in zip(first.tolist(), sizes.tolist(), strict=True):
        size[at] = k
    done, left = [False] * n, [0] * n
    end = n
    while end:
        start = group[suffixes[end - 1]]
        members = suffixes[start:end]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and done[j]:  # each link is walked once: later searches pass over all of it
                j = left[j]
            done[i], left[i] = True, j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = start
        if not pointed:
            continue
        grown = length[members[0]]
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (times, old), movers in sorted(moves.items()) if len(moves) > 1 else moves.items():
            tail = old + size[old]
            size[old] -= len(movers)
            new = old + size[old]
            size[new] = len(movers)
            for j in movers:
                tail -= 1
                other, at = suffixes[tail], place[j]
                suffixes[at], place[other] = other, at
                suffixes[tail], place[j] = j, tail
                group[j] = new
                length[j] -= times * grown
    return np.array(length, np.int64)


class Extensions:
    """Longest common extensions by names of blocks: equal blocks of 2^k symbols, and only they, bear one name."""

    def __init__(self, symbols: np.ndarray):
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.n, self.levels, width = len(symbols), [names], 1
        while 2 * width <= self.n:
            pairs = names[:-width] * (names.max() + 1) + names[width:]
            _, names = np.unique(pairs, return_inverse=True)
            if names.max() + 1 == len(names):  # no two blocks of this length are equal
                break
            width *= 2
            self.levels.append(names)

    def _count(self, a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[k], 1 << k
            x, y = (a, b) if sign > 0 else (a - width, b - width)
            fits = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(names))
            same = np.zeros(len(a), bool)
            same[fits] = names[x[fits]] == names[y[fits]]
            step = np.where(same, width, 0)
            total += step
            a, b = a + sign * step, b + sign * step
        return total

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree from a and from b on."""
        return self._count(a, b, 1)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree before a and before b."""
        return self._count(a, b, -1)


def runs_of(symbols: np.ndarray, separator: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, sorted by start and period; ``separator`` marks symbols that nothing equals."""
    n = len(symbols)
    if not n:
        return np.empty((0, 3), np.int64)
    ranks = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    top = ranks.max() + 1
    names = ranks.copy()
    names[separator] = top + np.arange(separator.sum())
    extensions = Extensions(names)
    found = []
    for order in (ranks, top - ranks):
        period = lyndon_array(np.where(separator, 0, order))
        at = np.flatnonzero(~separator & (np.arange(n) + period < n))
        p = period[at]
        if min_exponent > 2:  # the first root of a run has its next period in the run, too
            near = names[at] == names[at + p]
            at, p = at[near], p[near]
        right = extensions.right(at, at + p)
        near = right >= (min_exponent - 2) * p
        at, p, right = at[near], p[near], right[near]
        left = extensions.left(at, at + p)
        length = left + p + right
        long = (length >= min_length) & (length >= min_exponent * p)
        found.append(np.stack([(at - left)[long], length[long], p[long]], 1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def cut(words: np.ndarray, text: np.ndarray, min_count: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie in a run and the number of their stretch, stretches in order.  ``words``: ids; ``text``: which text."""
    place, stretch = np.arange(len(words)), text
    width = int(words.max(initial=0)) + 1
    while len(place):
        _, inverse, count = np.unique(stretch * width + words[place], return_inverse=True, return_counts=True)
        often = count[inverse] >= min_count
        if often.all():
            break
        place, stretch = place[often], stretch[often]
        if len(place):
            stretch = np.cumsum(np.r_[0, (np.diff(place) != 1) | (np.diff(stretch) != 0)])
            long = np.bincount(stretch)[stretch] >= min_length
            place, stretch = place[long], np.unique(stretch[long], return_inverse=True)[1]
    return place, stretch


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """For each text (a list of words) its runs, rows ``start, length, period``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids: dict[bytes, int] = {}
    for t in texts:
        ids.update(dict.fromkeys(t))
    ids = dict(zip(ids, range(len(ids)), strict=True))
    words = np.fromiter((x for t in texts for x in map(ids.__getitem__, t)), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    place, stretch = cut(words, text, min_exponent, max(min_length, min_exponent))
    if not len(place):
        return [np.empty((0, 3), np.int64)] * len(texts)
    # a separator after each stretch
    at = np.arange(len(place)) + stretch
    separator = np.ones(len(place) + int(stretch[-1]) + 1, bool)
    separator[at] = False
    symbols, origin = np.zeros(len(separator), np.int64), np.zeros(len(separator), np.int64)
    symbols[at], origin[at] = words[place] + 1, place
    runs = runs_of(symbols, separator, min_length, min_exponent)
    runs[:, 0] = origin[runs[:, 0]]
    of = text[runs[:, 0]]
    runs[:, 0] -= begin[of]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts, about ``CHUNK`` bytes at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        begin, held = 0, 0
        for i in range(batch.num_rows):
            held += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if held >= CHUNK or i == batch.num_rows - 1:
                n = i + 1 - begin
                yield batch.column(0).slice(begin, n).to_pylist(), [t or b"" for t in texts.slice(begin, n).to_pylist()]
                begin, held = i + 1, 0


def _find(batches: Iterator[pa.RecordBatch], prepare: Callable | None, min_length: int, min_exponent: int) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for ids, raw in _chunks(batches):
        texts = [t.split() for t in raw]
        if prepare:
            texts = [prepare(i, t) for i, t in zip(ids, texts, strict=True)]
        found = runs_of_texts(texts, min_length, min_exponent)
        flat = np.concatenate(found)
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run)))
        kept = [b" ".join(collapse(t, r)) for t, r in zip(texts, found, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), runs, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "kept_text"]
        )


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``doc_id, n_words, runs array<struct<start, length, period>>, kept_text`` of every row; runs by start, then period.

    ``prepare(id, words)`` may change a text's words before the search.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_find, prepare=prepare, min_length=min_length, min_exponent=min_exponent),
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string",
    )

"""Column expressions shared by the operators (all JVM-side, no Python UDF)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with NaN as NULL in its floating-point columns: the one place where "not a number" becomes "missing"."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (columns is None or f.name in columns)]
    return df.withColumns({n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in names}) if names else df


def lookup(c: str | Column, mapping: Mapping[str, object]) -> Column:
    """Dictionary lookup as a literal map; unknown keys and NULL give NULL."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.try_element_at(m, col_of(c))


def ordinal_code(c: str | Column, mapping: Mapping[str, int], missing: int = 0) -> Column:
    """Code of an ordinal answer; unknown or missing answers get ``missing`` (0 by default)."""
    return F.coalesce(lookup(c, mapping), F.lit(missing)).cast("int")


def not_binary(c: str | Column) -> Column:
    """True when a flag is not exactly 0 or 1 — a missing flag counts as bad."""
    x = col_of(c)
    return ~(x.eqNullSafe(0) | x.eqNullSafe(1))


def split_hash(key: str | Column, seed: int = 42) -> Column:
    """32-bit bucket of ``md5('<seed>:<key>')`` — stable under repartitioning, same in DuckDB."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), col_of(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def split_threshold(fraction: float) -> int:
    return int(fraction * 2**32)


def is_test_row(key: str | Column, fraction: float = 0.2, seed: int = 42) -> Column:
    return split_hash(key, seed) < F.lit(split_threshold(fraction))


#: Flags in one word of a mask (a long, less its sign and one to spare).
WORD = 62


def bitmask(flags: Sequence[str | Column]) -> Column:
    """Bit i set when flag i equals 1: a long for up to ``WORD`` flags, an array of longs (``WORD`` bits each) for more."""
    if len(flags) > WORD:
        return F.array(*[bitmask(flags[i : i + WORD]) for i in range(0, len(flags), WORD)])
    acc = F.lit(0).cast("long")
    for i, c in enumerate(flags):
        acc = acc + F.when(col_of(c) == 1, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return acc


def wide_has(mask: Column, i: Column) -> Column:
    """Whether bit i of an array mask is set."""
    return mask[(i / WORD).cast("int")].bitwiseAND(bit(i % WORD)) != 0


def wide_items(mask: Column, n_items: int) -> Column:
    """Numbers of the set bits of an array mask, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_items - 1)), lambda i: wide_has(mask, i))


def wide_of(items: Column, n_items: int) -> Column:
    """Array mask of an array of bit numbers."""
    def word(w: int) -> Column:
        inside = F.filter(items, lambda i: (i >= w) & (i < w + WORD))
        return F.aggregate(inside, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i - w)))

    return F.array(*[word(w) for w in range(0, n_items, WORD)])


def wide_minus(mask: Column, other: Column) -> Column:
    return F.zip_with(mask, other, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))


def wide_size(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, w: acc + F.bit_count(w).cast("int"))


def uniform(key: str | Column, seed: int = 42, stream: int = 0) -> Column:
    """A number in (0, 1) for each key: the first 52 bits of ``md5('<seed>:<stream>:<key>')`` - no state, so the same under any partitioning, retry or engine."""
    h = F.md5(F.concat(F.lit(f"{seed}:{stream}:"), col_of(key).cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(key: str | Column, seed: int = 42, stream: int = 0) -> Column:
    """A standard normal number for each key (Box-Muller, on the streams 2 x ``stream`` and the next)."""
    u, v = uniform(key, seed, 2 * stream), uniform(key, seed, 2 * stream + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def bit(i: Column) -> Column:
    """2^i as a long (i is a column)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def has_bit(mask: Column, i: Column) -> Column:
    return mask.bitwiseAND(bit(i)) != 0


def mask_items(mask: Column, labels: Sequence[str]) -> Column:
    """Array of the labels whose bit is set, in the configured order."""
    arr = F.array(*[F.lit(x) for x in labels])
    idx = F.sequence(F.lit(0), F.lit(len(labels) - 1))
    return F.transform(
        F.filter(idx, lambda i: has_bit(mask, i)),
        lambda i: F.element_at(arr, i + 1),
    )


def subsets_upto(mask: Column, n_items: int, max_size: int) -> Column:
    """Array of all non-empty subsets (as masks) of ``mask`` with at most ``max_size`` bits.

    Built from the set bits with nested higher-order functions, so a basket of
    b items yields sum_{s<=max_size} C(b, s) entries — no scan of 2^n masks.
    """
    bits = F.filter(F.sequence(F.lit(0), F.lit(n_items - 1)), lambda i: has_bit(mask, i))

    def grow(prev_last: Column | None, acc: Column, depth: int) -> Column:
        # all subsets that extend `acc` by bits greater than prev_last, up to max_size bits
        cand = bits if prev_last is None else F.filter(bits, lambda j: j > prev_last)
        if depth == max_size:
            return F.transform(cand, lambda j: acc.bitwiseOR(bit(j)))
        return F.flatten(
            F.transform(
                cand,
                lambda j: F.concat(
                    F.array(acc.bitwiseOR(bit(j))),
                    grow(j, acc.bitwiseOR(bit(j)), depth + 1),
                ),
            )
        )

    return grow(None, F.lit(0).cast("long"), 1)


def proper_subsets(mask: Column, n_items: int, max_size: int) -> Column:
    """Non-empty proper subsets of ``mask`` (as masks); ``max_size`` bounds the size of ``mask``."""
    return F.filter(subsets_upto(mask, n_items, max(max_size - 1, 1)), lambda s: s != mask)


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Keep the configured columns that exist (optional column sets)."""
    return [c for c in cols if c in df.columns]

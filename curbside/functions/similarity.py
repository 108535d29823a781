"""Similarity of titles: the share of characters in a longest common
subsequence. With T the two lengths together and D the number of single
insertions and deletions between the texts, ratio = 100 * (T - D) / T."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.session import once, ship_package


def _common(a: str, b: str) -> int:
    """Length of a longest common subsequence, one machine word step per
    character of ``b`` (bit-parallel recurrence of Hyyrö, 2004)."""
    at = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    everything = (1 << len(a)) - 1
    state = everything
    for ch in b:
        hit = state & at.get(ch, 0)
        state = ((state + hit) | (state - hit)) & everything
    return len(a) - state.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    def lengths(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist())
        return pa.array(
            [None if p is None or q is None else _common(p, q) for p, q in pairs], pa.int64()
        )

    return F.arrow_udf(lengths, "bigint")(a, b)


def char_mask(text: str) -> str:
    """SQL for a 64-bit set of the characters of column ``text``."""
    return f"aggregate(split({text}, ''), 0L, (m, c) -> m | shiftleft(1L, ascii(c) % 64))"


def with_similarity(pairs: DataFrame, a: str, b: str, cutoff: int) -> DataFrame:
    """Keep the pairs with a ratio above ``cutoff``.

    The edit distance E with substitutions bounds D: E <= D <= 2E. That settles
    most pairs natively; only those in between go to the exact count.
    """
    ship_package(pairs.sparkSession)
    total = F.length(a) + F.length(b)
    room = 100 - cutoff
    edits = F.expr(f"levenshtein({a}, {b}, cast({room} * (length({a}) + length({b})) div 100 as int))")
    # Evaluated once, and not moved into the join below, where it would come
    # before the join's cheaper conditions.
    bounded = once(pairs, _t=total, _e=edits).where(F.expr(f"_e >= 0 and 100 * _e < {room} * _t"))
    unsure = F.expr(f"200 * _e >= {room} * _t")
    counted = bounded.withColumn(
        "_lcs", lcs_length(F.when(unsure, F.col(a)), F.when(unsure, F.col(b)))
    )
    return counted.where(F.expr(f"_lcs is null or 100 * (_t - 2 * _lcs) < {room} * _t")).drop(
        "_t", "_e", "_lcs"
    )

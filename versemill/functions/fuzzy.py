"""Partial-ratio similarity (J10): how well the shorter of two texts fits somewhere in the longer one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(places: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of ``text`` and a text of ``n`` characters, whose places are given as bits for each character.

    One whole number holds a row of the table, so a character costs a few operations whatever the length.
    """
    whole = state = (1 << n) - 1
    for c in text:
        if here := state & places.get(c, 0):
            state = ((state + here) | (state - here)) & whole
    return n - state.bit_count()


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best 200 * common / (length + length) of the shorter text with any stretch of its length in the longer one, or with a shorter stretch at either end. 0 if one is empty or null."""
    short, long = sorted((a or "", b or ""), key=len)
    n = len(short)
    if not n:
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
    stretches = [long[i : i + n] for i in range(len(long) - n + 1)] + [x for k in range(1, n) for x in (long[:k], long[-k:])]
    best = 0.0
    for stretch in stretches:
        if 200 * len(stretch) / (n + len(stretch)) > best:  # the most it could reach
            best = max(best, 200 * common_length(places, n, stretch) / (n + len(stretch)))
    return best


def partial_ratio_of(a: Column, b: Column) -> Column:
    """``partial_ratio`` of two columns, Arrow batches at a time: candidates only, never all pairs, should get here."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio(x, y) for x, y in zip(left, right)])

    return ratio(a, b)

"""Likeness of names by their tokens, in Arrow batches; callers pass distinct strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a row of the table held as the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in hundredths."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens and the shared tokens with either side's own; 0 if a side is blank."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not left or not right):
        return 100.0
    if not shared:
        return ratio(left, right)
    # What both begin with is common whole: only what follows it has to be compared.
    n, a, b = len(shared), len(left) + 1, len(right) + 1
    both = 200.0 * (n + 1 + common_length(left, right)) / (n + a + n + b)
    return max(both, 200.0 * n / (n + n + a), 200.0 * n / (n + n + b))


def _pairs(score, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(sorted_ratio, a, b)


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(set_ratio, a, b)

"""Fuzzy scores (survey F31): token-set and weighted ratios from the indel distance.

The longest common subsequence comes from bit-parallel rows (one arbitrary-long
integer operation for each sign), in Arrow batches; a score depends on the two
strings alone, so callers join distinct strings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    full = (1 << len(b)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    row = full
    for c in a:
        if c in places:
            u = row & places[c]
            row = (row + u | row - u) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Compares what two token sets share with what each adds."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (only_x and only_y):
        return 100.0
    gap = 1 if shared else 0
    n_x, n_y = (len(shared) + gap + len(o) for o in (only_x, only_y))
    distance = len(only_x) + len(only_y) - 2 * common_subsequence(only_x, only_y)
    best = 100.0 * (1 - distance / (n_x + n_y))
    if not shared:
        return best
    return max(best, *(100.0 * (1 - (gap + len(o)) / (len(shared) + n)) for o, n in ((only_x, n_x), (only_y, n_y))))


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_ratio(a: str, b: str) -> float:
    """The shorter string against the window of the longer that suits it best; windows may hang over the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, signs = len(a), set(a)
    best = 0.0
    for end in range(1, len(b) + n):
        window = b[max(0, end - n) : end]
        if window[0] in signs and window[-1] in signs or len(window) == n:
            best = max(best, ratio(a, window))
            if best == 100.0:
                break
    return best


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, token and, for unequal lengths, partial ratios with their discounts."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, token_ratio(a, b) * 0.95)
    discount = 0.9 if longer <= 8.0 else 0.6
    return max(best, partial_ratio(a, b) * discount, partial_token_ratio(a, b) * 0.95 * discount)


def _column(score):
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int(score(x or "", y or "")) for x, y in zip(a, b, strict=True)], dtype="int32")

    return run


def token_set_score(a: Column, b: Column) -> Column:
    return _column(token_set_ratio)(a, b)

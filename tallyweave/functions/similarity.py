"""String similarities: plain Python kernels behind Arrow functions, and set measures as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _where(a: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for n, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << n
    return out


def _subsequence(where: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of b and the string of `size` with these places."""
    full = (1 << size) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    if len(a) > len(b):
        a, b = b, a
    return _subsequence(_where(a), len(a), b)


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty strings are equal."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 1.0
    joined = lambda s: " ".join(sorted(s))
    common, left, right = joined(both), joined(x - y), joined(y - x)
    if not both:
        return ratio(left, right)
    full_left, full_right = f"{common} {left}", f"{common} {right}"
    return max(ratio(full_left, full_right), 2 * len(common) / (len(common) + len(full_left)), 2 * len(common) / (len(common) + len(full_right)))


def _edge(where: dict[str, int], n: int, long: str, best: float) -> float:
    """The best ratio with the windows shorter than n at the beginning of long: one pass gives all of them."""
    full = (1 << n) - 1
    row = full
    for e, c in enumerate(long[: n - 1], 1):
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
        if 2 * e / (n + e) > best:  # else even a full hit is no better
            best = max(best, 2 * (n - row.bit_count()) / (n + e))
    return best


def _best_window(short: str, long: str) -> float:
    """The best ratio of short with windows of its length, and shorter ones at both ends of long.

    A window moved by one place loses one character and gains one, so its subsequence grows by one at most:
    the windows that cannot pass the best one so far are left out."""
    n, where, most, at = len(short), _where(short), 0, 0
    while at <= len(long) - n and most < n:
        size = _subsequence(where, n, long[at : at + n])
        most = max(most, size)
        at += most - size + 1
    best = most / n
    if best < 1.0:
        best = _edge(where, n, long, best)
        best = _edge(_where(short[::-1]), n, long[::-1], best)
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, cut windows at its edges
    included; equal lengths are tried both ways."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) and best < 1.0 else best


def jaro_winkler(a: str, b: str) -> float:
    """Places of b as bits: the first free equal one in reach is the lowest bit of a mask."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    where, free, hits = _where(b), (1 << len(b)) - 1, []
    for i, c in enumerate(a):
        near = where.get(c, 0) & free & ((1 << i + reach + 1) - 1)
        near = near >> i - reach << i - reach if i > reach else near
        if near:
            free &= ~(near & -near)
            hits.append(c)
    m = len(hits)
    if not m:
        return 0.0
    swapped = sum(c != d for c, d in zip(hits, (d for j, d in enumerate(b) if not free >> j & 1))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def fuzzy_tokens(left, right) -> float:
    """Mean over the smaller token set (the left of equal ones) of each token's best ratio in the other."""
    short, long = (left, right) if len(left) <= len(right) else (right, left)
    return sum(max((ratio(x, y) for y in long), default=0.0) for x in short) / max(1, len(short))


def _arrow(kernel):
    @F.pandas_udf(DoubleType())
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}  # a query meets the same pair of strings again and again
        out = []
        for pair in zip(a, b):
            key = pair if isinstance(pair[0], str) else (tuple(pair[0]), tuple(pair[1]))
            got = seen.get(key)
            if got is None:
                got = seen[key] = kernel(*key)
            out.append(got)
        return pd.Series(out, dtype="float64")

    return measured


ratio_col = _arrow(ratio)
token_set_col = _arrow(token_set_ratio)
partial_col = _arrow(partial_ratio)
jaro_winkler_col = _arrow(jaro_winkler)
fuzzy_tokens_col = _arrow(fuzzy_tokens)


def ratio_native(a: Column, b: Column) -> Column:
    """`ratio` without Python: the table's rows by nested aggregates over characters. For short strings."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")

    def row(before: Column, c: Column) -> Column:
        cells = F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(
                acc,
                F.array(
                    F.when(F.substring(b, j, F.lit(1)) == c, F.element_at(before, j) + 1).otherwise(
                        F.greatest(F.element_at(before, j + 1), F.element_at(acc, -1))
                    )
                ),
            ),
        )
        return cells

    table = F.aggregate(chars(a), F.array_repeat(F.lit(0), F.length(b) + 1), row)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(2.0 * F.element_at(table, -1) / total)


def overlap(x: Column, y: Column) -> tuple[Column, Column]:
    """Jaccard similarity and containment of two sets, denominators at least one."""
    both = F.size(F.array_intersect(x, y))
    return both / F.greatest(F.lit(1), F.size(F.array_union(x, y))), both / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))

"""String similarities in [0, 1] as Arrow functions; pure Python kernels, each distinct pair of a batch once.

Conventions: two empty strings are equal (1) for ratio, sorted ratio and partial ratio, and unlike (0) for the set ratio.
A null on either side gives null.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recordloom.session import ship_to_active

#: Pairs of a table that are compared together, so that their bits stay in a core's cache.
PAIRS_AT_ONCE = 1 << 15


def places(a: str) -> dict[str, int]:
    """For each character, one bit for each of its places in a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def lcs(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one bit for each character of a; ``where`` is places(a), if known."""
    where = where or places(a)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and these with each side's own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, own_a, own_b = x & y, sorted(x - y), sorted(y - x)
    if both and not (own_a and own_b):
        return 1.0
    common, rest_a, rest_b = " ".join(sorted(both)), " ".join(own_a), " ".join(own_b)
    gap = bool(common)
    size_a, size_b = len(common) + gap + len(rest_a), len(common) + gap + len(rest_b)
    shared = len(common) + gap + lcs(rest_a, rest_b)
    found = [2 * shared / (size_a + size_b)]
    if common:
        found += [2 * len(common) / (len(common) + size_a), 2 * len(common) / (len(common) + size_b)]
    return max(found)


def stretches(short: str, long: str) -> list[tuple[float, int, int]]:
    """``bound, start, end`` of the stretches of ``long`` that partial_ratio() compares: its starts, its parts as long as ``short``, and its ends.

    The bound of a stretch's ratio is by the characters that it shares with ``short`` in any order, counted as the stretch moves on.
    """
    m, n, common, room, out = len(short), len(long), 0, {}, []
    for c in short:
        room[c] = room.get(c, 0) + 1
    for end in range(1, n + m):
        if end <= n and long[end - 1] in room:
            c = long[end - 1]
            room[c] -= 1
            common += room[c] >= 0
        if end > m and long[end - m - 1] in room:
            c = long[end - m - 1]
            common -= room[c] >= 0
            room[c] += 1
        s, e = max(0, end - m), min(n, end)
        out.append((2 * common / (m + e - s), s, e))
    return out


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string and the longer one's stretches of its length, and its shorter starts and ends; the most promising first."""
    if not a or not b:
        return float(a == b)
    best = 0.0
    for short, long in [(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]:
        m, where = len(short), places(short)
        for bound, s, e in sorted(stretches(short, long), reverse=True):
            if bound <= best:
                break
            best = max(best, 2 * lcs(short, long[s:e], where) / (m + e - s))
    return best


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def rounded(x: float, digits: int) -> float:
    """x to so many digits, halves away from zero, by its shortest decimal form: as Spark's round()."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def jaro_winkler_table(a: list[str], b: list[str], digits: int):
    """jaro_winkler() of each string of ``a`` with each of ``b`` to so many digits, as an array; all pairs of two lengths at a time, one bit for each character of b."""
    import numpy as np

    out = np.empty((len(a), len(b)))
    by_length = lambda x: {n: [i for i, s in enumerate(x) if len(s) == n] for n in {len(s) for s in x}}
    for m, of_a in by_length(a).items():
        for n, of_b in by_length(b).items():
            if not m or not n or n > 64:
                out[np.ix_(of_a, of_b)] = [[rounded(jaro_winkler(a[i], b[j]), digits) for j in of_b] for i in of_a]
                continue
            x = np.array([[ord(c) for c in a[i]] for i in of_a], "u4")
            y = np.array([[ord(c) for c in b[j]] for j in of_b], "u4")
            kind = np.uint32 if n <= 32 else np.uint64
            chars, x_code = np.unique(x, return_inverse=True)
            x_code = x_code.reshape(x.shape)
            where = np.zeros((len(chars), len(of_b)), kind)  # a bit for each place of a character
            for j in range(n):
                where |= (chars[:, None] == y[None, :, j]).astype(kind) << kind(j)
            reach = max(0, max(m, n) // 2 - 1)
            windows = [kind(sum(1 << j for j in range(max(0, i - reach), min(n, i + reach + 1)))) for i in range(m)]
            few = min(m, n)
            known = np.full((few + 1) * (few // 2 + 1) * 5, np.nan)
            values = np.empty((len(of_a), len(of_b)))
            step = max(1, PAIRS_AT_ONCE // len(of_b))
            for at in range(0, len(of_a), step):
                codes = x_code[at : at + step]
                alike = int((codes == codes[0]).all(axis=0).cumprod().sum())  # a common start is compared once
                at_place = [codes[: 1 if i < alike else None, i] for i in range(m)]
                free = np.full((1, len(of_b)), kind((1 << n) - 1), kind)
                hits = []
                for i in range(m):
                    if i == alike:
                        free = np.repeat(free, len(codes), axis=0)
                    low = where[at_place[i]]
                    low &= windows[i]
                    low &= free
                    low &= np.negative(low)
                    free ^= low
                    hits.append(low != 0)
                left = np.broadcast_to(free ^ kind((1 << n) - 1), (len(codes), len(of_b))).copy()
                matched = np.bitwise_count(left).astype("i4")
                even = np.zeros(left.shape, "u1")
                for i in range(m):
                    low = np.negative(left)
                    low &= left
                    low *= hits[i]
                    left ^= low
                    low &= where[at_place[i]]
                    even += low != 0
                same = np.ones(left.shape, bool)
                prefix = np.zeros(left.shape, "i4")
                for i in range(min(4, few)):
                    same &= x[at : at + step, i, None] == y[None, :, i]
                    prefix += same
                kinds = (matched * (few // 2 + 1) + (matched - even) // 2) * 5 + prefix
                for k in np.flatnonzero(np.bincount(kinds.ravel(), minlength=len(known)) * np.isnan(known)):
                    c, swaps, p = k // 5 // (few // 2 + 1), k // 5 % (few // 2 + 1), k % 5
                    jaro = (int(c) / m + int(c) / n + int(c - swaps) / int(c)) / 3 if c else 0.0
                    known[k] = rounded(jaro + int(p) * 0.1 * (1 - jaro) if jaro > 0.7 else jaro, digits)
                values[at : at + step] = known[kinds]
            out[np.ix_(of_a, of_b)] = values
    return out


KERNELS = {"ratio": ratio, "sorted": sorted_ratio, "set": set_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler}


def similarity(kind: str, a: Column, b: Column) -> Column:
    """The similarity of two string columns; several in one projection share one visit to Python."""
    ship_to_active()
    kernel = KERNELS[kind]

    @F.pandas_udf(DoubleType())
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for p in zip(x, y, strict=True):
            if p not in seen:
                seen[p] = None if p[0] is None or p[1] is None else kernel(*p)
            out.append(seen[p])
        return pd.Series(out, dtype="float64")

    return compare(a, b)

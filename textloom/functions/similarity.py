"""String similarities as columns.

Character-count and set measures and edit distances are built-in expressions.  The
dynamic programs that have none are pandas UDFs over Arrow batches; within a batch
each distinct pair is computed once.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_similarity(a: Column, b: Column) -> Column:
    """1 of two empty strings; null where either is null."""
    longest = F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.length(a), F.length(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def normalized_edit_distance(a: Column, b: Column) -> Column:
    """Distance over the longer length; 1 where either is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 1.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _dot(a: Column, b: Column) -> Column:
    """Sum over shared characters of the products of their counts."""
    x, y = _chars(a), _chars(b)
    each = F.transform(F.array_intersect(x, y), lambda c: (F.size(F.filter(x, lambda i: i == c)) * F.size(F.filter(y, lambda i: i == c))).cast("double"))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def char_cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)


def char_dice(a: Column, b: Column) -> Column:
    """0 of two empty strings."""
    return F.coalesce(F.try_divide(2 * _dot(a, b), _dot(a, a) + _dot(b, b)), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def char_jaccard(a: Column, b: Column) -> Column:
    """0 of two empty strings."""
    return F.coalesce(F.try_divide(_dot(a, b), _dot(a, a) + _dot(b, b) - _dot(a, b)), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def char_euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), _dot(a, a) + _dot(b, b) - 2 * _dot(a, b)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of arrays of tokens; 0 of two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def jaro(s: str, t: str) -> float:
    """Jaro with a window of half the shorter length plus one."""
    if not s or not t:
        return 0.0
    reach = min(len(s), len(t)) // 2 + 1

    def common(x: str, y: str) -> list[str]:
        left, out = list(y), []
        for i, ch in enumerate(x):
            for j in range(max(0, i - reach), min(i + reach, len(y))):
                if left[j] == ch:
                    out.append(ch)
                    left[j] = ""
                    break
        return out

    a, b = common(s, t), common(t, s)
    if not a or len(a) != len(b):
        return 0.0
    moved = sum(x != y for x, y in zip(a, b)) // 2  # whole transpositions
    return (len(a) / len(s) + len(a) / len(t) + (len(a) - moved) / len(a)) / 3


def jaro_winkler(s: str, t: str, weight: float = 0.1) -> float:
    base = jaro(s, t)
    same = 0
    for x, y in zip(s[:4], t[:4]):
        if x != y:
            break
        same += 1
    return base + same * weight * (1 - base)


def needleman_wunsch(s: str, t: str, match: float = 1, miss: float = -1, gap: float = -1) -> float:
    row = [gap * j for j in range(len(t) + 1)]
    for i, x in enumerate(s, 1):
        last, row = row, [gap * i]
        for j, y in enumerate(t, 1):
            row.append(max(last[j - 1] + (match if x == y else miss), last[j] + gap, row[-1] + gap))
    return float(row[-1])


def needleman_wunsch_unit(s: str, t: str) -> float:
    """The global alignment's score moved into [0, 1]."""
    longest = max(len(s), len(t))
    return (needleman_wunsch(s, t) + longest) / (2 * longest) if longest else 1.0


def smith_waterman(s: str, t: str, match: float = 2, miss: float = -1, gap: float = -1) -> float:
    best, row = 0.0, [0.0] * (len(t) + 1)
    for x in s:
        last, row = row, [0.0]
        for j, y in enumerate(t, 1):
            row.append(max(0.0, last[j - 1] + (match if x == y else miss), last[j] + gap, row[-1] + gap))
        best = max(best, *row)
    return float(best)


def smith_waterman_unit(s: str, t: str) -> float:
    shortest = min(len(s), len(t))
    return smith_waterman(s, t) / (2 * shortest) if shortest else 0.0


def affine_gap(s: str, t: str, match: float = 1, miss: float = -1, open_: float = -2, extend: float = -0.5) -> float:
    """Global alignment whose gaps cost more to open than to extend."""
    low = -1e18
    m, x, y = [0.0] + [low] * len(t), [low] * (len(t) + 1), [low] + [open_ + extend * j for j in range(len(t))]
    for i, a in enumerate(s, 1):
        m2, x2, y2 = [low], [open_ + extend * (i - 1)], [low]
        for j, b in enumerate(t, 1):
            m2.append(max(m[j - 1], x[j - 1], y[j - 1]) + (match if a == b else miss))
            x2.append(max(m[j] + open_, x[j] + extend, y[j] + open_))
            y2.append(max(m2[j - 1] + open_, y2[j - 1] + extend, x2[j - 1] + open_))
        m, x, y = m2, x2, y2
    return float(max(m[-1], x[-1], y[-1]))


def damerau(s: str, t: str) -> float:
    """Edit distance with transpositions of neighbours (optimal string alignment)."""
    rows = [list(range(len(t) + 1))]
    for i, x in enumerate(s, 1):
        row = [i]
        for j, y in enumerate(t, 1):
            v = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == t[j - 2] and s[i - 2] == y:
                v = min(v, rows[i - 2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return float(rows[-1][-1])


def damerau_full(s: str, t: str) -> float:
    """Edit distance with transpositions between which other edits may stand."""
    far = len(s) + len(t)
    last: dict[str, int] = {}
    rows = [[far] * (len(t) + 2)] + [[far, *range(len(t) + 1)]]
    for i, x in enumerate(s, 1):
        row, seen = [far, i], 0
        for j, y in enumerate(t, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
    return float(rows[-1][-1])


def weighted_edit(s: str, t: str) -> float:
    """Edit distance in which an edit at place k (from 0) costs 1 / ln(k + 2)."""
    w = lambda k: 1 / math.log(k + 2)
    row = [0.0]
    for j in range(len(t)):
        row.append(row[-1] + w(j))
    for i, x in enumerate(s, 1):
        last, row = row, [row[0] + w(i - 1)]
        for j, y in enumerate(t, 1):
            row.append(min(last[j] + w(i - 1), row[-1] + w(j - 1), last[j - 1] + (0 if x == y else w(max(i, j) - 1))))
    return row[-1]


def align(s: str, t: str) -> tuple[str, float]:
    """The steps of a global alignment, = match, x substitution, - gap in t, + gap in s; and its score."""
    rows = [[-float(j) for j in range(len(t) + 1)]]
    for i, x in enumerate(s, 1):
        row = [-float(i)]
        for j, y in enumerate(t, 1):
            row.append(max(rows[i - 1][j - 1] + (1 if x == y else -1), rows[i - 1][j] - 1, row[-1] - 1))
        rows.append(row)
    i, j, steps = len(s), len(t), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (1 if s[i - 1] == t[j - 1] else -1):
            steps.append("=" if s[i - 1] == t[j - 1] else "x")
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] - 1:
            steps.append("-")
            i -= 1
        else:
            steps.append("+")
            j -= 1
    return "".join(reversed(steps)), rows[-1][-1]


def smtp(s: str, t: str, penalty: float = 1.0, sigma: float = 2.0) -> float:
    """Similarity measure for text processing over character counts."""
    from collections import Counter

    a, b = Counter(s), Counter(t)
    top = bottom = 0.0
    for ch in a.keys() | b.keys():
        both = a[ch] and b[ch]
        top += 0.5 * (1 + math.exp(-(((a[ch] - b[ch]) / sigma) ** 2))) if both else -penalty
        bottom += 1
    return (top / bottom + penalty) / (1 + penalty) if bottom else 1.0


def measure(function, kind: str = "double"):
    """A pandas UDF of a Python function of two strings; a null gives a null."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for pair in zip(a, b):
            if pair not in seen:
                seen[pair] = None if pair[0] is None or pair[1] is None else function(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype=object if kind == "string" else float)

    return run


MEASURES = {f.__name__: f for f in (jaro, jaro_winkler, needleman_wunsch, needleman_wunsch_unit, smith_waterman, smith_waterman_unit, affine_gap, damerau, damerau_full, weighted_edit, smtp)}

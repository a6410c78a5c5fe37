"""Typo-tolerant lookup: the nearest key of a small vocabulary by unrestricted Damerau-Levenshtein similarity.

Only keys of more than three bytes that have no exact match reach Python, each distinct one of a batch once. Ties go
to the smallest key.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from streetloom.functions.lookups import clean_key, look_up
from streetloom.vocab import tables as v

THRESHOLD = 0.7


def damerau(a: str, b: str) -> int:
    """Edits and exchanges; letters may be edited again after an exchange."""
    seen: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), last
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, last = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[-1][-1]


@functools.lru_cache(50_000)
def nearest(word: str, keys: tuple[str, ...]) -> str | None:
    best: tuple[float, str] | None = None
    for k in keys:
        n = max(len(k), len(word))
        if abs(len(k) - len(word)) > (1 - THRESHOLD) * n + 1e-9:
            continue
        s = 1 - damerau(word, k) / n
        if s >= THRESHOLD and (best is None or (-s, k) < best):
            best = (-s, k)
    return best[1] if best else None


def fuzzy_look_up(c: Column, table: dict[str, str]) -> Column:
    keys = tuple(sorted(table))

    @pandas_udf("string")
    def near(words: pd.Series) -> pd.Series:
        known = {w: table.get(nearest(w, keys)) for w in words.dropna().unique()}
        return words.map(known).astype(object).where(words.notna(), None)

    key = clean_key(c)
    exact = look_up(key, table)
    return F.coalesce(exact, near(F.when(exact.isNull() & (F.octet_length(key) > 3), key)))


def region_fuzzy(c: Column) -> Column:
    return fuzzy_look_up(c, {k: r[1] for k, r in v.regions().items()})


def suffix_short_fuzzy(c: Column) -> Column:
    return fuzzy_look_up(c, {k: s[1] for k, s in v.suffixes().items()})


def suffix_primary_fuzzy(c: Column) -> Column:
    return fuzzy_look_up(c, {k: s[0] for k, s in v.suffixes().items()})

"""Closed-vocabulary lookups as literal maps: Column to Column, row-local. Null means not recognised."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetloom.functions.text import collapse_space
from streetloom.vocab import tables as v


def _quote(x) -> str:
    return ("true" if x else "false") if isinstance(x, bool) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


@functools.lru_cache(None)
def _sql(items: tuple) -> str:
    return "map(" + ",".join(f"{_quote(k)},{_quote(x)}" for k, x in items) + ")"


def look_up(key: Column, table: dict) -> Column:
    """table[key] or null. The set test comes first: most words are no key, and a set is hashed where a map is scanned."""
    return F.when(key.isin(list(table)), F.try_element_at(F.expr(_sql(tuple(table.items()))), key))


def clean_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^a-zA-Z0-9 ]+", ""))


def region_short(c: Column) -> Column:
    return look_up(clean_key(c), {k: r[1] for k, r in v.regions().items()})


def region_primary(c: Column) -> Column:
    return look_up(clean_key(c), {k: r[0] for k, r in v.regions().items()})


def region_street_name(c: Column) -> Column:
    """The primary name of a region that may be part of a street's name."""
    return look_up(clean_key(c), {k: r[0] for k, r in v.regions().items() if r[2]})


def suffix_primary(c: Column) -> Column:
    return look_up(clean_key(c), {k: s[0] for k, s in v.suffixes().items()})


def suffix_short(c: Column) -> Column:
    return look_up(clean_key(c), {k: s[1] for k, s in v.suffixes().items()})


def region_alternates(c: Column) -> Column:
    """All spellings of the region c is, in order and joined by '|'."""
    of = v.spellings_of(v.regions())
    return look_up(clean_key(c), {k: "|".join(of[r]) for k, r in v.regions().items()})


def suffix_alternates(c: Column) -> Column:
    of = v.spellings_of(v.suffixes())
    return look_up(clean_key(c), {k: "|".join(of[x]) for k, x in v.suffixes().items()})


def directional_abbrev(c: Column) -> Column:
    return look_up(F.upper(c), v.directions_short())


def directional_full(c: Column) -> Column:
    return look_up(F.upper(c), v.directions_full())


def unit_normalize(c: Column) -> Column:
    return look_up(F.upper(c), {k: u[0] for k, u in v.units().items()})


def unit_numbered(c: Column) -> Column:
    return look_up(F.upper(c), {k: u[1] for k, u in v.units().items()})


def pr_street_type_full(c: Column) -> Column:
    return look_up(F.upper(collapse_space(c)), {p: p for p in v.PR_STREET_TYPES} | {s: p for p, s in v.PR_STREET_TYPES.items()})


def pr_street_type_abbrev(c: Column) -> Column:
    return look_up(F.upper(collapse_space(c)), v.PR_STREET_TYPES | {s: s for s in v.PR_STREET_TYPES.values()})


def pr_secondary(c: Column) -> Column:
    return look_up(F.upper(collapse_space(c)), v.PR_SECONDARY | {s: s for s in v.PR_SECONDARY.values()})


def pr_postal(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return (F.length(digits) >= 5) & F.substring(digits, 1, 3).isin(*v.PR_ZIP_PREFIXES)


def pr_dialect(region: Column, postal: Column) -> Column:
    return F.coalesce(F.upper(collapse_space(region)) == "PR", F.lit(False)) | F.coalesce(pr_postal(postal), F.lit(False))

"""Record normalisation, formatting, equality and options: one projection each.

A field that isn't recognised doesn't stop a job: the column error names the first such field, in the order
predirectional, postdirectional, street_suffix, secondary_designator, region; the fields are null then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.functions import lookups as look
from streetloom.functions.patterns import highway_normalize, let, pobox_normalize, postal_normalize
from streetloom.functions.text import DiacriticMode, base_field, free_text_field, join_non_empty
from streetloom.operators.fuzzy import region_fuzzy, suffix_short_fuzzy
from streetloom.operators.lastline import FIELDS


@dataclass(frozen=True)
class Options:
    """Everything is resolved while the plan is built."""

    fuzzy: bool = False
    secondary_as_hash: bool = False
    diacritics: DiacriticMode = DiacriticMode.KEEP
    single_line: bool = False
    keep_type: bool = True
    parser: Callable[[DataFrame], DataFrame] | None = None
    verifier: Callable[[DataFrame], DataFrame] | None = None


CONTENT = Options()
MATCHING = Options(secondary_as_hash=True, diacritics=DiacriticMode.SUBSTITUTE)


def with_options(base: Options = CONTENT, **changes) -> Options:
    """Later settings win."""
    return replace(base, **changes)


def matching(base: Options = CONTENT) -> Options:
    """The preset of free-text normalisation for matching, which is fuzzy too."""
    return replace(base, fuzzy=True, secondary_as_hash=True, diacritics=DiacriticMode.SUBSTITUTE)


def street_name(c: Column, mode: DiacriticMode = DiacriticMode.KEEP) -> Column:
    """A street's name: box forms, then directions, regions and suffixes word by word, then highway forms."""
    def words(sn: Column) -> Column:
        parts = F.split(sn, " ")

        def word(w: Column, i: Column) -> Column:
            inner = i < F.size(parts) - 1
            state = F.when((i == 0) & (F.size(parts) <= 2), look.region_street_name(w)).otherwise(F.when(look.region_street_name(w).isNotNull(), look.region_short(w)))
            return F.coalesce(F.when(inner, state), F.when(inner, look.suffix_primary(w)), look.directional_full(w), w)

        return F.when(F.size(parts) == 1, F.coalesce(look.suffix_primary(sn), sn)).otherwise(F.array_join(F.transform(parts, word), " "))

    base = free_text_field(c, mode)
    spelled = let(let(base, lambda b: F.coalesce(pobox_normalize(b), b)), words)
    return F.when(base == "", F.lit("")).otherwise(let(spelled, lambda s: F.coalesce(highway_normalize(s), s)))


def _closed(c: Column, value: Column) -> Column:
    """'' for a blank field, else value (null where it isn't recognised)."""
    return F.when(base_field(c) == "", F.lit("")).otherwise(value)


def normalize_address(df: DataFrame, options: Options = CONTENT) -> DataFrame:
    """df with its twelve fields normalised and the column error; other columns stay. A null field counts as ''.

    Extra columns keep their names; a column named error or type of df is replaced or kept as options.keep_type says."""
    f = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in FIELDS}
    m = options.diacritics
    out = {n: free_text_field(f[n], m) for n in ("business_name", "primary_number", "secondary_number", "city", "country")}
    out["postal"] = postal_normalize(f["postal"])
    out["street_name"] = street_name(f["street_name"], m)
    for n in ("predirectional", "postdirectional"):
        out[n] = _closed(f[n], look.directional_abbrev(base_field(f[n])))
    out["street_suffix"] = _closed(f["street_suffix"], (suffix_short_fuzzy if options.fuzzy else look.suffix_short)(base_field(f["street_suffix"])))
    unit = look.unit_normalize(base_field(f["secondary_designator"]))
    out["secondary_designator"] = _closed(f["secondary_designator"], F.when(unit.isNotNull(), F.lit("#")) if options.secondary_as_hash else unit)
    out["region"] = _closed(f["region"], (region_fuzzy if options.fuzzy else look.region_short)(base_field(f["region"])))
    done = df.withColumns({f"_n_{n}": c for n, c in out.items()})
    error = None
    for n in ("predirectional", "postdirectional", "street_suffix", "secondary_designator", "region"):
        bad = F.col(f"_n_{n}").isNull()
        error = F.when(bad, F.lit(n)) if error is None else error.when(bad, F.lit(n))
    done = done.withColumn("error", error)
    kept = [c for c in df.columns if c not in FIELDS and c != "error" and (c != "type" or options.keep_type)]
    return done.select(*kept, *[F.when(F.col("error").isNull(), F.col(f"_n_{n}")).alias(n) for n in FIELDS], "error")


def format_street_line(type_: Column) -> Column:
    c = F.col
    plain = join_non_empty(" ", *[c(n) for n in ("primary_number", "predirectional", "street_name", "street_suffix", "postdirectional", "secondary_designator", "secondary_number")])
    boxed = join_non_empty(" ", c("street_name"), c("primary_number"))
    rural = join_non_empty(" ", c("street_name"), c("primary_number"), c("secondary_designator"), c("secondary_number"))
    return F.when(type_.isin("po_box", "military"), boxed).when(type_ == "rural_route", rural).otherwise(plain)


def format_last_line() -> Column:
    return join_non_empty(" ", F.col("city"), F.col("region"), F.col("postal"))


def format_address(type_: Column | None = None, single_line: bool = False) -> Column:
    """Business name, street line and last line; the country is never printed."""
    street = format_street_line(type_ if type_ is not None else F.lit(None).cast("string"))
    return join_non_empty(" " if single_line else "\n", F.col("business_name"), street, format_last_line())


def address_equals(a: Column, b: Column) -> Column:
    """Of two structs with type and the twelve fields; null only equals null."""
    same = F.lit(True)
    for n in ["type", *FIELDS]:
        same = same & a[n].eqNullSafe(b[n])
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def as_rural_route(df: DataFrame) -> DataFrame:
    return df.withColumn("type", F.lit("rural_route"))

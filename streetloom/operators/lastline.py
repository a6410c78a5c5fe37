"""Last-line readings and whole-address candidates: array expressions over tokens and claims, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.functions.patterns import let, military_last_line, military_street, pobox_normalize, rural_route_normalize
from streetloom.functions.spans import PART, computed_once, demote, gaps, line_start, token_join

FIELDS = ["business_name", "primary_number", "predirectional", "street_name", "street_suffix", "postdirectional", "secondary_designator", "secondary_number", "city", "region", "postal", "country"]
#: Longest city, in tokens, whose beginning neither a comma nor a line break marks.
MOST_CITY = 4
_MEMBER = "struct<idx:int,start:int,parts:array<" + PART + ">>"
_LINE = f"struct<shape:string,start:int,length:int,confidence:int,parts:array<{PART}>,leftover:array<struct<start:int,length:int>>,members:array<int>>"
#: Confidence of (shape, marked).
_RATES = {"city_region_postal": (100, 90), "city_region": (90, 75), "city_postal": (75, 50), "postal": (90, 90)}


def _ending_at(claims: Column, name: str, end: Column) -> Column:
    """Claims of the one part name that end at end, as ARRAY<MEMBER>."""
    numbered = F.transform(claims, lambda c, i: F.struct(i.cast("int").alias("idx"), c["start"].alias("start"), c["parts"].alias("parts"), c["end"].alias("end")))
    hits = F.filter(numbered, lambda c: (F.size(c["parts"]) == 1) & (F.try_element_at(c["parts"], F.lit(1))["part"] == name) & (c["end"] == end))
    return F.transform(hits, lambda c: F.struct(c["idx"], c["start"], c["parts"])).cast(f"array<{_MEMBER}>")


def _assemble(n: Column, start: Column, shape: str, rate: Column, extra: Column, members: Column) -> Column:
    parts = F.array_sort(F.concat(extra, F.flatten(F.transform(members, lambda m: m["parts"]))))

    def finish(parts: Column) -> Column:
        first = F.least(start, F.coalesce(F.try_element_at(F.transform(parts, lambda p: p["start"]), F.lit(1)), start))

        def rest(left: Column) -> Column:
            return F.struct(F.lit(shape).alias("shape"), first.cast("int").alias("start"), (n - first).cast("int").alias("length"), demote(rate, F.size(left)).cast("int").alias("confidence"), parts.alias("parts"), left.alias("leftover"), F.transform(members, lambda m: m["idx"]).alias("members"))

        return let(gaps(first, n - first, parts), rest)

    return let(parts, finish)


def line_readings(tokens: Column, claims: Column) -> Column:
    """ARRAY<LINE>: every reading of the last line, in order: without a country first, then with each country; for
    each postal code the readings with a region, the code alone, the city before it; then city and region."""
    n = F.size(tokens)
    none = F.array().cast(f"array<{PART}>")

    def cities(shape: str, line: Column, end: Column, members: Column) -> Column:
        starts = F.when(end > line, F.sequence(line, end - 1)).otherwise(F.array().cast("array<int>"))
        comma = lambda i: F.try_element_at(tokens, i + 1)["follows_comma"] >= 0
        starts = F.filter(starts, lambda i: (i == line) | comma(i) | (end - i <= MOST_CITY))

        def reading(i: Column) -> Column:
            marked = comma(i) | ((i == line) & (F.try_element_at(tokens, i + 1)["line"] > 0))
            text = token_join(tokens, i, end - i)
            city = F.struct(i.cast("int").alias("start"), (end - i).cast("int").alias("length"), F.lit("city").alias("part"), F.when(F.upper(text) == "UNKNOWN", F.lit("")).otherwise(F.upper(text)).alias("value"))
            good, poor = _RATES[shape]
            return _assemble(n, i, shape, F.when(marked, good).otherwise(poor), F.array(city).cast(f"array<{PART}>"), members)

        return F.transform(starts, reading)

    def of_country(country: Column) -> Column:
        inner = F.coalesce(country["start"], n)
        tail = F.filter(F.array(country).cast(f"array<{_MEMBER}>"), lambda m: m["idx"] >= 0)

        def of_inner(line: Column) -> Column:
            def of_postal(postal: Column) -> Column:
                both = F.concat(F.array(postal), tail)
                with_region = F.flatten(F.transform(_ending_at(claims, "region", postal["start"]), lambda r: cities("city_region_postal", line, r["start"], F.concat(F.array(r), both))))
                alone = F.array(_assemble(n, line, "postal", F.lit(90), none, both))
                return F.concat(with_region, alone, cities("city_postal", line, postal["start"], both))

            postals = F.flatten(F.transform(_ending_at(claims, "postal", inner), of_postal))
            regions = F.flatten(F.transform(_ending_at(claims, "region", inner), lambda r: cities("city_region", line, r["start"], F.concat(F.array(r), tail))))
            return F.concat(postals, regions)

        return F.when(inner > 0, let(line_start(tokens, inner - 1), of_inner)).otherwise(F.array().cast(f"array<{_LINE}>"))

    absent = F.array(F.struct(F.lit(-1).alias("idx"), F.lit(None).cast("int").alias("start"), none.alias("parts"))).cast(f"array<{_MEMBER}>")
    countries = F.concat(absent, _ending_at(claims, "country", n))
    return F.when(n > 0, F.flatten(F.transform(countries, of_country))).otherwise(F.array().cast(f"array<{_LINE}>")).cast(f"array<{_LINE}>")


def line_rows(df: DataFrame) -> DataFrame:
    """df with tokens and claims: one row per reading, line_id (its place in the list) and line."""
    return df.select("*", F.posexplode(line_readings(F.col("tokens"), F.col("claims"))).alias("line_id", "line"))


def rejections(claims: Column, line: Column) -> Column:
    """Indexes of the claims that a reading rules out: they overlap its span and are none of its members."""
    numbered = F.transform(claims, lambda c, i: F.struct(i.cast("int").alias("i"), c["start"].alias("s"), c["end"].alias("e"), F.size(c["parts"]).alias("n")))
    out = F.filter(numbered, lambda c: (c["n"] > 0) & (c["s"] < line["start"] + line["length"]) & (line["start"] < c["e"]) & ~F.array_contains(line["members"], c["i"]))
    return F.transform(out, lambda c: c["i"])


def rejected_claims(lines: DataFrame) -> DataFrame:
    """lines with one row for each claim a reading rules out, as the column claim."""
    return lines.select("*", F.explode(rejections(F.col("claims"), F.col("line"))).alias("_i")).withColumn("claim", F.element_at("claims", F.col("_i") + 1)).drop("_i")


def assign(parts: Column) -> list[Column]:
    """The twelve address fields from parts; a later part wins, a missing one is ''."""
    def value(name: str) -> Column:
        return F.try_element_at(F.filter(parts, lambda p: p["part"] == name), F.lit(-1))["value"]

    return [F.coalesce(value(f), F.lit("")).alias(f) for f in FIELDS]


def _recognised(kind: str, text: Column) -> Column:
    return {"po_box": pobox_normalize, "rural_route": rural_route_normalize, "military": military_street}[kind](text).isNotNull()


#: Candidate types in the order in which they are tried.
TYPES = ["po_box", "rural_route", "military"]
STREET = f"struct<type:string,type_no:int,claim_no:int,confidence:int,`end`:int,parts:array<{PART}>>"


def street_claims(tokens: Column, claims: Column) -> Column:
    """ARRAY<STREET>: the claims whose words are a street line of a type, once for each type."""
    known = F.filter(F.transform(claims, lambda c, i: F.struct(i.cast("int").alias("claim_no"), c.alias("c"))), lambda x: F.size(x["c"]["parts"]) > 0)
    worded = F.transform(known, lambda x: F.struct(x["claim_no"], x["c"].alias("c"), token_join(tokens, x["c"]["start"], x["c"]["end"] - x["c"]["start"]).alias("text")))

    def typed(x: Column) -> Column:
        one = lambda no, kind: F.struct(F.lit(kind).alias("type"), F.lit(no).alias("type_no"), x["claim_no"].alias("claim_no"), x["c"]["confidence"].alias("confidence"), x["c"]["end"].alias("end"), x["c"]["parts"].alias("parts"))
        return F.filter(F.array(*[F.when(_recognised(kind, x["text"]), one(no, kind)) for no, kind in enumerate(TYPES)]), lambda y: y.isNotNull())

    return F.flatten(F.transform(worded, typed)).cast(f"array<{STREET}>")


def overseas(tokens: Column, line: Column) -> Column:
    """Whether a reading is exactly an overseas last line."""
    value = lambda name: F.transform(F.filter(line["parts"], lambda p: p["part"] == name), lambda p: p["value"])
    last = military_last_line(token_join(tokens, line["start"], line["length"]))
    return F.coalesce((F.size(line["parts"]) == 3) & (value("city") == F.array(last["city"])) & (value("region") == F.array(last["region"])) & (value("postal") == F.array(last["postal"])), F.lit(False))


def fitting(tokens: Column, line: Column, streets: Column) -> Column:
    """Street claims that end before the line; overseas ones ask for an overseas last line."""
    return F.filter(streets, lambda s: (s["end"] <= line["start"]) & ((s["type"] != "military") | overseas(tokens, line)))


def candidate_rows(lines: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Whole-address readings: one row per line reading and street claim of a type that fit together.

    Adds type, type_no, claim_no, confidence, parts, leftover. Tokens the line leaves over were charged there already
    and are charged again here, over all tokens."""
    streets = F.filter(street_claims(F.col("tokens"), F.col("claims")), lambda s: s["type"].isin(kinds or TYPES))
    rows = computed_once(lines, "street", streets).select(*lines.columns, F.explode(fitting(F.col("tokens"), F.col("line"), F.col("street"))).alias("street"))
    parts = F.concat(F.col("line")["parts"], F.col("street")["parts"])
    out = rows.withColumns({"type": F.col("street")["type"], "type_no": F.col("street")["type_no"], "claim_no": F.col("street")["claim_no"], "parts": parts, "leftover": gaps(F.lit(0), F.size("tokens"), parts)})
    return out.withColumn("confidence", demote(F.least(F.col("line")["confidence"], F.col("street")["confidence"]), F.size("leftover"))).drop("street")

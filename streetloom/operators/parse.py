"""Free text to address: the vocabulary sweep, last-line readings and candidates put together, and the plug points.

Box, rural and overseas addresses come from the candidate rules. Ordinary streets are an addition of this engine: the
line before the last line is read as number, direction, name, suffix, direction and unit, at LIKELY confidence.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.functions import lookups as look
from streetloom.functions.patterns import let
from streetloom.functions.spans import computed_once, demote, gaps, line_start, token_join
from streetloom.operators.claims import LIKELY, with_claims, with_tokens
from streetloom.operators.lastline import FIELDS, STREET, assign, fitting, line_readings, street_claims
from streetloom.operators.normalize import CONTENT, Options, format_address, normalize_address
from streetloom.vocab import tables as v

_DIR = "N|S|E|W|NE|NW|SE|SW|NORTH ?EAST|NORTH ?WEST|SOUTH ?EAST|SOUTH ?WEST|NORTH|SOUTH|EAST|WEST"


def _street_pattern() -> str:
    suffix = "|".join(sorted(v.suffixes(), key=lambda k: (-len(k), k)))
    unit = "|".join(sorted(v.units(), key=lambda k: (-len(k), k)))
    return rf"^([0-9][0-9A-Z/-]*)(?: ({_DIR})\.?)?(?: (.+?))??(?: ({suffix})\.?)?(?: ({_DIR})\.?)?(?: ({unit})\.?(?: ?([0-9A-Z-]+))?)?$"


def street_parts(text: Column) -> Column:
    """STRUCT of the street fields of one line; null if it doesn't begin with a number."""
    pattern = _street_pattern()
    names = ["primary_number", "predirectional", "street_name", "street_suffix", "postdirectional", "secondary_designator", "secondary_number"]
    line = F.upper(F.regexp_replace(text, r"[.,]", ""))

    def read(t: Column) -> Column:
        got = {n: F.regexp_extract(t, pattern, i + 1) for i, n in enumerate(names)}
        # a line of number, direction and suffix has the direction for its name
        no_name = (got["street_name"] == "") & (got["predirectional"] != "")
        moved = got | {"street_name": F.when(no_name, got["predirectional"]).otherwise(got["street_name"]), "predirectional": F.when(no_name, "").otherwise(got["predirectional"])}
        return F.when(t.rlike(pattern), F.struct(*[moved[n].alias(n) for n in names]))

    return let(line, read)


_OWN = ["primary_number", "predirectional", "street_name", "street_suffix", "postdirectional", "secondary_designator", "secondary_number"]


def ordinary_streets(tokens: Column, lines: Column) -> Column:
    """ARRAY<STRUCT<before, street, business>>: for each place where a last line begins, the line before it as a street
    address and what stands before that; only those that read as one."""
    starts = F.array_distinct(F.transform(F.filter(lines, lambda x: x["start"] > 0), lambda x: x["start"]))

    def read(before: Column) -> Column:
        def at(first: Column) -> Column:
            return F.struct(before.alias("before"), street_parts(token_join(tokens, first, before - first)).alias("street"), F.upper(token_join(tokens, F.lit(0), first)).alias("business"))

        return let(line_start(tokens, before - 1), at)

    return F.filter(F.transform(starts, read), lambda x: x["street"].isNotNull() & (x["street"]["street_name"] != ""))


def best_reading(tokens: Column, lines: Column, streets: Column, ordinary: Column) -> Column:
    """The best whole-address reading of one text, or null: the most confident one, then a typed one, then the longest
    last line, then the first. Of an ordinary street's readings the one with the clearest last line counts: a city
    that begins at a comma."""
    n = F.size(tokens)

    def candidate(rank, type_no, clear, line, line_no, claim_no, kind, parts, own) -> Column:
        return F.struct(rank.cast("int").alias("rank"), (-type_no).alias("t"), clear.alias("clear"), line["length"].alias("extent"), (-line_no).alias("l"), (-claim_no).alias("c"), kind.cast("string").alias("type"), parts.alias("parts"), own.alias("own"))

    def typed(line: Column, no: Column) -> Column:
        def one(s: Column) -> Column:
            return let(F.concat(line["parts"], s["parts"]), lambda parts: candidate(
                demote(F.least(line["confidence"], s["confidence"]), F.size(gaps(F.lit(0), n, parts))), s["type_no"], F.lit(0), line, no, s["claim_no"], s["type"], parts, _no_street()))

        return F.transform(fitting(tokens, line, streets), one)

    def plain(line: Column, no: Column) -> Column:
        here = F.filter(ordinary, lambda x: x["before"] == line["start"])
        own = lambda x: F.struct(x["business"].alias("business_name"), *[x["street"][f].alias(f) for f in _OWN])
        return F.transform(here, lambda x: candidate(F.least(line["confidence"], F.lit(LIKELY)), F.lit(9), line["confidence"], line, no, F.lit(-1), F.lit(None), line["parts"], own(x)))

    return F.array_max(F.concat(F.flatten(F.transform(lines, typed)), F.flatten(F.transform(lines, plain))))


def _no_street() -> Column:
    return F.lit(None).cast("struct<" + ",".join(f"{f}:string" for f in ["business_name", *_OWN]) + ">")


def parse_addresses(df: DataFrame, id_col: str, text: str = "raw", options: Options = CONTENT) -> DataFrame:
    """One row per row: id, type, the twelve fields, confidence; fields are '' and confidence null where nothing fits.

    Readings and candidates are arrays within the row and the best is their maximum, so nothing is shuffled; every
    stage is computed once. Rows with the same id are parsed each."""
    if options.parser is not None:
        return options.parser(df)
    c = F.col
    out = with_claims(with_tokens(df.select(id_col, text), text).drop(text), ["region", "postal", "country", "pobox", "rural_route", "military"])
    out = computed_once(out, "lines", line_readings(c("tokens"), c("claims")))
    out = computed_once(out, "streets", F.when(F.size("lines") > 0, street_claims(c("tokens"), c("claims"))).otherwise(F.array().cast(f"array<{STREET}>"))).drop("claims")
    out = computed_once(out, "ordinary", ordinary_streets(c("tokens"), c("lines")))
    out = computed_once(out, "best", best_reading(c("tokens"), c("lines"), c("streets"), c("ordinary"))).select(id_col, "best")
    own, fields = c("best")["own"], dict(zip(FIELDS, assign(c("best")["parts"])))
    for f in ["business_name", *_OWN]:
        fields[f] = F.coalesce(own[f], fields[f])
    out = out.select(id_col, c("best")["type"].alias("type"), *[fields[f].alias(f) for f in FIELDS], c("best")["rank"].alias("confidence"))
    return options.verifier(out) if options.verifier is not None else out


def normalize_text(df: DataFrame, id_col: str, text: str = "raw", options: Options = CONTENT) -> DataFrame:
    """Parse, normalise and format: id, formatted, error."""
    done = normalize_address(parse_addresses(df, id_col, text, options), options)
    kind = F.col("type") if "type" in done.columns else None
    return done.select(id_col, F.when(F.col("error").isNull(), format_address(kind, options.single_line)).alias("formatted"), "error")


# --- readings of an external parser ---

LABELS = "array<struct<label:string,value:string>>"


def http_labels(base_url: str, timeout_s: float = 1.0) -> Callable[[str], list[dict]]:
    """A fetch function for a parser service: GET <base>/parse?address=..., a JSON list of label and value."""
    def fetch(text: str) -> list[dict]:
        with urlopen(f"{base_url.rstrip('/')}/parse?address={quote(text)}", timeout=timeout_s) as answer:
            return json.loads(answer.read())

    return fetch


def external_labels(df: DataFrame, id_col: str, text: str, fetch: Callable[[str], list[dict]]) -> DataFrame:
    """(id, labels): fetch is called on each executor for each text, in capitals and with FARM TO MARKET as FM."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "labels": [[{"label": x["label"], "value": x["value"]} for x in fetch((t or "").upper().replace("FARM TO MARKET", "FM"))] for t in pdf["text"]]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, labels {LABELS}").withColumnRenamed("id", id_col)


def split_road(road: Column) -> Column:
    """STRUCT<predirectional, street_name, postdirectional> of a road in capitals; the suffix stays in the name."""
    def of(w: Column) -> Column:
        n = F.size(w)
        marks = F.transform(w, lambda x: look.suffix_short(x))
        at = F.coalesce(F.array_max(F.transform(marks, lambda x, i: F.when(x.isNotNull(), i))), F.lit(-1))
        ahead, behind = F.when(at >= 0, at - 1).otherwise(n), F.when(at >= 0, n - 1 - at).otherwise(n)
        word = lambda i: F.coalesce(F.try_element_at(w, i), F.lit(""))
        two, one = look.directional_abbrev(F.concat(word(F.lit(1)), word(F.lit(2)))), look.directional_abbrev(word(F.lit(1)))
        state = look.region_short(F.concat_ws(" ", word(F.lit(1)), word(F.lit(2))))
        end2, end1 = look.directional_abbrev(F.concat(word(F.lit(-2)), word(F.lit(-1)))), look.directional_abbrev(word(F.lit(-1)))
        room = F.greatest(F.length(F.coalesce(end2, F.lit(""))), F.length(F.coalesce(end1, F.lit(""))))
        lead = (F.when(two.isNotNull() & ((ahead > 2) | ((ahead == 2) & (behind >= room))), 2)
                .when(one.isNotNull() & state.isNull() & ((ahead > 1) | ((ahead == 1) & (behind >= room))), 1).otherwise(0))
        trail = F.when(end2.isNotNull(), 2).when(end1.isNotNull(), 1).otherwise(0)

        def cut(x: Column) -> Column:
            middle = F.slice(w, x["lead"] + 1, F.greatest(n - x["lead"] - x["trail"], F.lit(0)))
            named = F.transform(middle, lambda p, i: F.when((i == at - x["lead"]) & (F.size(middle) > 1), F.coalesce(look.suffix_short(p), p)).otherwise(p))
            pre = F.when(x["lead"] == 2, two).when(x["lead"] == 1, one).otherwise(F.lit(""))
            post = F.when(x["trail"] == 2, end2).when(x["trail"] == 1, end1).otherwise(F.lit(""))
            whole = F.struct(F.lit("").alias("predirectional"), F.try_element_at(w, F.lit(1)).alias("street_name"), F.lit("").alias("postdirectional"))
            return F.when(n < 2, whole).otherwise(F.struct(pre.alias("predirectional"), F.array_join(named, " ").alias("street_name"), post.alias("postdirectional")))

        return let(F.struct(lead.alias("lead"), trail.alias("trail")), cut)

    return let(F.split(road, r"[ \t\n\f\r]+"), of)


def address_from_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    """df with the twelve fields from an external parser's labels and the column error ('secondary_designator' for a
    unit that isn't one). The last value of a label counts; unknown labels are ignored."""
    def value(*names: str) -> Column:
        hits = F.filter(F.col(labels), lambda x: x["label"].isin(*names))
        return F.upper(F.try_element_at(F.transform(hits, lambda x: x["value"]), F.lit(-1)))

    blank = lambda c: F.coalesce(c, F.lit(""))
    unit = value("unit")
    head = F.regexp_extract(unit, r"^(\w+|[^\w ]+)", 1)
    short = look.unit_normalize(head)
    road = let(value("road"), lambda r: F.when(r.isNotNull(), split_road(r)))
    out = df.withColumn("_road", road).withColumn("_unit", short)
    fields = {
        "business_name": blank(value("house")), "primary_number": blank(value("house_number")), "predirectional": blank(F.col("_road")["predirectional"]),
        "street_name": blank(F.coalesce(F.col("_road")["street_name"], value("po_box"))), "street_suffix": F.lit(""), "postdirectional": blank(F.col("_road")["postdirectional"]),
        "secondary_designator": blank(F.coalesce(F.col("_unit"), value("building", "entrance", "staircase", "level"))),
        "secondary_number": blank(F.when(look.unit_numbered(head), F.trim(F.substr(unit, F.length(head) + 1)))),
        "city": blank(value("city")), "region": blank(value("state")), "postal": blank(value("postcode")), "country": blank(value("country")),
    }
    return out.withColumns(fields).withColumn("error", F.when(unit.isNotNull() & F.col("_unit").isNull(), F.lit("secondary_designator"))).drop("_road", "_unit")

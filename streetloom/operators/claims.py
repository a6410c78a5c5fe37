"""Vocabulary sweep: every reading a controlled vocabulary offers for a run of tokens.

Each generator is an expression over the token array and gives an array of claims, so the sweep shuffles nothing and
stays in the JVM. Claims are a bag: one run may be claimed several times, by several vocabularies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.functions import lookups as look
from streetloom.functions.patterns import highway_normalize, let, may_open_highway, military_street, pobox_normalize, postal_classify, rural_route_normalize
from streetloom.functions.spans import CLAIM, PART, claim_end, claim_start, computed_once, indexes, line_end, part, spans, tokenize
from streetloom.vocab import tables as v

EXACT, STRONG, LIKELY, WEAK = 100, 90, 75, 50


def _claim(confidence: Column, *parts: Column) -> Column:
    return F.struct(confidence.cast("int").alias("confidence"), F.array(*parts).cast(f"array<{PART}>").alias("parts"))


def _found(items: Column, value, make) -> Column:
    """make(item, value(item)) flattened, for the items with a value."""
    valued = F.transform(items, lambda s: F.struct(s.alias("s"), value(s).alias("v")))
    return F.flatten(F.transform(F.filter(valued, lambda x: x["v"].isNotNull()), lambda x: make(x["s"], x["v"])))


def _words(tokens: Column) -> Column:
    """ARRAY<STRUCT<start, text, next>>: each token beside the one after it."""
    return F.transform(indexes(F.size(tokens)), lambda i: F.struct(i.alias("start"), F.element_at(tokens, i + 1)["text"].alias("text"), F.try_element_at(tokens, i + 2)["text"].alias("next")))


def region(tokens: Column) -> Column:
    """Runs are only built where the first word begins a name of the vocabulary."""
    opening = sorted({k.split(" ")[0] for k in v.regions()})

    def make(s: Column, short: Column) -> Column:
        name = look.region_street_name(s["text"])
        exact = (s["length"] == 1) & (F.octet_length(s["text"]) == 2)
        first = _claim(F.when(exact, EXACT).otherwise(STRONG), part(s["start"], s["length"], "region", short))
        return F.when(name.isNotNull(), F.array(first, _claim(F.lit(LIKELY), part(s["start"], s["length"], "street_name", name)))).otherwise(F.array(first))

    return _found(spans(tokens, 8, lambda text: look.clean_key(text).isin(opening)), lambda s: look.region_short(s["text"]), make)


def postal(tokens: Column) -> Column:
    return _found(spans(tokens, 2), lambda s: postal_classify(s["text"]), lambda s, x: F.array(_claim(x["confidence"], part(s["start"], s["length"], "postal", x["value"]))))


def country(tokens: Column) -> Column:
    """The raw text is looked up: lower-case names aren't claimed."""
    exact = lambda s: (s["length"] == 1) & (F.octet_length(s["text"]) <= 3)
    return _found(spans(tokens, 2), lambda s: look.look_up(s["text"], v.COUNTRIES), lambda s, x: F.array(_claim(F.when(exact(s), EXACT).otherwise(STRONG), part(s["start"], s["length"], "country", x))))


def directional(tokens: Column) -> Column:
    full = list(v.DIRECTIONS)

    def value(s: Column) -> Column:
        words = F.split(F.upper(s["text"]), " ")
        code = F.array_join(F.transform(words, look.directional_abbrev), "", "?")
        spelled = F.exists(words, lambda w: w.isin(*full))
        known = code.isin(*v.DIRECTIONS.values())
        rank = F.when((s["length"] > 1) & spelled, LIKELY).when((s["length"] > 1) | spelled, STRONG).otherwise(EXACT)
        return let(F.when(known, F.struct(code.alias("code"), rank.alias("rank"))), lambda x: x)

    return _found(spans(tokens, 2), value, lambda s, x: F.array(*[_claim(x["rank"], part(s["start"], s["length"], p, x["code"])) for p in ("predirectional", "postdirectional")]))


def secondary(tokens: Column) -> Column:
    """A numbered designator and the token after it are one claim; the number's look only sets the confidence."""
    def make(s: Column, short: Column) -> Column:
        rank = F.when(F.upper(s["text"]) == short, EXACT).otherwise(STRONG)
        number_like = s["next"].rlike(r"\p{Nd}") | s["next"].rlike(r"^\p{L}$")
        unit = part(s["start"], F.lit(1), "secondary_designator", short)
        numbered = _claim(F.when(number_like, rank).otherwise(LIKELY), unit, part(s["start"] + 1, F.lit(1), "secondary_number", F.upper(s["next"])))
        none = F.array().cast(f"array<struct<confidence:int,parts:array<{PART}>>>")
        return F.when(~look.unit_numbered(s["text"]), F.array(_claim(rank, unit))).when(s["next"].isNull(), none).otherwise(F.array(numbered))

    return _found(_words(tokens), lambda s: look.unit_normalize(s["text"]), make)


def suffix(tokens: Column) -> Column:
    rank = lambda s, x: F.when(look.clean_key(s["text"]) == x, EXACT).otherwise(STRONG)
    return _found(_words(tokens), lambda s: look.suffix_short(s["text"]), lambda s, x: F.array(_claim(rank(s, x), part(s["start"], F.lit(1), "street_suffix", x))))


def highway(tokens: Column) -> Column:
    return _found(spans(tokens, 8, may_open_highway), lambda s: highway_normalize(s["text"]), lambda s, x: F.array(_claim(F.lit(STRONG), part(s["start"], s["length"], "street_name", x))))


def _shortest(tokens: Column, least: int, most: int, value) -> Column:
    """For each start the shortest run on its line that value recognises: ARRAY<STRUCT<s, v>>."""
    def over(texts: Column) -> Column:
        def at(i: Column) -> Column:
            def within(limit: Column) -> Column:
                runs = F.when(limit >= least, F.sequence(F.lit(least), limit)).otherwise(F.array().cast("array<int>"))
                tried = F.transform(F.transform(runs, lambda k: F.struct(i.alias("start"), k.alias("length"), F.array_join(F.slice(texts, i + 1, k), " ").alias("text"))), lambda s: F.struct(s.alias("s"), value(s["text"]).alias("v")))
                return F.slice(F.filter(tried, lambda x: x["v"].isNotNull()), 1, 1)

            return let(F.least(F.lit(most), line_end(tokens, i) - i), within)

        return F.flatten(F.transform(indexes(F.size(texts)), at))

    return let(F.transform(tokens, lambda t: t["text"]), over)


def pobox(tokens: Column) -> Column:
    def make(x: Column) -> Column:
        s, words = x["s"], F.split(x["v"], " ")
        names = F.upper(F.array_join(F.slice(F.split(s["text"], " "), F.lit(1), s["length"] - 1), " "))
        rank = F.when(names.isin(*v.BOX_RESERVED), EXACT).otherwise(STRONG)
        return _claim(rank, part(s["start"], s["length"] - 1, "street_name", F.lit("PO BOX")), part(s["start"] + s["length"] - 1, F.lit(1), "primary_number", F.element_at(words, 3)))

    return F.transform(_shortest(tokens, 2, 4, pobox_normalize), make)


def rural_route(tokens: Column) -> Column:
    """The pattern, and where the line goes on a second claim that takes in the rest of it."""
    texts = F.transform(tokens, lambda t: t["text"])

    def make(x: Column) -> Column:
        s, words = x["s"], F.split(x["v"], " ")
        inner = F.filter(F.sequence(F.lit(0), s["length"] - 1), lambda i: (i > 0) & F.upper(F.element_at(texts, s["start"] + i + 1)).rlike("^(BOX|#|NUMBER|NUM|NO)"))
        split = F.array_min(inner)
        end = line_end(tokens, s["start"])
        route = part(s["start"], split, "street_name", F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, 2)))
        box = lambda stop: part(s["start"] + split, stop - s["start"] - split, "primary_number", F.concat_ws(" ", F.element_at(words, 3), F.element_at(words, 4)))
        stop = s["start"] + s["length"]
        pattern, absorbing = _claim(F.lit(EXACT), route, box(stop)), _claim(F.lit(LIKELY), route, box(end))
        none = F.array().cast(f"array<struct<confidence:int,parts:array<{PART}>>>")
        return F.when(split.isNull(), none).when(end > stop, F.array(pattern, absorbing)).otherwise(F.array(pattern))

    return F.flatten(F.transform(_shortest(tokens, 1, 7, rural_route_normalize), make))


def military(tokens: Column) -> Column:
    texts = F.transform(tokens, lambda t: t["text"])

    def at(i: Column) -> Column:
        text = F.upper(F.element_at(texts, i + 1))
        name = F.when(text.isin(*v.MILITARY_CITIES), F.lit("city")).when(text.isin(*v.MILITARY_REGIONS), F.lit("region"))
        code = F.filter(F.array(_claim(F.lit(EXACT), part(i, F.lit(1), name, text))), lambda c: name.isNotNull())
        line = F.when(i + 4 <= line_end(tokens, i), military_street(F.array_join(F.slice(texts, i + 1, F.lit(4)), " ")))
        street = let(line, lambda x: F.filter(F.array(_claim(F.lit(EXACT), part(i, F.lit(2), "street_name", F.concat_ws(" ", F.slice(F.split(x, " "), 1, 2))), part(i + 2, F.lit(2), "primary_number", F.concat_ws(" ", F.slice(F.split(x, " "), 3, 2))))), lambda c: x.isNotNull()))
        return F.concat(code, street)

    return F.flatten(F.transform(indexes(F.size(tokens)), at))


#: Generators in the order in which their claims are listed.
VOCABULARIES = {"region": region, "postal": postal, "country": country, "directional": directional, "secondary": secondary, "suffix": suffix, "highway": highway, "pobox": pobox, "rural_route": rural_route, "military": military}


def claims_array(tokens: Column, vocabularies: list[str] | None = None) -> Column:
    """ARRAY<CLAIM> of the vocabularies: vocab and seq (its place in the vocabulary's list) identify a claim."""
    def tagged(name: str) -> Column:
        made = VOCABULARIES[name](tokens)
        return F.transform(made, lambda c, i: F.struct(F.lit(name).alias("vocab"), i.cast("int").alias("seq"), c["confidence"].alias("confidence"), claim_start(c["parts"]).cast("int").alias("start"), claim_end(c["parts"]).cast("int").alias("end"), c["parts"].alias("parts"))).cast(f"array<{CLAIM}>")

    return F.concat(*[tagged(n) for n in (vocabularies or VOCABULARIES)])


def with_tokens(df: DataFrame, text: str = "raw") -> DataFrame:
    return computed_once(df, "tokens", tokenize(F.coalesce(F.col(text), F.lit(""))))


def with_claims(df: DataFrame, vocabularies: list[str] | None = None) -> DataFrame:
    """df with tokens, plus the claims array."""
    return computed_once(df, "claims", claims_array(F.col("tokens"), vocabularies))


def claim_rows(df: DataFrame, id_col: str, vocabularies: list[str] | None = None) -> DataFrame:
    """One row per claim part: id, vocab, seq, confidence, part_no, start, length, part, value."""
    one = with_claims(df, vocabularies).select(id_col, F.explode("claims").alias("c"))
    return one.select(id_col, "c.vocab", "c.seq", "c.confidence", F.posexplode("c.parts").alias("part_no", "p")).select(id_col, "vocab", "seq", "confidence", "part_no", "p.start", "p.length", "p.part", "p.value")

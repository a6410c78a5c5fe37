"""Queries of the core operators over addresses and raw_addresses; all columns are flat and named."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.functions import lookups as look
from streetloom.functions import patterns as pat
from streetloom.functions import text as tx
from streetloom.functions.spans import claim_end, claim_start, computed_once, demote, gaps, line_end, line_start, overlaps, token_join
from streetloom.operators import fuzzy
from streetloom.operators.claims import VOCABULARIES, claim_rows, with_claims, with_tokens
from streetloom.operators.lastline import FIELDS, assign, candidate_rows, line_readings, line_rows, rejected_claims, rejections
from streetloom.operators.normalize import CONTENT, MATCHING, address_equals, as_rural_route, format_address, format_last_line, format_street_line, normalize_address, with_options
from streetloom.operators.parse import address_from_labels, external_labels, normalize_text, parse_addresses, split_road
from streetloom.session import spread
from streetloom.session import table as scan

Query = Callable[[SparkSession, str], DataFrame]
C = F.col


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return spread(scan(s, d, name))


def _scalar(t: str, **columns) -> Query:
    """addr_id and the given expressions over table t; each value is a function without arguments."""
    return lambda s, d: scan(s, d, t).select("addr_id", *[f().alias(n) for n, f in columns.items()])


def _address(df: DataFrame) -> DataFrame:
    return df.select("addr_id", "type", *FIELDS)


def _normal(options) -> Query:
    return lambda s, d: normalize_address(_address(table(s, d, "addresses")), options).select("addr_id", *FIELDS, "error")


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return with_tokens(table(s, d, "raw_addresses").select("addr_id", "raw")).select("addr_id", "tokens")


def _swept(s: SparkSession, d: str) -> DataFrame:
    return with_claims(_tokens(s, d), ["region", "postal", "country", "pobox", "rural_route", "military"])


def q_tokenize(s, d):
    return _tokens(s, d).select("addr_id", F.posexplode("tokens").alias("idx", "t")).select("addr_id", "idx", "t.text", "t.line", "t.of_lines", "t.position", "t.follows_comma")


def q_line_end(s, d):
    return _tokens(s, d).select("addr_id", "tokens", F.posexplode("tokens").alias("idx", "t")).select("addr_id", "idx", line_end(C("tokens"), C("idx")).cast("int").alias("line_end"))


def _claims(name: str) -> Query:
    return lambda s, d: claim_rows(_tokens(s, d), "addr_id", [name]).select("addr_id", "confidence", "part_no", C("start").alias("start_at"), "length", "part", "value")


def q_claim_overlaps(s, d):
    """Pairs of region and suffix claims of one address that overlap."""
    df = with_claims(_tokens(s, d), ["region", "suffix"]).select("addr_id", F.filter("claims", lambda c: c["vocab"] == "region").alias("r"), F.filter("claims", lambda c: c["vocab"] == "suffix").alias("s"))
    pairs = df.select("addr_id", F.explode("r").alias("r"), "s").select("addr_id", "r", F.explode("s").alias("s")).where(overlaps(C("r.parts"), C("s.parts")))
    return pairs.select("addr_id", C("r.start").alias("region_start"), C("r.end").alias("region_end"), C("s.start").alias("suffix_start"), F.element_at("r.parts", 1)["part"].alias("part"))


def q_claim_rank(s, d):
    """The best region or postal claim of each address: confidence, then length, then vocabulary and place."""
    df = with_claims(_tokens(s, d), ["region", "postal"])
    order = F.transform("claims", lambda c: F.struct((-c["confidence"]).alias("a"), (c["start"] - c["end"]).alias("b"), (c["vocab"] == "region").cast("int").alias("v"), c["seq"].alias("q"), c["start"].alias("start"), F.element_at(c["parts"], 1)["value"].alias("value")))
    best = F.try_element_at(F.array_sort(order), F.lit(1))
    return df.select("addr_id", best.alias("b")).where("b is not null").select("addr_id", (-C("b.a")).alias("confidence"), C("b.start").alias("start_at"), C("b.value").alias("value"))


def q_span_gaps(s, d):
    """Runs of tokens that no region, postal or suffix claim covers."""
    df = with_claims(_tokens(s, d), ["region", "postal", "suffix"])
    g = gaps(F.lit(0), F.size("tokens"), F.flatten(F.transform("claims", lambda c: c["parts"])))
    return df.select("addr_id", F.explode(g).alias("g")).select("addr_id", C("g.start").alias("start_at"), C("g.length").alias("length"))


def _values(name: str) -> Column:
    return F.array_join(F.transform(F.filter(C("line")["parts"], lambda p: p["part"] == name), lambda p: p["value"]), "|")


def q_line_claims(s, d):
    return line_rows(_swept(s, d)).select("addr_id", C("line.shape").alias("shape"), C("line.start").alias("start_at"), C("line.length").alias("length"), C("line.confidence").alias("confidence"),
                                          *[_values(n).alias(n) for n in ("city", "region", "postal", "country")], F.size("line.leftover").alias("n_leftover"))


def q_line_rejections(s, d):
    return line_rows(_swept(s, d)).select("addr_id", C("line.shape").alias("shape"), C("line.start").alias("start_at"), C("line.length").alias("length"), F.size(rejections(C("claims"), C("line"))).alias("n_rejected"))


def q_rejected_claims(s, d):
    """The claims each reading rules out, by vocabulary and place."""
    return rejected_claims(line_rows(_swept(s, d))).select("addr_id", C("line.shape").alias("shape"), C("line.start").alias("line_start"), C("claim.vocab").alias("vocab"), C("claim.start").alias("claim_start"), C("claim.end").alias("claim_end"), C("claim.confidence").alias("confidence"))


def q_line_best(s, d):
    """The first of the best readings: confidence, then length."""
    lines = computed_once(_swept(s, d), "lines", line_readings(C("tokens"), C("claims")))
    best = F.array_max(F.transform("lines", lambda x, i: F.struct(x["confidence"].alias("confidence"), x["length"].alias("length"), (-i).alias("no"), x["start"].alias("start"))))
    return computed_once(lines, "b", best).where("b is not null").select("addr_id", "b.confidence", C("b.start").alias("start_at"), "b.length")


def _candidates(kind: str) -> Query:
    return lambda s, d: candidate_rows(line_rows(_swept(s, d)), [kind]).select("addr_id", "type", "confidence", F.size("leftover").alias("n_leftover"), *[c for c in assign(C("parts")) if True])


def q_candidate_best(s, d):
    """The most confident typed reading of each address and how many there are."""
    rows = candidate_rows(line_rows(_swept(s, d)))
    return rows.groupBy("addr_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_candidates"))


def q_address_equals(s, d):
    """Records whose content form equals their matching form."""
    df = _address(table(s, d, "addresses"))
    a = normalize_address(df, CONTENT).select("addr_id", F.struct("type", *FIELDS).alias("a"), C("error").alias("e"))
    b = normalize_address(df, MATCHING).select("addr_id", F.struct("type", *FIELDS).alias("b"))
    return a.join(b, "addr_id").where("e is null").select("addr_id", address_equals(C("a"), C("b")).alias("equal"))


def q_format_address(s, d):
    n = normalize_address(_address(table(s, d, "addresses"))).where("error is null")
    return n.select("addr_id", format_street_line(C("type")).alias("street_line"), format_last_line().alias("last_line"), format_address(C("type")).alias("formatted"), format_address(C("type"), True).alias("single_line"))


def q_match_keys(s, d):
    """Addresses by their matching form: copies of each, the hottest forms first in a report."""
    n = normalize_address(_address(table(s, d, "addresses")), MATCHING).where("error is null")
    return n.groupBy(format_address(C("type"), True).alias("match_key")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_error_rates(s, d):
    n = normalize_address(_address(table(s, d, "addresses")))
    return n.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_vocabulary_hits(s, d):
    swept = with_claims(_tokens(s, d)).select(F.explode("claims").alias("c"))
    return swept.groupBy(C("c.vocab").alias("vocab"), C("c.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n_claims"))


def q_parse(s, d):
    return parse_addresses(table(s, d, "raw_addresses"), "addr_id")


def q_normalize_text(s, d):
    return normalize_text(table(s, d, "raw_addresses"), "addr_id")


def q_split_road(s, d):
    road = F.upper(F.concat_ws(" ", "predirectional", "street_name", "street_suffix", "postdirectional"))
    return table(s, d, "addresses").select("addr_id", split_road(F.trim(F.regexp_replace(road, "[ \t\n\f\r]+", " "))).alias("r")).select("addr_id", "r.predirectional", "r.street_name", "r.postdirectional")


def q_token_join(s, d):
    """Every line's words joined by blanks."""
    rows = _tokens(s, d).select("addr_id", "tokens", F.posexplode("tokens").alias("idx", "t")).where("t.position = 0")
    return rows.select("addr_id", C("t.line").alias("line"), token_join(C("tokens"), C("idx"), line_end(C("tokens"), C("idx")) - C("idx")).alias("text"))


def q_line_start(s, d):
    return _tokens(s, d).select("addr_id", "tokens", F.posexplode("tokens").alias("idx", "t")).select("addr_id", "idx", line_start(C("tokens"), C("idx")).cast("int").alias("line_start"))


def _each_claim(s, d) -> DataFrame:
    return _swept(s, d).select("addr_id", F.size("tokens").alias("n"), F.explode("claims").alias("c"))


def q_claim_extent(s, d):
    return _each_claim(s, d).select("addr_id", C("c.vocab").alias("vocab"), claim_start(C("c.parts")).alias("start_at"), claim_end(C("c.parts")).alias("end_at"), (claim_end(C("c.parts")) - claim_start(C("c.parts"))).alias("length"))


def q_demote(s, d):
    """Claims' confidence one, two and three steps down."""
    return _each_claim(s, d).select("addr_id", C("c.vocab").alias("vocab"), C("c.start").alias("start_at"), C("c.confidence").alias("confidence"), *[demote(C("c.confidence"), F.lit(k)).alias(f"down_{k}") for k in (1, 2, 3)])


def q_claims_ending_at(s, d):
    """Claims of one part that end with the text."""
    return _each_claim(s, d).where((F.size("c.parts") == 1) & (C("c.end") == C("n"))).select("addr_id", C("c.vocab").alias("vocab"), C("c.start").alias("start_at"), F.element_at("c.parts", 1)["part"].alias("part"), F.element_at("c.parts", 1)["value"].alias("value"))


def q_city_readings(s, d):
    """The cities that readings of one text propose."""
    rows = line_rows(_swept(s, d)).where(C("line.shape") != "postal")
    return rows.groupBy("addr_id", C("line.start").alias("start_at"), _values("city").alias("city")).agg(F.count(F.lit(1)).alias("n_readings"))


def q_as_rural_route(s, d):
    n = normalize_address(as_rural_route(_address(table(s, d, "addresses")))).where("error is null")
    return n.select("addr_id", "type", format_street_line(C("type")).alias("street_line"))


def q_parse_verified(s, d):
    """The verifier hook: readings without a region or postal code are trusted less."""
    def verifier(df: DataFrame) -> DataFrame:
        return df.withColumn("confidence", F.when((C("region") == "") | (C("postal") == ""), F.least("confidence", F.lit(50))).otherwise(C("confidence")))

    return parse_addresses(table(s, d, "raw_addresses"), "addr_id", options=with_options(CONTENT, verifier=verifier)).select("addr_id", "region", "postal", "confidence")


def _ends(text: str) -> list[dict]:
    """Stands for a parser service: the first word is the house number, the last one the postcode."""
    words = re.findall(r"[^ \t\n\f\r,]+", text)
    return [{"label": "house_number", "value": words[0]}, {"label": "postcode", "value": words[-1]}, {"label": "planet", "value": "x"}] if words else []


def q_external_parser(s, d):
    """Labels from a fetch function on the executors, read as address fields."""
    df = address_from_labels(external_labels(table(s, d, "raw_addresses"), "addr_id", "raw", _ends))
    return df.select("addr_id", "primary_number", "postal", "street_name", "error")


def q_address_from_labels(s, d):
    """Labels served from columns: units are recognised, other labels go to their fields."""
    pair = lambda label, c: F.struct(F.lit(label).alias("label"), c.alias("value"))
    labels = F.filter(F.array(pair("house", C("business_name")), pair("house_number", C("primary_number")), pair("po_box", C("street_name")), pair("unit", F.nullif(F.concat_ws(" ", "secondary_designator", "secondary_number"), F.lit(""))), pair("city", C("city")), pair("state", C("region")), pair("postcode", C("postal")), pair("country", C("country"))), lambda x: x["value"].isNotNull())
    return address_from_labels(table(s, d, "addresses").select("addr_id", labels.alias("labels"))).select("addr_id", *FIELDS, "error")


def _strip(**kw):
    return lambda: tx.strip_punctuation(C("street_name"), **kw)


def core_queries() -> dict[str, Query]:
    rr = lambda: F.concat_ws(" ", "street_name", "primary_number")
    out: dict[str, Query] = {
        "collapse_space": _scalar("addresses", city=lambda: tx.collapse_space(C("city")), street_name=lambda: tx.collapse_space(C("street_name"))),
        "strip_punctuation": _scalar("addresses", plain=_strip(), hyphen=_strip(keep_hyphen=True), slash=_strip(keep_slash=True), both=_strip(keep_hyphen=True, keep_slash=True)),
        "normalize_unknown": _scalar("addresses", city=lambda: tx.normalize_unknown(C("city")), region=lambda: tx.normalize_unknown(C("region"))),
        "base_field": _scalar("addresses", city=lambda: tx.base_field(C("city")), street_name=lambda: tx.base_field(C("street_name"))),
        "join_non_empty": _scalar("addresses", joined=lambda: tx.join_non_empty(" ", *[C(x) for x in ("primary_number", "predirectional", "street_name", "street_suffix")])),
        "diacritics_substitute": _scalar("addresses", city=lambda: tx.diacritics_substitute(C("city")), street_name=lambda: tx.diacritics_substitute(C("street_name"))),
        "diacritics_transliterate": _scalar("addresses", city=lambda: tx.diacritics_transliterate(C("city"))),
        "free_text_field": _scalar("addresses", city=lambda: tx.free_text_field(C("city"), tx.DiacriticMode.SUBSTITUTE)),
        "region_normalize": _scalar("addresses", region=lambda: look.region_short(C("region"))),
        "region_info": _scalar("addresses", short=lambda: look.region_short(C("region")), primary=lambda: look.region_primary(C("region")), street_name=lambda: look.region_street_name(C("region"))),
        "suffix_primary": _scalar("addresses", suffix=lambda: look.suffix_primary(C("street_suffix"))),
        "suffix_short": _scalar("addresses", suffix=lambda: look.suffix_short(C("street_suffix"))),
        "directional_abbrev": _scalar("addresses", direction=lambda: look.directional_abbrev(C("predirectional"))),
        "directional_full": _scalar("addresses", direction=lambda: look.directional_full(C("predirectional"))),
        "unit_info": _scalar("addresses", unit=lambda: look.unit_normalize(C("secondary_designator")), numbered=lambda: look.unit_numbered(C("secondary_designator"))),
        "pr_street_type_full": _scalar("addresses", street_type=lambda: look.pr_street_type_full(C("street_suffix"))),
        "pr_street_type_abbrev": _scalar("addresses", street_type=lambda: look.pr_street_type_abbrev(C("street_suffix"))),
        "pr_secondary": _scalar("addresses", secondary=lambda: look.pr_secondary(C("secondary_designator"))),
        "pr_postal": _scalar("addresses", pr=lambda: look.pr_postal(C("postal"))),
        "pr_dialect": _scalar("addresses", pr=lambda: look.pr_dialect(C("region"), C("postal"))),
        "postal_normalize": _scalar("addresses", postal=lambda: pat.postal_normalize(C("postal"))),
        "postal_classify": _scalar("addresses", postal=lambda: pat.postal_classify(C("postal"))["value"], confidence=lambda: pat.postal_classify(C("postal"))["confidence"]),
        "country_normalize": _scalar("addresses", country=lambda: pat.country_normalize(C("country"))),
        "pobox_normalize": _scalar("addresses", box=lambda: pat.pobox_normalize(rr())),
        "rural_route_normalize": _scalar("addresses", route=lambda: pat.rural_route_normalize(rr())),
        "military_street": _scalar("addresses", street=lambda: pat.military_street(rr())),
        "military_last_line": _scalar("addresses", **{n: (lambda n=n: pat.military_last_line(F.concat_ws(" ", "city", "region", "postal"))[n]) for n in ("city", "region", "postal")}),
        "highway_normalize": _scalar("addresses", highway=lambda: pat.highway_normalize(C("street_name"))),
        "normalize_address_content": _normal(CONTENT),
        "normalize_address_matching": _normal(MATCHING),
        "format_address": q_format_address,
        "address_equals": q_address_equals,
        "upper_unknown": _scalar("addresses", city=lambda: tx.upper_text(C("city")), region=lambda: tx.upper_text(C("region"))),
        "diacritics_normalize": _scalar("addresses", **{m.value: (lambda m=m: tx.diacritics_normalize(C("business_name"), m)) for m in tx.DiacriticMode}),
        "region_alternates": _scalar("addresses", alternates=lambda: look.region_alternates(C("region"))),
        "suffix_info": _scalar("addresses", short=lambda: look.suffix_short(C("street_suffix")), primary=lambda: look.suffix_primary(C("street_suffix")), alternates=lambda: look.suffix_alternates(C("street_suffix"))),
        "unit_normalize": _scalar("addresses", unit=lambda: look.unit_normalize(C("secondary_designator"))),
        "normalize_address_fuzzy": _normal(with_options(CONTENT, fuzzy=True)),
        "normalize_address_untyped": _normal(with_options(CONTENT, keep_type=False)),
        "format_street_line": lambda s, d: q_format_address(s, d).select("addr_id", "street_line"),
        "format_last_line": lambda s, d: q_format_address(s, d).select("addr_id", "last_line"),
        "as_rural_route": q_as_rural_route,
        "tokenize": q_tokenize, "token_join": q_token_join, "line_start": q_line_start, "claim_extent": q_claim_extent, "demote": q_demote, "claims_ending_at": q_claims_ending_at, "city_readings": q_city_readings,
        "parse_verified": q_parse_verified, "external_parser": q_external_parser, "address_from_labels": q_address_from_labels,
        "line_end": q_line_end,
    }
    out |= {f"claims_{n}": _claims(n) for n in VOCABULARIES}
    out |= {
        "claim_overlaps": q_claim_overlaps, "claim_compare_rank": q_claim_rank, "span_gaps": q_span_gaps,
        "line_claims": q_line_claims, "line_rejections": q_line_rejections, "rejected_claims": q_rejected_claims, "line_best": q_line_best,
        "candidates_pobox": _candidates("po_box"), "candidates_rural_route": _candidates("rural_route"), "candidates_military": _candidates("military"), "candidate_best": q_candidate_best,
        "region_fuzzy": _scalar("addresses", region=lambda: fuzzy.region_fuzzy(C("region"))),
        "suffix_short_fuzzy": _scalar("addresses", suffix=lambda: fuzzy.suffix_short_fuzzy(C("street_suffix"))),
        "suffix_primary_fuzzy": _scalar("addresses", suffix=lambda: fuzzy.suffix_primary_fuzzy(C("street_suffix"))),
        "match_keys": q_match_keys, "error_rates": q_error_rates, "vocabulary_hits": q_vocabulary_hits,
        "parse_addresses": q_parse, "normalize_text": q_normalize_text, "split_road": q_split_road,
    }
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured records, normalised for storage and formatted."""
    return q_format_address(spark, sf_dir)

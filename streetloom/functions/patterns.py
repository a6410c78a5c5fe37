"""Recognisers and formatters of address patterns: Column to Column, JVM only. Null means not recognised."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetloom.functions.lookups import look_up
from streetloom.functions.text import base_field, collapse_space, strip_punctuation, upper_text
from streetloom.vocab import tables as v

_ZIP = r"^([0-9]{5})(-?([0-9]{4}))?$"
_CANADIAN = r"^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _zip_shape(compact: Column) -> Column:
    plus = F.regexp_extract(compact, _ZIP, 3)
    canadian = F.replace(compact, F.lit("-"), F.lit(""))
    return (F.when(compact.rlike(_ZIP), F.concat(F.substring(compact, 1, 5), F.when(plus != "", F.concat(F.lit("-"), plus)).otherwise("")))
            .when(canadian.rlike(_CANADIAN), F.concat(F.substring(canadian, 1, 3), F.lit(" "), F.substring(canadian, 4, 3))))


def postal_normalize(c: Column) -> Column:
    """ZIP, ZIP+4 or Canadian form; anything else loses its punctuation but is kept."""
    plain = collapse_space(strip_punctuation(base_field(c), keep_hyphen=True))
    kept = collapse_space(strip_punctuation(base_field(c)))
    return let(plain, lambda p: F.coalesce(_zip_shape(F.replace(p, F.lit(" "), F.lit(""))), kept))


def postal_classify(c: Column) -> Column:
    """STRUCT<value, confidence>; null if c has none of the shapes."""
    compact = F.replace(collapse_space(strip_punctuation(upper_text(c), keep_hyphen=True)), F.lit(" "), F.lit(""))
    shape = let(compact, _zip_shape)
    return let(shape, lambda s: F.when(s.isNotNull(), F.struct(s.alias("value"), F.when(F.length(s) == 5, F.lit(50)).otherwise(F.lit(90)).alias("confidence"))))


def country_normalize(c: Column) -> Column:
    """Domestic spellings become '', the neighbours their names; other names are only cleaned."""
    name = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[+&]", " AND "), r"[ \t\n\f\r]+", " "), "[^a-zA-Z0-9 ]+", ""))
    return let(name, lambda n: F.coalesce(look_up(n, v.COUNTRIES), n))


def pobox_normalize(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.upper(c), r"[ \t\n\f\r]*#[ \t\n\f\r]*", " "), "|".join(v.BOX_DESIGNATORS), "PO BOX")
    return let(text, lambda t: F.when(t.rlike("^PO BOX [0-9A-Z]+$") & ~t.contains("\n"), t))


def rural_route_normalize(c: Column) -> Column:
    w = r"[ \t\n\f\r]"
    text = F.regexp_replace(F.upper(c), rf"R(D|R|FD|FD ROUTE|URAL ROUTE){w}*(#|NUMBER|NUM|NO){w}*", "R$1 ")
    text = F.regexp_replace(text, rf"([0-9A-Z]+){w}*(BOX{w}+)?(#|NUMBER|NUM|NO){w}*", "$1 BOX ")
    text = F.regexp_replace(F.regexp_replace(text, "[^0-9A-Z ]+", ""), " +", " ")
    text = F.regexp_replace(F.regexp_replace(text, "|".join(v.RURAL_DESIGNATORS), "RR"), "(RR|BOX) *0+", "$1 ")
    return F.nullif(F.regexp_extract(text, "^RR [1-9A-Z][0-9A-Z]* BOX [0-9A-Z]+", 0), F.lit(""))


def military_street(c: Column) -> Column:
    text = collapse_space(F.upper(c))
    return let(text, lambda t: F.when(t.rlike(rf"^({'|'.join(v.MILITARY_STREETS)}) [0-9]+ BOX [0-9]+$"), t))


def military_last_line(c: Column) -> Column:
    """STRUCT<city, region, postal>; null if c is no overseas last line."""
    shape = rf"^({'|'.join(v.MILITARY_CITIES)}) ({'|'.join(v.MILITARY_REGIONS)}) ([0-9]{{5}}(-[0-9]{{4}})?)$"
    text = collapse_space(F.upper(c))
    return let(text, lambda t: F.when(t.rlike(shape), F.struct(*[F.regexp_extract(t, shape, i).alias(n) for i, n in ((1, "city"), (2, "region"), (3, "postal"))])))


# --- highways ---

_H, _R, _T = "(?:HWY|HIGHWAY)", "(?:RD|ROAD)", "(?:RT|RTE|ROUTE)"
_D = r"[0-9]+(?:\.[0-9]+)?[A-Z]*"
#: Words of the vocabulary itself are no route designators.
_WORDS = "HWY|HIGHWAY|RD|ROAD|RT|RTE|ROUTE|BYP|BYPASS|FRONTAGE|COUNTY|CNTY|STATE|ST|TOWNSHIP|RANCH|US|FM|INTERSTATE|EXPRESSWAY|SR|CR|TSR|IH|I"
_ANY = rf"(?:{_D}|(?!(?:{_WORDS})(?: |$))[A-Z]+)"
#: (opening words, route designator, what they become), in order of precedence.
_RULES = [
    ("FARM TO MARKET", _ANY, "FM"), (f"{_H} FM", _ANY, "FM"), ("FM", _ANY, "FM"),
    (f"INTERSTATE(?: {_H})?", _D, "INTERSTATE"), ("IH?", _D, "INTERSTATE"),
    (f"US(?: {_H})?", _D, "US HIGHWAY"),
    ("CR", _ANY, "COUNTY ROAD"), (f"(?:COUNTY|CNTY) {_H}", _ANY, "COUNTY HIGHWAY"), (f"(?:COUNTY|CNTY) {_R}", _ANY, "COUNTY ROAD"),
    (f"(?:TSR|TOWNSHIP {_R})", _ANY, "TOWNSHIP ROAD"), (f"RANCH {_R}", _ANY, "RANCH ROAD"),
    (f"(?:STATE|ST) {_H}", _ANY, "STATE HIGHWAY"), (f"(?:STATE|ST) {_R}", _ANY, "STATE ROAD"), (f"(?:STATE|ST) {_T}", _ANY, "STATE ROUTE"),
    ("SR", _D, "STATE ROAD"), ("SR", _ANY, "STATE ROUTE"),
    (_H, _D, "HIGHWAY"), (_R, _D, "ROAD"), (_T, _D, "ROUTE"), ("EXPRESSWAY", _D, "EXPRESSWAY"),
]
_OPENING = "^(?:" + "|".join(dict.fromkeys(o for o, _, _ in _RULES)) + ") "


def may_open_highway(word: Column) -> Column:
    """Whether a highway's name can begin with the word: a cheap test before runs of words are built."""
    openings = {w for o, _, _ in _RULES for w in re.findall(r"[A-Z]{2,}", re.sub(r"\(\?: .*?\)\?", "", o).split(" ")[0])} | {"FARM"}
    states = {k.split(" ")[0] for k in v.state_prefixes()}
    text = collapse_space(F.upper(word))
    return F.substring_index(text, " ", 1).isin(sorted(openings | states | {"I", "IH"})) | text.rlike("^IH?[0-9]+[A-Z]*( |$)")


def _tail(route: Column) -> Column:
    """A route designator and what follows it, with the words after it abbreviated."""
    by = " (?:BYP|BYPASS|BYPA|BYPAS|BYPS)"
    t = F.regexp_replace(route, rf"{by} {_R}(?= |$)", " \u0001 RD")
    t = F.regexp_replace(F.regexp_replace(t, rf"{by}(?= |$)", " BYP"), rf" {_R}(?= |$)", " RD")
    return F.replace(t, F.lit("\u0001"), F.lit("BYPASS"))


def _core(s: Column) -> Column:
    becomes = None
    for opening, route, name in _RULES:
        test = s.rlike(f"^{opening} {route}(?: |$)")
        becomes = F.when(test, F.lit(name)) if becomes is None else becomes.when(test, F.lit(name))
    return F.concat(becomes, F.lit(" "), _tail(F.regexp_replace(s, _OPENING, "")))


def highway_normalize(c: Column) -> Column:
    states = v.state_prefixes()
    names = "|".join(sorted(states, key=lambda k: (-len(k.split()), -len(k), k)))
    several = "|".join(k for k in states if " " in k)
    text = F.regexp_replace(collapse_space(F.upper(c)), r"(?<=^| )(IH?)([0-9]+[A-Z]*)(?= |$)", "$1 $2")

    def with_state(s: Column) -> Column:
        rest = F.regexp_extract(s, f"^(?:{names}) (.+)$", 1)
        state = F.when(s.isin(*several.split("|")), F.lit(None)).otherwise(look_up(F.regexp_extract(s, f"^({names}) .+$", 1), states))
        name = let(F.when(state.isNotNull(), rest), lambda r: F.coalesce(_core(r), F.when(r.rlike(f"^{_D}(?: |$)"), F.concat(F.lit("HIGHWAY "), _tail(r)))))
        return let(name, lambda x: F.when(x.isNotNull(), F.concat(state, F.lit(" "), x)))

    # one test of the first words spares most names the rules
    begins = f"{_OPENING}|^(?:{names}) "
    return let(text, lambda s: F.when(s.rlike(begins), F.coalesce(F.nullif(with_state(s), F.lit("")), _core(s))))

"""Text scalars: Column to Column, JVM only. Null stays null everywhere."""

from __future__ import annotations

import functools
import unicodedata
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, written out: a plain \s would miss the no-break space.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PUNCTUATION = "*,.()\":;`@&'’"


class DiacriticMode(Enum):
    KEEP = "keep"
    SUBSTITUTE = "substitute"
    TRANSLITERATE = "transliterate"


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_punctuation(c: Column, keep_hyphen: bool = False, keep_slash: bool = False) -> Column:
    gone = PUNCTUATION + ("" if keep_hyphen else "-") + ("" if keep_slash else "/")
    return F.translate(c, gone, "")


def normalize_unknown(c: Column) -> Column:
    return F.when(F.upper(c) == "UNKNOWN", F.lit("")).otherwise(c)


def upper_text(c: Column) -> Column:
    return F.upper(normalize_unknown(c))


def base_field(c: Column) -> Column:
    """Collapsed, in capitals, UNKNOWN blanked (also when it was padded)."""
    return upper_text(collapse_space(c))


def free_text_field(c: Column, mode: DiacriticMode = DiacriticMode.KEEP) -> Column:
    return base_field(c) if mode is DiacriticMode.KEEP else F.upper(diacritics_normalize(base_field(c), mode))


def join_non_empty(sep: str, *parts: Column) -> Column:
    """Parts that are neither null nor '' joined by sep."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


# Letters that don't decompose, to the base letter or to their transliteration. The multiplication and
# division signs count as 'o' because the standard's ranges hold them.
_BASE = {"Æ": "a", "æ": "a", "Ð": "e", "ð": "e", "Ø": "o", "ø": "o", "×": "o", "÷": "o", "Œ": "o", "œ": "o", "Þ": "p", "þ": "p", "ß": "s"}
_SPELLED = {"Æ": "ae", "æ": "ae", "Ð": "d", "ð": "d", "Ø": "o", "ø": "o", "Œ": "oe", "œ": "oe", "Þ": "th", "þ": "th", "ß": "ss", "Ł": "l", "ł": "l", "Đ": "d", "đ": "d", "ı": "i", "Ħ": "h", "ħ": "h"}

# Cyrillic and Greek letters in their usual Latin spelling (й is no accented и).
_CYRILLIC = (
    "а a, б b, в v, г g, д d, е e, ж zh, з z, и i, й y, к k, л l, м m, н n, о o, п p, р r, с s, т t, у u, ф f, х kh, ц ts, ч ch, ш sh, щ shch, ы y, э e, ю yu, я ya, "
    "і i, є ye, ґ g, ђ dj, ј j, љ lj, њ nj, ћ c, џ dz, ѕ dz"
)
_GREEK = "α a, β v, γ g, δ d, ε e, ζ z, η i, θ th, ι i, κ k, λ l, μ m, ν n, ξ x, ο o, π p, ρ r, σ s, ς s, τ t, υ y, φ f, χ ch, ψ ps, ω o"
_SPELLED |= {c: x for a, x in (p.split(" ") for p in f"{_CYRILLIC}, {_GREEK}".split(", ")) for c in (a, a.upper())} | {"Ь": "", "ь": "", "Ъ": "", "ъ": ""}


@functools.lru_cache(None)
def _decomposed() -> dict[str, str]:
    """Every precomposed character from U+00C0 to U+1FFF whose decomposition is a character and marks, to that character."""
    out = {}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            out[c] = d[0]
    return out


@functools.lru_cache(None)
def translate_table(mode: DiacriticMode) -> tuple[str, str]:
    """Characters replaced one by one: decompositions first, then the letters that don't decompose."""
    letters = _BASE if mode is DiacriticMode.SUBSTITUTE else {k: v for k, v in _SPELLED.items() if len(v) == 1}
    table = {c: letters.get(d, d) for c, d in _decomposed().items() if mode is DiacriticMode.SUBSTITUTE or len(_SPELLED.get(d, "x")) == 1 and len(_SPELLED.get(c, "x")) == 1} | letters
    keys = sorted(table)
    return "".join(keys), "".join(table[k] for k in keys)


def _lower(c: Column) -> Column:
    """Letter by letter: a capital sigma is the same small one at the end of a word."""
    return F.lower(F.replace(c, F.lit("Σ"), F.lit("σ")))


def diacritics_substitute(c: Column) -> Column:
    """Base letters in lower case; combining marks vanish."""
    a, b = translate_table(DiacriticMode.SUBSTITUTE)
    return _lower(F.regexp_replace(F.translate(c, a, b), r"\p{Mn}+", ""))


def diacritics_transliterate(c: Column) -> Column:
    """Latin, Cyrillic and Greek letters spelled out in lower-case Latin ones (Æ as ae). Scripts without an alphabet of
    their own to spell (Chinese, Japanese and others) stay as they are."""
    out = c
    for d, c0 in sorted(_decomposed().items()):
        if len(_SPELLED.get(c0, "")) > 1 and d not in _SPELLED:
            out = F.replace(out, F.lit(d), F.lit(_SPELLED[c0]))
    for k, v in _SPELLED.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    a, b = translate_table(DiacriticMode.TRANSLITERATE)
    return _lower(F.regexp_replace(F.translate(out, a, b), r"\p{Mn}+", ""))


def diacritics_normalize(c: Column, mode: DiacriticMode) -> Column:
    return {DiacriticMode.KEEP: lambda x: x, DiacriticMode.SUBSTITUTE: diacritics_substitute, DiacriticMode.TRANSLITERATE: diacritics_transliterate}[mode](c)

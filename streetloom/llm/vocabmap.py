"""Problem 7: mapping free-entered values to a canonical list.

Method: an Aho-Corasick automaton over the canonical names and their aliases finds the names mentioned in a value;
the longest non-overlapping mention wins. Aliases are made by rule from the list itself (codes, glued and abbreviated
words, consonants, one slip of the keyboard) and from the public spellings of its kind, so a slip of a longer name is
a mention longer than the shorter name inside it. What has no mention goes to a token-set similarity in which tokens
compare by a keyboard-weighted edit distance. What is still unmatched gets the code NONE and is reported.

A public spelling whose meaning isn't on the list means NONE, unless only its number (HILLS) differs from a listed one.

Only distinct values reach Python: they are counted in the JVM first, and the codes come back by a join that holds
when one value owns a large share of all rows.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.operators.skew import join_counted
from streetloom.vocab import tables

FIELDS = ["region", "street_suffix", "secondary_designator", "predirectional"]
NONE = "NONE"

# Words that fill a field without meaning anything, and usual abbreviations that no rule yields.
PLACEHOLDERS = {"UNKNOWN", "UNK", "NONE", "NA", "N A", "TBD", "X", "XX", "NULL", "OTHER", "NOT GIVEN"}
ALIASES = {
    "region": {
        "ALA": "AL", "ARIZ": "AZ", "ARK": "AR", "CAL": "CA", "CALIF": "CA", "COLO": "CO", "CONN": "CT", "DEL": "DE", "FLA": "FL", "FLOR": "FL", "ILL": "IL", "ILLS": "IL", "IND": "IN", "KAN": "KS", "KANS": "KS", "KENT": "KY", "MASS": "MA",
        "MICH": "MI", "MINN": "MN", "MISS": "MS", "MONT": "MT", "NEB": "NE", "NEBR": "NE", "NEV": "NV", "OKLA": "OK", "ORE": "OR", "OREG": "OR", "PENN": "PA", "PENNA": "PA", "TENN": "TN", "TEX": "TX", "VIRG": "VA", "WASH": "WA", "WIS": "WI", "WISC": "WI", "WYO": "WY",
        "W VA": "WV", "WEST VA": "WV", "D C": "DC", "WASHINGTON DC": "DC", "WASHINGTON D C": "DC", "PTO RICO": "PR", "PORTO RICO": "PR", "ALTA": "AB", "MAN": "MB", "ONT": "ON", "QUE": "QC", "SASK": "SK",
        "AF EUROPE": "AE", "AF PACIFIC": "AP", "AF AMERICAS": "AA", "MILITARY EUROPE": "AE", "MILITARY PACIFIC": "AP", "MILITARY AMERICAS": "AA",
    },
    "street_suffix": {"LA": "LN", "BL": "BLVD", "TR": "TRL", "PKWAY": "PKWY", "TPK": "TPKE", "TERR": "TER", "EXPRWY": "EXPY"},
    "secondary_designator": {"AP": "APT", "SU": "STE", "UN": "UNIT", "BLD": "BLDG", "RO": "RM", "SP": "SPC", "FRT": "FRNT", "LWR": "LOWR", "UPR": "UPPR", "OFF": "OFC"},
    "predirectional": {},
}
#: Spellings of the four main directions that combine to the other four.
_DIRECTIONS = {"N": ["N", "NO", "NOR", "NTH", "NRTH", "NORTH"], "S": ["S", "SO", "SOU", "STH", "SOUTH"], "E": ["E", "EA", "EST", "EAST"], "W": ["W", "WE", "WST", "WEST"]}
#: Rows of a usual keyboard; keys side by side are mistaken for each other.
_KEYS = ("QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM")


def squash(v: str) -> str:
    """Upper case, compatibility forms folded, accents off, full stops dropped, other punctuation to blanks."""
    v = unicodedata.normalize("NFKD", v.upper())
    v = "".join(c for c in v if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").replace(".", "" if not re.search(r"\.\s*\w", v) else " ").replace("'", "").replace("’", "")
    return " ".join(re.sub(r"[^A-Z0-9&]+", " ", v.upper()).replace("&", " AND ").split())


def _skeleton(w: str) -> str:
    return w[0] + re.sub(r"[AEIOU]", "", w[1:]) if w else w


@functools.lru_cache(None)
def _near() -> frozenset:
    out = set()
    for r, row in enumerate(_KEYS):
        for i, a in enumerate(row):
            for rr, j in ((r, i - 1), (r, i + 1), (r + 1, i - 1), (r + 1, i), (r - 1, i), (r - 1, i + 1)):
                if 0 <= rr < 3 and 0 <= j < len(_KEYS[rr]):
                    out.add((a, _KEYS[rr][j]))
    return frozenset(out)


def typing_distance(a: str, b: str, most: float) -> float:
    """Edit distance from b (meant) to a (typed) with cheaper slips: neighbouring key, doubled letter, exchange."""
    near, la, lb = _near(), len(a), len(b)
    if abs(la - lb) * 0.6 > most:
        return 99.0
    prev2, prev = [], [j * 0.9 for j in range(lb + 1)]
    for i in range(1, la + 1):
        cur, x = [i * 0.9], a[i - 1]
        for j in range(1, lb + 1):
            y = b[j - 1]
            d = prev[j - 1] + (0 if x == y else 0.75 if (x, y) in near else 1.1)
            more = 0.6 if (i > 1 and a[i - 2] == x) or (y, x) in near else 0.9  # typed once too often
            d = min(d, prev[j] + more, cur[j - 1] + 0.9)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                d = min(d, prev2[j - 2] + 0.8)
            cur.append(d)
        if min(cur) > most + 0.9:
            return 99.0
        prev2, prev = prev, cur
    return prev[-1]


def allowed(n: int) -> float:
    """The distance at which a typed form of a word of n letters is still that word."""
    return 0.95 if n <= 3 else 1.15 if n <= 5 else 1.95 if n <= 8 else 2.8


def public_spellings(field: str) -> dict[str, tuple[str, str]]:
    """Spelling to (name, short form) in the public vocabulary a field is of."""
    if field == "region":
        return {k: r[:2] for k, r in tables.regions().items()}
    if field == "street_suffix":
        return dict(tables.suffixes())
    if field == "secondary_designator":
        return {k: (k, short) for k, (short, _) in tables.units().items() if k != "#"}
    return {}


def one_slip(name: str) -> set[str]:
    """name with one slip: a letter left out, doubled, exchanged with the next, or its keyboard neighbour beside or for it."""
    out, near = set(), _near()
    for i, c in enumerate(name):
        if c == " ":
            continue
        out |= {name[:i] + name[i + 1:], name[:i] + c + name[i:]}
        for x, y in near:
            if y == c:
                out |= {name[:i] + x + name[i + 1:], name[:i] + x + name[i:], name[:i + 1] + x + name[i + 1:]}
        if i + 1 < len(name) and name[i + 1] != " ":
            out.add(name[:i] + name[i + 1] + c + name[i + 2:])
    return {" ".join(x.split()) for x in out} - {name, ""}


class FieldMapper:
    """Maps values of one field. Built from vocabulary entries (code, label), the same on every executor.

    names holds what is meant by a whole value or a part of it, whole_only what says too little inside a longer value."""

    def __init__(self, field: str, entries: list[tuple[str, str]]):
        import ahocorasick

        self.field = field
        names: dict[str, str] = {}
        self.labels = {squash(label): code for code, label in entries}
        codes = {c for c, _ in entries}
        names |= self.labels
        for code, _ in entries:
            names[squash(code)] = code
        for spelling, (name, short) in public_spellings(field).items():
            other = name[:-1] if name.endswith("S") else name + "S"
            names.setdefault(spelling, self.labels.get(name) or (short if short in codes else None) or self.labels.get(other) or NONE)
        names |= {alias: code for alias, code in ALIASES.get(field, {}).items() if code in codes and names.get(alias, NONE) == NONE}
        if field == "predirectional":
            for a in "NS":
                names |= {s: a for s in _DIRECTIONS[a] if a in codes}
                for b in "EW":
                    names |= {s: b for s in _DIRECTIONS[b] if b in codes}
                    names |= {x + gap + y: a + b for x in _DIRECTIONS[a] for y in _DIRECTIONS[b] for gap in (" ", "") if a + b in codes}
        if field == "region":
            names |= {form: code for name, code in list(names.items()) for form in (f"STATE OF {name}", f"{name} STATE", f"PROVINCE OF {name}", "STATEOF" + name.replace(" ", "")) if form not in names}
        self.names = dict(names)
        whole: dict[str, set[str]] = {}
        # what may stand for a name as a whole: glued words, consonants, beginnings of all its words
        for label, code in self.labels.items():
            words = [w for w in label.split() if w != "OF"]
            whole.setdefault(label.replace(" ", ""), set()).add(code)
            k = _skeleton(label.replace(" ", ""))
            if len(k) >= 3:
                whole.setdefault(k, set()).add(code)
            begins = [{w[:i] for i in range(1, len(w) + 1)} | ({_skeleton(w)} if len(w) > 1 else set()) for w in words]
            if len(words) == 1:
                for x in begins[0]:
                    if len(x) >= 3:
                        whole.setdefault(x, set()).add(code)
            else:
                for combined in itertools.product(*begins):
                    whole.setdefault(" ".join(combined), set()).add(code)
                    if " OF " in label:
                        whole.setdefault(f"{combined[0]} OF {' '.join(combined[1:])}", set()).add(code)
                    if len(words) == 2 and len(combined[0]) <= 2 and 3 <= len("".join(combined)) <= 6:
                        whole.setdefault("".join(combined), set()).add(code)
        self.whole_only = {x: c.pop() for x, c in whole.items() if len(c) == 1 and x not in names}
        # one slip in a name of at least five letters is that name
        slips: dict[str, set[str]] = {}
        for name, code in self.labels.items():
            if len(name) >= 5:
                for x in one_slip(name):
                    slips.setdefault(x, set()).add(code)
            # a name that ends with another one: two slips in the words before it don't make it the other
            for k in range(1, len(name.split())):
                before, rest = " ".join(name.split()[:k]), " ".join(name.split()[k:])
                if rest in self.labels and self.labels[rest] != code:
                    for x in one_slip(before):
                        for y in one_slip(x):
                            slips.setdefault(f"{y} {rest}", set()).add(code)
        self.whole_only |= {x: next(iter(c)) for x, c in slips.items() if len(c) == 1 and x not in names and x not in self.whole_only}
        self.automaton = ahocorasick.Automaton()
        for name, code in names.items():
            self.automaton.add_word(f" {name} ", (name, code, len(name) <= 2))
        for name, code in self.whole_only.items():
            self.automaton.add_word(f" {name} ", (name, code, True))
        self.automaton.make_automaton()
        # names that a typed form may be like, by the number of their letters
        self.like: dict[int, list[tuple[str, str, int]]] = {}
        for n, c in sorted(names.items()):
            if c != NONE and "STATE" not in n and "PROVINCE" not in n and (n in self.labels or len(n) >= 3 and (field != "predirectional" or n in codes)):
                self.like.setdefault(len(n.replace(" ", "")), []).append((n, c, self._bits(n.replace(" ", ""))))

    @staticmethod
    def _bits(s: str) -> int:
        out = 0
        for c in s:
            out |= 1 << (ord(c) & 31)
        return out

    def mentions(self, v: str) -> list[tuple[str, str]]:
        """(name, code) of the longest non-overlapping names in v; some names only as the whole of it."""
        if not self.names:
            return []
        text, hits = f" {v} ", []
        for end, (name, code, whole) in self.automaton.iter(text):
            if not whole or name == v:
                hits.append((end - len(name) - 1, end, name, code))
        out: list[tuple[int, int, str, str]] = []
        for h in sorted(hits, key=lambda h: (-(h[1] - h[0]), h[0])):
            if all(h[1] <= o[0] + 1 or h[0] >= o[1] - 1 for o in out):
                out.append(h)
        return [(h[2], h[3]) for h in sorted(out)]

    @staticmethod
    def token_set_distance(a: list[str], b: list[str], most: float) -> float:
        """How far the tokens typed are from those meant: the nearest tokens pair off, letters of the others count."""
        if len(a) == len(b) == 1:
            return typing_distance(a[0], b[0], most)
        pairs = sorted((typing_distance(x, y, min(most, allowed(len(y)))) / max(len(x), len(y)), i, j) for i, x in enumerate(a) for j, y in enumerate(b))
        used_a, used_b, d = set(), set(), 0.0
        for share, i, j in pairs:
            if share < 0.5 and i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                d += share * max(len(a[i]), len(b[j]))
        return d + 0.9 * (sum(len(x) for i, x in enumerate(a) if i not in used_a) + sum(len(y) for j, y in enumerate(b) if j not in used_b))

    def by_similarity(self, v: str) -> str | None:
        """The code of the name whose token set is nearest, if it is near enough; a set may be glued to one token."""
        whole, best, words = v.replace(" ", ""), [], v.split()
        bits = self._bits(whole)
        for n in range(len(whole) - 3, len(whole) + 4):
            most = allowed(n)
            for name, code, mask in self.like.get(n, ()):
                if (bits ^ mask).bit_count() > 2 * round(most / 0.6):
                    continue
                d = typing_distance(whole, name.replace(" ", ""), most)
                if d > most and len(words) > 1 and " " in name:
                    d = self.token_set_distance(words, name.split(), most)
                if d <= most:
                    best.append((d - 0.02 * (name in self.labels), whole[:1] != name[:1], -n, code))
        return min(best)[3] if best else None

    def decide(self, value: str) -> tuple[str, str]:
        """(code a non-blank value means or NONE, what decided: blank, mention, similarity or none)."""
        v = squash(value)
        if not re.search("[A-Z]", v):
            return NONE, "none"
        if self.field == "secondary_designator":
            v = re.sub(r"(?<=[A-Z])\s*\d+\w*$", "", v)
        # single letters with blanks between ('S E') are one name
        if " " in v and all(len(w) == 1 for w in v.split()) and v not in self.names:
            v = v.replace(" ", "")
        if v in PLACEHOLDERS and v not in self.names:
            return NONE, "none"
        if (m := self.mentions(v)):
            return max(m, key=lambda x: len(x[0]))[1], "mention"
        if (c := self.by_similarity(v)):
            return c, "similarity"
        return NONE, "none"

    def code(self, value: str) -> str:
        return self.decide(value)[0]


def reference_list(vocab: DataFrame, fields: list[str], most_entries: int = 20_000) -> dict[str, list[tuple[str, str]]]:
    """(code, label) by field, on the driver; a list of more than most_entries rows is refused."""
    out: dict[str, list[tuple[str, str]]] = {f: [] for f in fields}
    rows = vocab.where(F.col("field").isin(fields) & F.col("code").isNotNull() & F.col("label").isNotNull()).select("field", "code", "label").limit(most_entries + 1).collect()
    if len(rows) > most_entries:
        raise ValueError(f"the reference list has more than {most_entries} entries")
    for f, code, label in sorted(map(tuple, rows)):
        out[f].append((code, label))
    return out


def map_values(df: DataFrame, id_col: str, vocab: DataFrame, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, field, value) and answers (field, value, code, decided) of every non-blank value in fields that isn't, character for character, a listed code.

    vocab (field, code, label) is a reference list and comes to the driver; more than most_entries rows are refused.
    Null and blank values give no row; values that mean nothing listed give NONE. An empty vocabulary gives NONE.
    """
    fields = fields or FIELDS
    entries = reference_list(vocab, fields)
    listed = {f: [c for c, _ in entries[f]] for f in fields}
    pairs = [F.when(F.col(f).rlike(r"\S") & ~F.coalesce(F.col(f).isin(listed[f]), F.lit(False)), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f in fields]
    rows = df.select(F.col(id_col), F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("x")).select(id_col, "x.field", F.upper(F.trim(F.regexp_replace("x.value", r"\s+", " "))).alias("value"))
    distinct = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("_n"))

    def resolve(batches):
        mappers = {f: FieldMapper(f, e) for f, e in entries.items()}
        for pdf in batches:
            answers = [mappers[f].decide(v) for f, v in zip(pdf["field"], pdf["value"])]
            yield pdf.assign(code=[c for c, _ in answers], decided=[d for _, d in answers])

    # few bytes but much work: a number of partitions that adaptive execution leaves as it is
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mapped = distinct.repartition(parts, F.xxhash64("field", "value")).mapInPandas(resolve, "field string, value string, _n long, code string, decided string")
    return rows, mapped


def p7_found(addresses: DataFrame, vocab: DataFrame) -> DataFrame:
    from streetloom.session import staged

    rows, mapped = map_values(addresses, "addr_id", vocab)
    return join_counted(rows, staged(mapped.drop("decided"), "mapped"), ["field", "value"], "_n").select("addr_id", "field", "code")


def p7_unmatched(addresses: DataFrame, vocab: DataFrame) -> DataFrame:
    """The report: every value that means none of the list, with its number of rows."""
    _, mapped = map_values(addresses, "addr_id", vocab)
    return mapped.where(F.col("code") == NONE).select("field", "value", F.col("_n").alias("n_rows"))


def p7_steps(addresses: DataFrame, vocab: DataFrame) -> DataFrame:
    """How values were decided: field, decided (mention, similarity or none), n_values, n_rows."""
    _, mapped = map_values(addresses, "addr_id", vocab)
    return mapped.groupBy("field", "decided").agg(F.count(F.lit(1)).alias("n_values"), F.sum("_n").alias("n_rows"))

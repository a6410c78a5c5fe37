"""Reading of typed address records into comparable parts, for the linkage of records (problems 1 and 4)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.llm.names import city_key, fold
from streetloom.llm.vocabmap import FIELDS, FieldMapper, reference_list

#: Columns of a record that are read.
SOURCE = ["primary_number", "predirectional", "street_name", "street_suffix", "postdirectional", "secondary_designator", "secondary_number", "city", "region", "postal"]
PARTS = "kind string, number string, predir string, street string, sound string, suffix string, postdir string, unit string, city string, region string, zip string"
PART_NAMES = [p.split()[0] for p in PARTS.split(", ")]
_LEAD = {"ST": "SAINT", "STE": "SAINT", "FT": "FORT", "MT": "MOUNT"}
_SOUND = str.maketrans("BFPVCGJKQSXZDTLMNR", "111122222222334556")
# Spellings of road classes before a number.
_ROADS = [
    (re.compile(r"^(?:U ?S|UNITED STATES) (?:HIGHWAY |HWY |HIWAY |HGWY |ROUTE |RTE |RT )?(\d+\w?)$"), "USHWY"),
    (re.compile(r"^(?:COUNTY|CNTY|CO|CTY) (?:ROAD|RD|HIGHWAY|HWY|ROUTE) (\d+\w?)$|^C ?R (\d+\w?)$"), "CR"),
    (re.compile(r"^(?:STATE|ST) (?:HIGHWAY|HWY|ROUTE|RTE|RT|ROAD|RD) (\d+\w?)$|^S ?(?:R|H) (\d+\w?)$"), "SH"),
    (re.compile(r"^(?:INTERSTATE|I|IH) ?(\d+)$"), "I"),
]
_PO_BOX = re.compile(r"\b(?:P ?O ?BOX|POST OFFICE BOX|P ?O ?B|POBOX|PO BX|P O BX)\b ?#? ?([0-9]\w*)?$")
_RURAL = re.compile(r"^(?:RURAL (?:ROUTE|RTE|RT)|R ?R|RFD|R ?F ?D|RTE|RT|RURAL RD)\b ?#? ?(\d+)?(?: BOX ?#? ?(\w+))?")


def clean(v: str | None) -> str:
    s = re.sub(r"[^A-Z0-9#/]+", " ", fold(v).upper().replace("'", "").replace(".", " ")).strip()
    return "" if s == "UNKNOWN" else s


def sound(words: list[str]) -> str:
    """Initial and consonant classes of the words in sorted order: the same for most misspellings."""
    out = []
    for w in sorted(words):
        codes = re.sub(r"(.)\1+", r"\1", re.sub(r"[AEIOUYHW]", "", w[1:]).translate(_SOUND))
        out.append(w[0] + codes[:3])
    return "".join(out)


class AddressReader:
    """entries: {field: [(code, label)]} of the reference list for regions, suffixes, designators, directions."""

    def __init__(self, entries: dict[str, list[tuple[str, str]]]):
        self.maps = {f: FieldMapper(f, e) for f, e in entries.items()}
        self.memo: dict[tuple[str, str], str] = {}

    def code(self, field: str, value: str) -> str:
        if not value:
            return ""
        hit = self.memo.get((field, value))
        if hit is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            hit = self.maps[field].code(value)
            hit = self.memo[field, value] = "" if hit == "NONE" else hit
        return hit

    def exact(self, field: str, value: str) -> str:
        hit = self.maps[field].names.get(value, "")
        return "" if hit == "NONE" else hit

    def unit(self, designator: str, number: str) -> str:
        """The unit's number, or its designator's code where it has no number."""
        if not number and re.search(r"\d", designator):
            number, designator = designator, ""
        words = number.replace("#", " # ").split()
        while len(words) > 1 and not re.search(r"\d", words[0]) and (words[0] in ("#", "NO", "NUMBER") or self.code("secondary_designator", words[0])):
            words = words[1:]
        n = re.sub(r"[^A-Z0-9]", "", "".join(words))
        if n and (re.search(r"\d", n) or len(n) == 1):
            return n.lstrip("0") or n
        return self.code("secondary_designator", designator or n) or n

    def _designator(self, w: str) -> str:
        if w in ("#", "NO", "NUMBER"):
            return "#"
        if (c := self.exact("secondary_designator", w)):
            return c
        return self.code("secondary_designator", w) if len(w) >= 5 and w not in ("FRONT",) else ""

    def read(self, r: dict) -> tuple:
        number, street = clean(r["primary_number"]), clean(r["street_name"])
        pre, post = clean(r["predirectional"]), clean(r["postdirectional"])
        suffix_text, designator, unit_no = clean(r["street_suffix"]), clean(r["secondary_designator"]), clean(r["secondary_number"])
        city, region, postal = fold(r["city"]), clean(r["region"]), fold(r["postal"]).upper()
        kind = "street"
        zip_ = re.sub(r"[^A-Z0-9]", "", postal)
        zip_ = "" if zip_ == "UNKNOWN" else zip_[:6] if zip_[:1].isalpha() else (zip_.zfill(5) if len(zip_) == 4 else zip_.zfill(9) if len(zip_) == 8 else zip_)[:5]
        region = self.code("region", region)
        words = re.sub(r"[^a-z0-9 ]+", " ", city.replace("'", "")).upper().split()
        if len(words) > 1:
            for k in (3, 2, 1):
                if len(words) > k and (c := self.exact("region", " ".join(words[-k:]))) and (not region or c == region):
                    city, region = " ".join(words[:-k]), c
                    break
        city = city_key(city)
        if not number:
            if (m := re.match(r"(\d+[A-Z]?|\d+ \d/\d) (.+)$", street)):
                number, street = m[1], m[2]
        if (m := _PO_BOX.search(street)) or re.match(r"^(P ?O ?)?BOX\b", number) and not _RURAL.match(street) and not street:
            box = re.sub(r"^.*BOX", "", number).strip() or (m and m[1]) or ""
            return ("box", box.replace(" ", "").lstrip("0"), "", "PO BOX", "PO", "", "", "", city, region, zip_)
        if (m := _RURAL.match(street)) and (m[1] or m[2]) and not re.search(r"[A-Z]{3,}", street[m.end():]):
            box = m[2] or re.sub(r"^.*(BOX|#)", "", number).strip()
            return ("rural", box.replace(" ", "").lstrip("0"), "", f"RR {(m[1] or '').lstrip('0')}", "RR", "", "", "", city, region, zip_)
        street = re.sub(r"\b(\d+) (ST|ND|RD|TH)\b(?=.* |$)", r"\1\2", street) if re.match(r"\d+ (ND|RD|TH)\b", street) else street
        w = street.replace("#", " # ").replace("/", " ").split()
        unit = self.unit(designator, unit_no) if designator or unit_no else ""
        if not unit and len(w) > 1:
            # the unit stands somewhere in the street's name
            at = next((i for i in range(len(w) - 1) if len(w) > 2 and re.search(r"\d", w[i + 1]) and not re.fullmatch(r"\d+(ST|ND|RD|TH)", w[i + 1]) and self._designator(w[i])), -1)
            if at >= 0:
                unit, w = self.unit(w[at], w[at + 1]), w[:at] + w[at + 2:]
            elif (c := self._designator(w[-1])) and c in ("BSMT", "FRNT", "LBBY", "LOWR", "OFC", "PH", "REAR", "SIDE", "UPPR") and len(w) > 1:
                unit, w = c, w[:-1]
            elif (c := self._designator(w[0])) and c in ("BSMT", "FRNT", "LBBY", "LOWR", "OFC", "PH", "REAR", "SIDE", "UPPR") and len(w) > 1:
                unit, w = c, w[1:]
        suffix = self.code("street_suffix", suffix_text)
        pre, post = self.code("predirectional", pre), self.code("predirectional", post)
        joined = self._road(" ".join(w))
        if joined is None and not post and len(w) > 1 and (c := self.exact("predirectional", w[-1])):
            post, w = c, w[:-1]
        if joined is None and len(w) > 1 and (c := self.exact("predirectional", w[0])) and not (pre and pre != c):
            two = self.exact("predirectional", " ".join(w[:2])) if len(w) > 2 else ""
            pre, w = (two, w[2:]) if two else (c, w[1:])
            joined = self._road(" ".join(w))
        elif joined is None and len(w) > 1 and len(w[0]) >= 8 and (c := self.code("predirectional", w[0])) and not pre:
            pre, w = c, w[1:]
        if joined is None and len(w) > 1 and w[-1] not in ("BOX",):
            c = self.exact("street_suffix", w[-1]) or (self.code("street_suffix", w[-1]) if not suffix and len(w[-1]) >= 5 else "")
            if c and (not suffix or c == suffix):
                suffix, w = c, w[:-1]
                while len(w) > 1 and self.exact("street_suffix", w[-1]) == suffix:
                    w = w[:-1]
        if joined is None:
            joined = self._road(" ".join(w))
        if joined is not None:
            # a road's own class word may be repeated as the suffix
            suffix = "" if suffix in ("HWY", "RD") else suffix
            return (kind, number, pre, joined, joined, suffix, post, unit, city, region, zip_)
        w = [_ORDINALS.get(x, x) for x in w]
        if w and w[0] in _LEAD and len(w) > 1:
            w = [_LEAD[w[0]], *w[1:]]
        name = " ".join(sorted(w))
        return (kind, number.replace(" ", ""), pre, name, sound(w), suffix, post, unit, city, region, zip_)

    @staticmethod
    def _road(name: str) -> str | None:
        for pattern, code in _ROADS:
            if (m := pattern.match(name)):
                return f"{code} {next(g for g in m.groups() if g)}"
        return None


def _ordinal_words() -> dict[str, str]:
    """FIRST to NINETYNINTH as written with figures; tens and ones may be glued."""
    ones = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH".split()
    tens = "TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()
    end = lambda n: "TH" if 10 < n % 100 < 14 else {1: "ST", 2: "ND", 3: "RD"}.get(n % 10, "TH")
    out = {w: f"{i}{end(i)}" for i, w in enumerate(ones, 1)}
    for t, word in enumerate(tens, 2):
        out[word[:-1] + "IETH"] = f"{10 * t}TH"
        out |= {word + ones[i - 1]: f"{10 * t + i}{end(10 * t + i)}" for i in range(1, 10)}
    return out


_ORDINALS = _ordinal_words()


def read_parts(df: DataFrame, id_col: str, vocab: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(id, *more, parts): the comparable parts of each record; unknown parts are ''."""
    entries = reference_list(vocab, FIELDS)
    more = more or []
    kept = [f for f in df.select(F.col(id_col).alias("id"), *more).schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def run(batches):
        reader = AddressReader(entries)
        for pdf in batches:
            rows = [reader.read(r) for r in pdf[SOURCE].to_dict("records")]
            yield pd.concat([pdf[["id", *more]].reset_index(drop=True), pd.DataFrame(rows, columns=PART_NAMES)], axis=1)

    source = df.select(F.col(id_col).alias("id"), *more, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SOURCE])
    return source.mapInPandas(run, f"{schema}, {PARTS}")

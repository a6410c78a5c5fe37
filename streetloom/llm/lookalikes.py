"""Problem 3: visually identical text with different characters.

Method: the words of clean values form a vocabulary trie; a weighted edit automaton walks it, in which look-alike
letters, compatibility forms, separate accents and ignorable characters cost nothing, second readings (0 for O) a
quarter and other edits one. The word reached is the canonical spelling, in the case of the original; a word the trie
doesn't hold is normalised by table.

The vocabulary is whole and stays distributed: odd words and vocabulary words meet by a join on their skeleton, in
which characters that can stand for each other are one, and every value is walked over the words it can reach.

Defined results: null and empty texts stay as they are and are no case; words truly written in another script stay;
typographic apostrophes and accented letters in their single-character form stay.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.operators.skew import join_counted
from streetloom.session import staged

FIELDS = ["street_name", "city", "business_name"]
NON_ASCII = r"[^\x00-\x7F]"
#: Values whose words may enter the vocabulary: Latin letters of the usual single-character forms and plain signs.
CLEAN = r"^[A-Za-z0-9À-ÖØ-öø-ſ \t\r\n.,;:'’\"()/#&\-]+$"

# Letters of other scripts beside the Latin letters they look like, capital and small.
_PAIRS = (
    # Cyrillic
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ӀI ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj ԁd һh ӏl ԛq ԝw ѵv ѴV гr кk мm нh тt вb ԍG ԌG ьb ЬB "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo νv ρp υu ιi κk ηn χx γy τt ϲc ϹC ϳj "
    # Armenian, Latin extensions and letter-like signs
    "օo սu ոn հh ցg զq ՍU ՕO ՏS ɑa ɡg ıi ʏY ʀR ɪI ɴN ʟL ʙB ᴀA ᴄC ᴅD ᴇE ᴏO ᴛT ᴜU ᴠV ᴡW ᴢZ ⅼl ⅰi ⅴv ⅹx ⅽc ⅾd ⅿm ℓl ℮e"
)
LOOKALIKE: dict[str, str] = {p[0]: p[1] for p in _PAIRS.split() if len(p) == 2}
#: Second readings, at SECOND_COST each.
ALSO = {"ӏ": "i", "Ӏ": "L", "І": "L", "Ι": "L", "υ": "y", "η": "h", "0": "O", "1": "L"}
SECOND_COST = 0.25
#: What a word may cost to be a vocabulary word: two second readings. A slip costs 1 and isn't what no reader can see.
LIMIT = 0.5
#: Characters of which one can be read as the other, to one of each class.
_CLASSES = ("I1HY0", "LLNUO")
_PLAIN_SIGNS = {"‐": "-", "‑": "-", "−": "-", "－": "-"}
_KEEP = set("ªº²³¹¼½¾™…´¨¸‗")


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


@functools.lru_cache(65536)
def simple(c: str) -> str:
    """One character without a view to its word: ignorables vanish, odd blanks and compatibility forms turn plain."""
    if c < "\u0080":
        return c
    kind = unicodedata.category(c)
    if kind == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️":
        return ""
    if kind == "Zs":
        return " "
    if c in _PLAIN_SIGNS:
        return _PLAIN_SIGNS[c]
    if c not in _KEEP and kind[0] in "LNPS" and (k := unicodedata.normalize("NFKC", c)) != c and " " not in k:
        return k
    return c


def cells(text: str) -> list[str]:
    """Every character with the accents after it, in its plain single-character form; '' for an ignorable one."""
    out: list[str] = []
    for c in text:
        p = simple(c)
        if out and p and unicodedata.combining(p[0]):
            at = next((k for k in range(len(out) - 1, -1, -1) if out[k]), None)  # ignorables may stand between
            if at is not None:
                out[at] = unicodedata.normalize("NFC", out[at] + p)
                out.append("")
                continue
        out.append(p)
    return out


def skeleton(word: list[str]) -> str:
    """The same for a word and every vocabulary word it can be read as."""
    t = "".join(LOOKALIKE.get(c, c) for p in word for c in p)
    return t.upper().translate(str.maketrans(*_CLASSES))


def _runs(plain: list[str]) -> list[tuple[int, int]]:
    """(from, to) of the words among cells; ignorables inside belong to the word."""
    out, i, n = [], 0, len(plain)
    while i < n:
        j = i
        while j < n and (not plain[j] and j > i or plain[j] and all(c.isalnum() or c in "’'" for c in plain[j])):
            j += 1
        if j > i:
            out.append((i, j))
        i = max(j, i + 1)
    return out


def odd_skeletons(text: str) -> list[str]:
    """Skeletons of the words of text that have anything but ASCII."""
    plain = cells(text)
    return sorted({skeleton(plain[a:b]) for a, b in _runs(plain) if not text[a:b].isascii()} - {""})


class Words:
    """A vocabulary trie and the automaton that walks it."""

    def __init__(self, words: dict[str, int]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for w, n in words.items():
            self.trie.add_word(w, n)
        self.memo: dict[tuple, tuple[str, str] | None] = {}

    def walk(self, word: tuple[str, ...], limit: float) -> tuple[str, str] | None:
        """(vocabulary word, it in the case of the cells) of least cost within the limit; ties go to the frequent one."""
        key = word, limit
        if key not in self.memo:
            self.memo[key] = self._walk(word, limit)
        return self.memo[key]

    def _walk(self, word: tuple[str, ...], limit: float) -> tuple[str, str] | None:
        best: list[tuple[float, int, str, str]] = []
        stack, done = [(0, "", 0.0, "")], {}
        while stack:
            i, prefix, cost, out = stack.pop()
            if cost > limit or done.get((i, prefix), 9e9) <= cost:
                continue
            done[i, prefix] = cost
            if i == len(word):
                if prefix and self.trie.exists(prefix):
                    best.append((cost, -self.trie.get(prefix), prefix, out))
                continue
            c = word[i]
            if not c:  # an ignorable costs nothing
                stack.append((i + 1, prefix, cost, out))
                continue
            readings = [(c, 0.0)]
            if c in LOOKALIKE:
                readings.append((LOOKALIKE[c], 0.0))
            if c in ALSO:
                readings.append((ALSO[c].lower() if c.islower() else ALSO[c].upper(), SECOND_COST))
            for x, more in readings:
                if self.trie.match(prefix + x.upper()):
                    stack.append((i + 1, prefix + x.upper(), cost + more, out + x))
            if cost + 1 <= limit:
                stack.append((i + 1, prefix, cost + 1, out))
                for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
                    if self.trie.match(prefix + x):
                        y = x.lower() if c.islower() else x
                        stack += [(i + 1, prefix + x, cost + 1, out + y), (i, prefix + x, cost + 1, out + y)]
        if not best:
            return None
        _, _, w, out = min(best)
        return w, out

    def canonical(self, text: str) -> str:
        """text in its one consistent form; text itself if it has none but plain characters."""
        if text.isascii():
            return text
        plain = cells(text)
        spans = _runs(plain)
        kinds = [self._kind("".join(plain[a:b])) for a, b in spans]
        genuine = "foreign" in kinds
        out, last = [], 0
        for (a, b), kind in zip(spans, kinds):
            if text[a:b].isascii():
                continue
            word = None
            if kind in ("latin", "mixed") or kind == "whole" and not genuine:
                word = self.walk(tuple(plain[a:b]), LIMIT)
            if word is not None:
                out += ["".join(plain[last:a]), word[1]]
                last = b
            elif kind == "mixed":
                out += ["".join(plain[last:a]), "".join(LOOKALIKE.get(c, c) for c in "".join(plain[a:b]))]
                last = b
        return "".join(out) + "".join(plain[last:])

    @staticmethod
    def _kind(word: str) -> str:
        """latin, mixed (look-alikes among Latin letters), whole (look-alikes only), odd or foreign (truly another script)."""
        other = [c for c in word if c.isalpha() and not c.isascii() and (c in LOOKALIKE or _script(c) != "LATIN")]
        if not other:
            return "latin"
        if any(c not in LOOKALIKE for c in other):
            return "odd" if any(c.isalpha() and c.isascii() for c in word) else "foreign"
        mixed = len({_script(c) for c in other}) > 1 or any(c.isalpha() and c not in LOOKALIKE for c in word)
        return "mixed" if mixed else "whole"


def picked(values, counts, keep: list[bool], **more: list) -> pd.DataFrame:
    """(value, _n) and more of the kept rows, as plain columns: an empty pick of a string column is no Arrow array."""
    rows = [k for k, x in enumerate(keep) if x]
    values, counts = list(values), list(counts)
    out = {"value": pd.Series([values[k] for k in rows], dtype=object), "_n": pd.Series([counts[k] for k in rows], dtype="int64")}
    return pd.DataFrame(out | {c: pd.Series([x[k] for k in rows], dtype=object) for c, x in more.items()})


def clean_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(v, n): distinct clean values of the fields with their counts, as a written table."""
    values = df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("v")).where(F.col("v").rlike(CLEAN)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return staged(values, "clean")


def vocabulary(values: DataFrame) -> DataFrame:
    """(skeleton, w, n): upper-case words of clean values, all of them."""
    words = values.select(F.explode(F.split(F.upper("v"), r"[^\p{L}\p{N}’']+")).alias("w"), "n").where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"))
    return words.select(F.translate("w", *_CLASSES).alias("skeleton"), "w", "n")


def with_words(distinct: DataFrame, words: DataFrame) -> DataFrame:
    """(value, _n, words MAP<word, count>): each value with the vocabulary words that its odd words can be read as."""
    # few bytes but much work: a number of partitions that adaptive execution leaves as it is
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(skeletons=[odd_skeletons(v) for v in pdf["value"]])

    keyed = staged(distinct.repartition(parts, F.xxhash64("value")).mapInPandas(run, "value string, _n long, skeletons array<string>"), "skeletons")
    wanted = keyed.select(F.explode("skeletons").alias("skeleton")).distinct()
    found = staged(words.join(wanted, "skeleton").groupBy("skeleton").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("found")), "reachable")
    flat = keyed.select("value", "_n", F.explode_outer("skeletons").alias("skeleton")).join(found, "skeleton", "left")
    each = flat.groupBy("value").agg(F.first("_n").alias("_n"), F.flatten(F.collect_list(F.map_entries("found"))).alias("entries"))
    return each.select("value", "_n", F.map_from_entries("entries").alias("words")).repartition(parts, F.xxhash64("value"))


def words_of(column: pd.Series) -> Words:
    """The trie of a batch: a value reaches no words but its own, so it doesn't matter which others are there."""
    out: dict[str, int] = {}
    for m in column:
        out.update(m)
    return Words(out)


def odd_values(df: DataFrame, id_col: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, field, value) of the fields with a character beyond ASCII, and the distinct values with their counts."""
    pairs = [F.when(F.col(f).rlike(NON_ASCII), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f in fields]
    rows = df.select(F.col(id_col), F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("x")).select(id_col, "x.field", "x.value")
    return rows, rows.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))


def look_alikes(df: DataFrame, id_col: str = "addr_id", fields: list[str] | None = None) -> DataFrame:
    """(id, field, value, canonical) of every field whose characters differ from the plain ones that look the same.

    Fields that were decoded wrongly (problem 5) are no cases."""
    from streetloom.llm.encodings import train

    fields = fields or FIELDS
    values = clean_values(df, FIELDS)
    model = df.sparkSession.sparkContext.broadcast(train(values))  # bounded, see train
    rows, distinct = odd_values(df, id_col, fields)

    def judge(batches):
        m = model.value
        for pdf in batches:
            w = words_of(pdf["words"])
            canonical = [w.canonical(v) for v in pdf["value"]]
            keep = [c != v and not m.wrongly_decoded(v, w) for v, c in zip(pdf["value"], canonical)]
            yield picked(pdf["value"], pdf["_n"], keep, canonical=canonical)

    cases = staged(with_words(distinct, vocabulary(values)).mapInPandas(judge, "value string, _n long, canonical string"), "lookalikes")
    return join_counted(rows, cases, ["value"], "_n").select(id_col, "field", "value", "canonical")


def p3_found(addresses: DataFrame) -> DataFrame:
    return look_alikes(addresses).select("addr_id", "field")

"""Problem 5: garbled text from wrong character encoding.

Method: a smoothed character trigram model is trained on clean records. For every value with characters beyond
ASCII each chain "encode back with the wrong coding, decode with the right one" (one or two steps) gives a
candidate; the likeliest one is accepted when it beats the text as it stands (or its look-alike form, problem 3)
by more than a margin validated on all records, garbled on purpose and each judged by a model that hasn't seen it.

Defined results: null, empty and ASCII values are no cases; a replacement character is always a case, and its
letters are restored when the model prefers one filling by the margin, else the original is null.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.llm.lookalikes import NON_ASCII, Words, clean_values, odd_values, picked, vocabulary, with_words, words_of
from streetloom.operators.skew import join_counted
from streetloom.session import staged

FIELDS = ["street_name", "city"]
#: Clean values of these fields train the model.
TRAINED = ["street_name", "city", "business_name"]
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "koi8-r")
RIGHT = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850")
#: Log-odds against a text being garbled: one of ten with characters beyond ASCII is.
PRIOR = math.log(9)
#: Parts of the values; each part is judged by a model of the other ones.
FOLDS = 5
#: (right, wrong) codings by which values are garbled to validate the margin.
CHAINS = (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"))
_LOST = "�"
#: Characters of garbled text that have a case, as they stand for bytes.
_RECASED = [str.maketrans(a, b) for a, b in (("ŠŒŽ", "šœž"), ("šœž", "ŠŒŽ"), ("ãâåг", "ÃÂÅГ"), ("ãâåгŠŒŽ", "ÃÂÅГšœž"))]


def _tables() -> dict[str, tuple[dict[str, int], list[str]]]:
    """For each single-byte coding: character to byte and byte to character; undefined bytes stay control characters."""
    out = {}
    for name in {*WRONG, *RIGHT} - {"utf-8"}:
        chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
        out[name] = ({c: b for b, c in reversed(list(enumerate(chars)))}, chars)
    return out


class EncodingModel:
    """Trigram counts, the margin, and the judgement of one value."""

    def __init__(self, trigrams: dict[str, int], margin: float = 0.0):
        self.margin = margin
        self.c3 = trigrams
        self.c2: dict[str, int] = defaultdict(int)
        self.c1: dict[str, int] = defaultdict(int)
        self.x2: dict[str, int] = defaultdict(int)
        for t, n in trigrams.items():
            self.c2[t[:2]] += n
            self.x2[t[1:]] += n
            self.c1[t[2:]] += n
        self.c2, self.x2, self.c1 = dict(self.c2), dict(self.x2), dict(self.c1)
        self.by1: dict[str, int] = defaultdict(int)
        for t, n in self.x2.items():
            self.by1[t[0]] += n
        self.by1 = dict(self.by1)
        self.total = sum(self.c1.values()) or 1
        self.codes = _tables()
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return (self.c3, self.margin)

    def __setstate__(self, s):
        self.__init__(*s)

    def score(self, text: str) -> float:
        """Log-likelihood; Witten-Bell-like interpolation with a uniform floor over 4000 characters."""
        t, memo, out = f"\u0002\u0002{text.lower()}\u0003", self.memo, 0.0
        if len(memo) > 300_000:
            memo.clear()
        for i in range(2, len(t)):
            g = t[i - 2:i + 1]
            if (p := memo.get(g)) is None:
                p = memo[g] = self._log_p(g)
            out += p
        return out

    def _log_p(self, g: str) -> float:
        ab, b, c = g[:2], g[1], g[2]
        p = 0.999 * self.c1.get(c, 0) / self.total + 0.001 / 4000
        p = (self.x2.get(b + c, 0) + 4 * p) / (self.by1.get(b, 0) + 4)
        p = (self.c3.get(g, 0) + 4 * p) / (self.c2.get(ab, 0) + 4)
        return math.log(p)

    def decoded(self, text: str) -> list[str]:
        """What one encode-decode step can make of text, each result once."""
        out: dict[str, bool] = {}
        for w in WRONG:
            to = self.codes[w][0]
            try:
                raw = bytes([to[c] if c in to else _byte(c) for c in text])
            except (KeyError, ValueError):
                continue
            for r in RIGHT:
                if r == w:
                    continue
                if r == "utf-8":
                    try:
                        t = raw.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                else:
                    chars = self.codes[r][1]
                    t = "".join([chars[b] for b in raw])
                if t != text and t not in out:
                    out[t] = not any(map(_no_text, t))
        return [t for t, is_text in out.items() if is_text]

    def best(self, text: str, words: Words | None = None) -> tuple[str, float]:
        """(likeliest candidate, how much likelier it is than the text or its look-alike form)."""
        here = self.score(text)
        if words is not None and (plain := words.canonical(text)) != text:
            here = max(here, self.score(plain))
        found: dict[str, float] = {}
        steps = self.decoded(text)
        for change in _RECASED:  # the case may have been changed after the wrong decoding
            if (other := text.translate(change)) != text:
                steps += self.decoded(other)
        for t in steps:
            if t not in found:
                found[t] = self.score(t)
                if n := _beyond_ascii(t):
                    for u in self.decoded(t):
                        if u not in found and u != text and _beyond_ascii(u) < n:
                            found[u] = self.score(u) - 1.0  # a second step is less likely
        if not found:
            return text, float("-inf")
        t = max(found, key=lambda k: (found[k], k))
        return t, found[t] - here

    def wrongly_decoded(self, text: str, words: Words | None = None) -> bool:
        return _LOST in text or self.best(text, words)[1] > self.margin

    def refill(self, text: str) -> str | None:
        """A text with lost characters, filled with the letters the model clearly prefers; else null."""
        letters = [c for c in self.c1 if not c.isascii()]
        while (i := text.find(_LOST)) >= 0:
            upper = sum(c.isupper() for c in text) > sum(c.islower() for c in text) or i == 0 and text[1:2].islower()
            tries = sorted(((self.score(text[:i] + c + text[i + 1:].replace(_LOST, c)), c) for c in letters), reverse=True)
            if not tries or len(tries) > 1 and tries[0][0] - tries[1][0] < 1.0:
                return None
            c = tries[0][1]
            text = text[:i] + (c.upper() if upper and len(c.upper()) == 1 else c) + text[i + 1:]
        return text

    def restored(self, text: str, words: Words | None = None) -> str | None:
        if _LOST in text:
            return self.refill(text)
        t, gain = self.best(text, words)
        return t if gain > self.margin else None


@functools.lru_cache(65536)
def _no_text(c: str) -> bool:
    return unicodedata.category(c) in ("Cc", "Co", "Cn") and c not in "\t\r\n"


def _beyond_ascii(text: str) -> int:
    return len(text) - len(text.encode("ascii", "ignore"))


def _byte(c: str) -> int:
    if ord(c) < 256 and (ord(c) < 128 or 0x80 <= ord(c) < 0xA1 or ord(c) == 0xAD):
        return ord(c)
    raise ValueError


def trigrams(values: DataFrame, *held_out: Column) -> list[tuple]:
    """(trigram, count, count outside each held_out) of values (v, n), on the driver.

    Clean values have under 160 characters in lower case, hence at most 4 million trigrams at any size (of names, some
    ten thousand)."""
    text = F.concat(F.lit("\u0002\u0002"), F.lower("v"), F.lit("\u0003"))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: text.substr(i, F.lit(3)))
    outside = [F.when(h, 0).otherwise(F.col("n")).alias(f"m{k}") for k, h in enumerate(held_out)]
    counted = values.select(F.explode(grams).alias("g"), "n", *outside).groupBy("g").agg(F.sum("n"), *[F.sum(f"m{k}") for k in range(len(held_out))])
    return [tuple(r) for r in counted.collect()]


def garbled_values(values: DataFrame, model: EncodingModel) -> DataFrame:
    """Those of the clean-looking values (v, n, h) that are garbled: they decode to a likelier value seen more often."""
    shared = values.sparkSession.sparkContext.broadcast(model)
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def decode(batches):
        for pdf in batches:
            best = [shared.value.best(v) for v in pdf["v"]]
            yield pdf.assign(meant=pd.Series([t.lower() if gain > 0 else None for t, gain in best], index=pdf.index, dtype=object))

    suspects = staged(values.where(F.col("v").rlike(NON_ASCII)).repartition(parts, F.xxhash64("v")).mapInPandas(decode, "v string, n long, h long, meant string").where("meant is not null"), "suspects")
    seen = values.groupBy(F.lower("v").alias("meant")).agg(F.sum("n").alias("often"))
    return staged(suspects.join(seen, "meant").where("often > n").select("v", "n", "h"), "garbled")


def train(values: DataFrame) -> EncodingModel:
    """Train on the distinct clean values (v, n); the margin is validated on all of them that have a character beyond
    ASCII, as the values to be judged do, each with a model of the folds it isn't in.

    Values that look clean but are garbled are found with a first model and taken out of the counts again.
    """
    values = values.withColumn("h", F.pmod(F.xxhash64("v"), F.lit(1_000_003)))
    fold = F.pmod(F.col("h"), F.lit(FOLDS)).cast("int")
    folds = [fold == k for k in range(FOLDS)]
    grams = {g: counts for g, *counts in trigrams(values, *folds)}
    garbled = garbled_values(values, EncodingModel({g: c[0] for g, c in grams.items()}))
    for g, *less in trigrams(garbled, *folds):
        grams[g] = [n - m for n, m in zip(grams[g], less)]
    odd = values.where(F.col("v").rlike(NON_ASCII)).join(garbled.select("v"), "v", "left_anti").select("v", "n", fold.alias("fold"))
    return EncodingModel({g: c[0] for g, c in grams.items() if c[0]}, validated_margin(gains(odd, grams)))


def gains(odd: DataFrame, grams: dict[str, list[int]]) -> DataFrame:
    """(g, clean, garbled): how many rows of the values (v, n, fold) gain g by decoding as they are, and when garbled by
    one of the CHAINS; both in parts of a row, as many as there are chains. Gains below 0 count as 0.

    grams has each trigram's count and the counts outside each fold."""
    shared = odd.sparkSession.sparkContext.broadcast(grams)
    parts = max(1, int(odd.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        models: dict[int, EncodingModel] = {}
        for pdf in batches:
            out = []
            for v, n, k in zip(pdf["v"], pdf["n"], pdf["fold"]):
                if k not in models:
                    models[k] = EncodingModel({g: c[k + 1] for g, c in shared.value.items() if c[k + 1]})
                model = models[k]
                out.append((max(0.0, model.best(v)[1]), n * len(CHAINS), 0))
                out += [(max(0.0, model.best(bad)[1]), 0, n) for bad in garbled_forms(v, model.codes)]
            yield pd.DataFrame(out, columns=["g", "clean", "garbled"])

    each = odd.repartition(parts, F.xxhash64("v")).mapInPandas(run, "g double, clean long, garbled long")
    return staged(each.groupBy("g").agg(F.sum("clean").alias("clean"), F.sum("garbled").alias("garbled")), "gains")


def garbled_forms(v: str, codes: dict) -> list[str]:
    """v garbled by each of the CHAINS that can write it and changes it."""
    out = []
    for right, wrong in CHAINS:
        try:
            raw = v.encode(right)
        except UnicodeEncodeError:
            continue
        bad = "".join([codes[wrong][1][b] for b in raw])
        if bad != v:
            out.append(bad)
    return out


def validated_margin(gained: DataFrame) -> float:
    """The margin with the fewest errors among all gains (g, clean, garbled), 0 and PRIOR; a clean value taken for garbled
    counts three times. Among equally good ones it is the one nearest to PRIOR, which is what a text's chance to be garbled
    asks for without any values.

    Running sums are taken within buckets of one unit of g, of which there are as many as a value's likelihood allows
    (some thousands), and over the sums of the buckets."""
    always = gained.sparkSession.createDataFrame([(0.0, 0, 0), (PRIOR, 0, 0)], gained.schema)
    points = gained.unionByName(always).groupBy("g").agg(F.sum("clean").alias("clean"), F.sum("garbled").alias("garbled")).withColumn("bucket", F.floor("g"))
    sums = points.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("garbled").alias("garbled"))
    here = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    there = Window.orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    sums = sums.select("bucket", F.sum("clean").over(there).alias("clean_from"), F.coalesce(F.sum("garbled").over(here), F.lit(0)).alias("garbled_to"))
    within = Window.partitionBy("bucket").orderBy("g")
    wrong = 3 * (F.col("clean_from") - F.sum("clean").over(within)) + F.col("garbled_to") + F.sum("garbled").over(within)
    cuts = staged(points.join(sums, "bucket").select("g", wrong.alias("wrong")), "cuts")
    least = cuts.agg(F.min("wrong")).first()[0]
    return cuts.where(F.col("wrong") <= F.lit(least * 1.001)).orderBy(F.abs(F.col("g") - PRIOR), "g").first()["g"]


def wrong_encodings(df: DataFrame, id_col: str = "addr_id", fields: list[str] | None = None) -> DataFrame:
    """(id, field, value, restored) of every wrongly decoded field; restored is null where that isn't possible."""
    fields = fields or FIELDS
    values = clean_values(df, TRAINED)
    model = df.sparkSession.sparkContext.broadcast(train(values))  # bounded, see train
    rows, distinct = odd_values(df, id_col, fields)

    def judge(batches):
        m = model.value
        for pdf in batches:
            w = words_of(pdf["words"])
            keep = [m.wrongly_decoded(v, w) for v in pdf["value"]]
            yield picked(pdf["value"], pdf["_n"], keep, restored=[m.restored(v, w) if k else None for v, k in zip(pdf["value"], keep)])

    cases = staged(with_words(distinct, vocabulary(values)).mapInPandas(judge, "value string, _n long, restored string"), "encodings")
    return join_counted(rows, cases, ["value"], "_n").select(id_col, "field", "value", "restored")


def p5_found(addresses: DataFrame) -> DataFrame:
    return wrong_encodings(addresses).select("addr_id", "field")

"""Tokens and span algebra over arrays: row-local, JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.functions.patterns import let

TOKEN = "struct<text:string,line:int,of_lines:int,position:int,follows_comma:int>"
PART = "struct<start:int,length:int,part:string,value:string>"
CLAIM = f"struct<vocab:string,seq:int,confidence:int,start:int,`end`:int,parts:array<{PART}>>"


def tokenize(text: Column) -> Column:
    """ARRAY<TOKEN>: words between blanks and commas; a word right after commas knows how many there were in its line."""
    return let(F.split(text, "\n", -1), _line_tokens)


def _line_tokens(lines: Column) -> Column:
    def line_tokens(line: Column, number: Column) -> Column:
        pieces = F.regexp_extract_all(line, F.lit(r"([^, \t\n\f\r]+|[, \t\n\f\r]+)"), F.lit(1))
        start = F.struct(F.array().cast(f"array<{TOKEN}>").alias("out"), F.lit(-1).alias("commas"), F.lit(-1).alias("follows"))

        def step(acc: Column, piece: Column) -> Column:
            commas = F.length(F.regexp_replace(piece, "[^,]", ""))
            token = F.struct(piece.alias("text"), number.cast("int").alias("line"), F.size(lines).alias("of_lines"), F.size(acc["out"]).alias("position"), acc["follows"].alias("follows_comma"))
            gap = piece.rlike("^[, \t\n\f\r]")
            return F.struct(
                F.when(gap, acc["out"]).otherwise(F.concat(acc["out"], F.array(token).cast(f"array<{TOKEN}>"))).alias("out"),
                F.when(gap, acc["commas"] + commas).otherwise(acc["commas"]).alias("commas"),
                F.when(gap & (commas > 0), acc["commas"] + commas).when(gap, acc["follows"]).otherwise(F.lit(-1)).alias("follows"))

        return F.aggregate(pieces, start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(lines, line_tokens))


def token_join(tokens: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.transform(tokens, lambda t: t["text"]), start + 1, length), " ")


def indexes(n: Column) -> Column:
    """0 .. n-1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def line_end(tokens: Column, start: Column) -> Column:
    """Index one past the last token on start's line; the number of tokens for a start outside."""
    n = F.size(tokens)
    line = F.try_element_at(tokens, start + 1)["line"]
    later = F.filter(indexes(n), lambda i: (i > start) & (F.element_at(tokens, i + 1)["line"] != line))
    return F.when((start < 0) | (start >= n), n).otherwise(F.coalesce(F.array_min(later), n))


def line_start(tokens: Column, at: Column) -> Column:
    line = F.try_element_at(tokens, at + 1)["line"]
    return F.coalesce(F.array_min(F.filter(indexes(F.size(tokens)), lambda i: F.element_at(tokens, i + 1)["line"] == line)), F.lit(0))


def spans(tokens: Column, most: int, opens=None) -> Column:
    """ARRAY<STRUCT<start, length, text>>: starts ascending, lengths from most down to 1; only from tokens that open."""
    def over(texts: Column) -> Column:
        n = F.size(texts)

        def at(i: Column) -> Column:
            return F.transform(F.sequence(F.least(F.lit(most), n - i), F.lit(1), F.lit(-1)), lambda k: F.struct(i.alias("start"), k.alias("length"), F.array_join(F.slice(texts, i + 1, k), " ").alias("text")))

        starts = indexes(n) if opens is None else F.filter(indexes(n), lambda i: opens(F.element_at(texts, i + 1)))
        return F.flatten(F.transform(starts, at))

    return let(F.transform(tokens, lambda t: t["text"]), over)


def part(start: Column, length: Column, name: str | Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), (F.lit(name) if isinstance(name, str) else name).alias("part"), value.alias("value"))


def claim_start(parts: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(parts, lambda p: p["start"])), F.lit(0))


def claim_end(parts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(parts, lambda p: p["start"] + p["length"])), F.lit(0))


def overlaps(a: Column, b: Column) -> Column:
    """Of two part arrays; one without parts overlaps nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (claim_start(a) < claim_end(b)) & (claim_start(b) < claim_end(a))


def gaps(start: Column, length: Column, parts: Column) -> Column:
    """ARRAY<STRUCT<start, length>>: maximal runs of the span that no part covers."""
    inside = F.when(length > 0, F.sequence(start, start + length - 1)).otherwise(F.array().cast("array<int>"))
    free = F.filter(inside, lambda i: ~F.exists(parts, lambda p: (p["start"] <= i) & (i < p["start"] + p["length"])))

    def runs(free: Column) -> Column:
        first = F.filter(free, lambda i: ~F.array_contains(free, i - 1))
        last = F.filter(free, lambda i: ~F.array_contains(free, i + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.cast("int").alias("start"), (b - a + 1).cast("int").alias("length")))

    return let(free, runs)


def demote(confidence: Column, times: Column) -> Column:
    """One step down the scale for each time: 100, 90, 75, 50."""
    steps = F.when(confidence > 90, 0).when(confidence > 75, 1).when(confidence > 50, 2).otherwise(3) + times
    down = F.when(steps >= 3, 50).when(steps == 2, 75).when(steps == 1, 90)
    return F.when(times == 0, confidence).otherwise(down)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions read as a column. As a plain projection it would be merged into
    them and computed anew for every use, inside loops over arrays too; a generator of one row isn't merged."""
    return df.select("*", F.explode(F.array(value)).alias(name))

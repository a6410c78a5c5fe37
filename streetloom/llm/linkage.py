"""Problem 1: the same postal address written differently.

Method: records are blocked on postcode with house number, on the sound of the street with house number, and on the
town with house number; candidate pairs are compared part by part, where a part missing on one side is a level of
its own; the weights of the levels are estimated by expectation-maximisation over the counts of comparison patterns.

A part may be missing on both sides, so a posterior alone can't tell two neighbouring locations apart from one: pairs
of equal detail link first; then groups join the places of groups with more detail that they match, most detailed
first, unless two of those places contradict each other in a part known of both.

House number and unit are part of every block: a street has any number of houses and a house any number of units, so
blocks without them would grow without bound, and another number or unit is another location by definition. The blocks'
join has written tables on both sides, so adaptive execution splits a hot key.

Defined results: a record without a house or box number, or with neither town nor postcode, is a location of its own;
repeated rows are at the same location.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.llm.addressparts import PART_NAMES, read_parts
from streetloom.llm.names import same_word
from streetloom.operators.components import components
from streetloom.session import staged

#: Compared parts and their levels; level 0 is disagreement.
LEVELS = {"street": 4, "suffix": 4, "predir": 4, "postdir": 4, "city": 4, "zip": 3}
#: First guesses of m and u by level; u only serves tables without chance pairs.
_START = {
    "street": ([0.002, 0.10, 0.05, 0.848], [0.90, 0.02, 0.01, 0.07]),
    "suffix": ([0.005, 0.10, 0.05, 0.845], [0.70, 0.12, 0.03, 0.15]),
    "predir": ([0.005, 0.03, 0.765, 0.20], [0.25, 0.30, 0.43, 0.02]),
    "postdir": ([0.005, 0.01, 0.935, 0.05], [0.05, 0.10, 0.84, 0.01]),
    "city": ([0.01, 0.20, 0.15, 0.64], [0.70, 0.15, 0.01, 0.14]),
    "zip": ([0.02, 0.20, 0.78], [0.60, 0.15, 0.25]),
}
#: Parts whose disagreement makes another location: their m at level 0 stays below this in the estimation.
_STRICT = {"suffix": 0.002, "predir": 0.002, "postdir": 0.002, "street": 0.005}


def comparison(part: str) -> Column:
    """Level of agreement of a_<part> and b_<part>."""
    a, b = F.col(f"a_{part}"), F.col(f"b_{part}")
    none, one = (a == "") & (b == ""), (a == "") | (b == "")
    if part == "zip":
        return F.when(one, 1).when(a == b, 2).otherwise(0)
    if part == "city":
        return F.when(one, 1).when(a == b, 3).when(F.levenshtein(a, b, 2) >= 0, 2).otherwise(0)
    if part == "street":
        near = ~a.rlike(r"\d") & ~b.rlike(r"\d") & (same_word(a, b, 2) | (F.col("a_sound") == F.col("b_sound")) & (F.levenshtein(a, b, 4) >= 0))
        return F.when(one, 2).when(a == b, 3).when(near, 1).otherwise(0)
    return F.when(none, 2).when(one, 1).when(a == b, 3).otherwise(0)


def _rates(counts: dict[str, list[float]]) -> dict[str, list[float]]:
    return {p: [x / sum(c) for x in c] for p, c in counts.items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], chance: list[tuple[tuple[int, ...], int]], rounds: int = 25) -> tuple[dict[str, tuple[list[float], list[float]]], float]:
    """Expectation-maximisation over (levels, count) of the candidates; returns m and u by part and the share of matches.

    u comes from chance pairs, which are no matches: among candidates of the blocks there are too few of those for
    the two classes to be told apart. m and the share are estimated in rounds."""
    seen = {p: [0.5] * k for p, k in LEVELS.items()}
    for levels, n in chance:
        for p, x in zip(LEVELS, levels):
            seen[p][x] += n
    u = _rates(seen) if chance else {p: _START[p][1] for p in LEVELS}
    mu = {p: (list(_START[p][0]), u[p]) for p in LEVELS}
    share, total = 0.5, sum(n for _, n in patterns)
    if not total:
        return mu, share
    for _ in range(rounds):
        m_new = {p: [0.5] * k for p, k in LEVELS.items()}
        matches = 0.0
        for levels, n in patterns:
            g = posterior(levels, mu, share) * n
            matches += g
            for p, x in zip(LEVELS, levels):
                m_new[p][x] += g
        share = min(0.99, max(0.01, matches / total))
        for p, m in _rates(m_new).items():
            if p in _STRICT and m[0] > _STRICT[p]:
                rest = (1 - _STRICT[p]) / (1 - m[0])
                m = [_STRICT[p], *(x * rest for x in m[1:])]
            mu[p] = (m, u[p])
    return mu, share


def posterior(levels: tuple[int, ...], mu: dict, share: float) -> float:
    z = math.log(share / (1 - share)) + sum(math.log(mu[p][0][x] / mu[p][1][x]) for p, x in zip(LEVELS, levels))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """(a, b) of representatives that share a block. Kind, house number and unit must be equal in every block."""
    same = F.concat_ws("|", "kind", "number", "unit")
    block = F.array(
        F.when(F.col("zip") != "", F.concat_ws("|", F.lit("z"), same, "zip")),
        F.when((F.col("sound") != ""), F.concat_ws("|", F.lit("s"), same, "sound")),
        F.when(F.col("city") != "", F.concat_ws("|", F.lit("c"), same, F.substring("city", 1, 4))),
    )
    keyed = reps.where("number <> ''").select("id", F.explode(F.filter(block, lambda x: x.isNotNull())).alias("block")).select("id", F.xxhash64("block").alias("key"))
    return keyed.select(F.col("id").alias("a"), "key").join(keyed.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()


def chance_pairs(reps: DataFrame, about: int = 5000) -> DataFrame:
    """Each representative beside the next in hash order: as many pairs as representatives, none chosen by content."""
    n = reps.count()
    h = F.xxhash64(F.lit("chance"), "id")
    w = Window.partitionBy(F.pmod(h, F.lit(max(1, n // about)))).orderBy(h, "id")
    both = reps.select(*[F.col(c).alias(f"a_{c}") for c in PART_NAMES], *[F.lead(c).over(w).alias(f"b_{c}") for c in PART_NAMES])
    return both.where(F.col("b_kind").isNotNull() & ((F.col("a_number") != F.col("b_number")) | (F.col("a_sound") != F.col("b_sound"))))


_DETAIL = ["suffix", "predir", "postdir"]
_FACTS = ["street", "zip", "city", "region"]


def settle(facts: dict[int, tuple[tuple[str, ...], tuple[frozenset, ...]]], edges: list[tuple[int, int]]) -> dict[int, int]:
    """Place of each group of one component: (known detail, values of the other parts) by group, and matching groups.

    A group whose places to join contradict each other joins none; nothing is joined that contradicts in detail."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    of = {g: g for g in facts}
    members = {g: {g} for g in facts}
    known = {g: d for g, (d, _) in facts.items()}
    values = {g: v for g, (_, v) in facts.items()}

    def clash(p: int, q: int) -> bool:
        (_, pre, post), (_, pre2, post2) = known[p], known[q]
        # the one direction of each, written on different sides
        if bool(pre) != bool(post) and bool(pre2) != bool(post2) and (pre or post) != (pre2 or post2):
            return True
        return any(x and y and x != y for x, y in zip(known[p], known[q]))

    def apart(p: int, q: int) -> bool:
        """Two places that one group matches: may they not be one?"""
        if clash(p, q):
            return True
        if any(not near[m].isdisjoint(members[q]) for m in members[p]):
            return False
        street, zip_, city, region = (bool(x) and bool(y) and x.isdisjoint(y) for x, y in zip(values[p], values[q]))
        return street or zip_ or region or city and values[p][1].isdisjoint(values[q][1])

    def join(p: int, q: int) -> None:
        if p == q or clash(p, q):
            return
        p, q = min(p, q), max(p, q)
        known[p] = tuple(x or y for x, y in zip(known[p], known[q]))
        values[p] = tuple(x | y for x, y in zip(values[p], values[q]))
        members[p] |= members[q]
        for g in members.pop(q):
            of[g] = p

    detail = {g: sum(x != "" for x in d) for g, (d, _) in facts.items()}
    for level in range(len(_DETAIL), -1, -1):
        here = sorted(g for g in facts if detail[g] == level)
        torn = set()
        for g in here:
            to = sorted({of[x] for x in near[g] if detail[x] >= level and not clash(of[g], of[x])})
            if any(apart(p, q) for i, p in enumerate(to) for q in to[:i]):
                torn.add(g)
        for more in (True, False):
            for g in here:
                for x in sorted(near[g]) if g not in torn else ():
                    if detail[x] > level if more else detail[x] == level and x not in torn:
                        join(of[g], of[x])
    return of


def _settle(batches):
    """mapInPandas function over components: arrays of their edges and groups; many components a task."""
    for pdf in batches:
        out = []
        for row in zip(*[pdf[c] for c in ("a", "b", "id", *_DETAIL, *_FACTS)]):
            a, b, ids, *columns = row
            detail, values = zip(*columns[: len(_DETAIL)]), zip(*columns[len(_DETAIL):])
            facts = {int(i): (tuple(d), tuple(frozenset(x.split("\u0001")) - {""} for x in v)) for i, d, v in zip(ids, detail, values)}
            out += settle(facts, [(int(x), int(y)) for x, y in zip(a, b)]).items()
        yield pd.DataFrame(out, columns=["id", "place"])


def link_addresses(records: DataFrame, id_col: str, vocab: DataFrame, least: float = 0.9) -> DataFrame:
    """(id, location): location is the smallest id of the records at the same place."""
    read = staged(read_parts(records.where(F.col(id_col).isNotNull()), id_col, vocab), "parts")
    # identical readings are one representative: copies never meet in a pair
    reps = staged(read.groupBy(*PART_NAMES).agg(F.min("id").alias("id")), "part-reps")

    def side(p: str) -> DataFrame:
        return reps.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in PART_NAMES])

    parts = list(LEVELS)
    compared = candidate_pairs(reps).join(side("a"), "a").join(side("b"), "b")
    apart = (F.col("a_region") != "") & (F.col("b_region") != "") & (F.col("a_region") != F.col("b_region"))
    compared = compared.where(~apart).select("a", "b", *[comparison(p).cast("int").alias(p) for p in parts])
    compared = staged(compared, "compared")
    # at most 3072 patterns, at any size
    patterns = [(tuple(r[p] for p in parts), r["count"]) for r in compared.groupBy(*parts).count().collect()]
    chance = [(tuple(r[p] for p in parts), r["count"]) for r in chance_pairs(reps).select(*[comparison(p).cast("int").alias(p) for p in parts]).groupBy(*parts).count().collect()]
    mu, share = estimate(patterns, chance)
    # neighbours agree in all but one part, against the independence the weights assume: a known contradiction in a
    # strict part, or a place without agreement in town or postcode, is no link whatever the other parts weigh
    good = [x for x, _ in patterns if posterior(x, mu, share) >= least and min(x[parts.index(p)] for p in _STRICT) > 0 and (x[parts.index("zip")] == 2 or x[parts.index("city")] >= 2)]
    spark = records.sparkSession
    keep = spark.createDataFrame([tuple(x) for x in good], ", ".join(f"{p} int" for p in parts)) if good else spark.createDataFrame([], ", ".join(f"{p} int" for p in parts))
    links = staged(compared.join(F.broadcast(keep), parts).select("a", "b", *[F.col(p) for p in ("suffix", "predir", "postdir")]), "address-links")

    one_missing = (F.col("suffix") == 1) | (F.col("predir") == 1) | (F.col("postdir") == 1)
    first = staged(components(links.where(~one_missing)), "address-groups")
    group = staged(reps.join(first, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component"), "address-group-of")
    of = group.select("id", "group")
    both = links.where(one_missing).select("a", "b").join(of.toDF("a", "ga"), "a").join(of.toDF("b", "gb"), "b").where("ga <> gb")
    edges = staged(both.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct(), "address-group-links")
    clusters = staged(components(edges), "address-clusters")
    # groups are equal in their detail; what else they hold comes along
    facts = staged(clusters.join(group.withColumnRenamed("id", "rep").withColumnRenamed("group", "id"), "id").groupBy("component", "id").agg(
        *[F.min(c).alias(c) for c in _DETAIL], *[F.filter(F.collect_set(c), lambda x: x != "").alias(c) for c in _FACTS]), "address-group-facts")
    inside = edges.join(clusters.withColumnRenamed("id", "a"), "a")
    edges_of = inside.groupBy("component").agg(F.collect_list(F.struct("a", "b")).alias("e"))
    groups_of = facts.groupBy("component").agg(F.collect_list(F.struct("id", *_DETAIL, *[F.array_join(c, "\u0001").alias(c) for c in _FACTS])).alias("g"))
    each = edges_of.join(groups_of, "component").select("component", *[F.col(f"e.{c}") for c in ("a", "b")], *[F.col(f"g.{c}") for c in ("id", *_DETAIL, *_FACTS)])
    parts_n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    second = staged(each.repartition(parts_n, F.xxhash64("component")).mapInPandas(_settle, "id long, place long"), "address-second")
    place = of.join(second.withColumnRenamed("id", "group"), "group", "left").select("id", F.coalesce("place", "group").alias("location"))
    of_rep = reps.join(place, "id").select(*PART_NAMES, "location")
    # readings without a number, or with neither town nor postcode, say too little to stand for a place
    vague = (F.col("number") == "") | ((F.col("city") == "") & (F.col("zip") == ""))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in PART_NAMES]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = read.alias("l").join(of_rep.alias("r"), cond).select(F.col("l.id").alias("id"), F.col("r.location").alias("location"), *[F.col(f"l.{c}").alias(c) for c in ("number", "city", "zip")])
    return joined.select("id", F.when(vague, F.col("id")).otherwise(F.col("location")).alias("location"))


def p1_locations(patients: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per record: rec_id, location_id."""
    return link_addresses(patients, "rec_id", vocab).select(F.col("id").alias("rec_id"), F.col("location").alias("location_id"))


def p1_found(patients: DataFrame, vocab: DataFrame) -> DataFrame:
    e = staged(link_addresses(patients, "rec_id", vocab), "locations")
    return (e.select(F.col("id").alias("rec_id_a"), "location").join(e.select(F.col("id").alias("rec_id_b"), "location"), "location")
            .where("rec_id_a < rec_id_b").select("rec_id_a", "rec_id_b"))

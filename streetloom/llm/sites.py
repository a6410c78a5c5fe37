"""Problem 4: matching entities across sources without keys.

Method: sorted neighbourhood. All records of both tables are sorted by several composite keys; a window slides over
each order and yields candidate pairs, which get a confidence from weighted field similarities. Listings of one
source that are the same entity form a group, and a one-to-one assignment between the records of the first source and
the groups of the second maximises the total confidence.

Another name at the same address, or the same name at another house number or street, is no match. A record without
a name joins by its address, with less confidence. Records that read alike are one representative, so that copies
can't fill a window.

Defined results: a record without a house number and a street, or without anything else to compare, matches nothing;
empty tables give no matches.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.llm.addressparts import PART_NAMES, read_parts
from streetloom.llm.names import learned_reader, same_kind, words_apart
from streetloom.operators.components import components
from streetloom.session import staged

#: Weights of the similarities; a field missing on either side leaves the sum and its weight out.
WEIGHTS = {"core": 0.30, "kind": 0.10, "number": 0.18, "street": 0.18, "suffix": 0.04, "dirs": 0.03, "unit": 0.05, "city": 0.06, "zip": 0.06}
_NAME = ["kind_", "core", "words_"]
_ALL = [*_NAME, *PART_NAMES]


def sort_keys() -> dict[str, Column]:
    c = F.col
    return {
        "place": F.concat_ws("|", "zip", "number", "street", "core"),
        "name": F.concat_ws("|", "core", "kind_", "city"),
        "street": F.concat_ws("|", "street", "number", "core"),
        "house": F.concat_ws("|", "number", "sound", "zip", "core"),
        "ending": F.concat_ws("|", F.reverse("core"), "number", "zip"),
        "town": F.concat_ws("|", F.substring("city", 1, 5), "number", "core", c("sound")),
    }


def neighbours(df: DataFrame, key: Column, keep: list[str], window: int, block: int = 4000) -> DataFrame:
    """(a, b) of rows at most window - 1 places apart in the order of key that agree in one of the columns keep.

    df has id, src and keep. The order is cut into blocks of block rows, each with the first rows of the next one, so
    that no pair is lost at a cut and no task grows with the data. Pairs within the first source (src 0) are left out.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = [F.when(F.col(c) != "", F.xxhash64(c)).otherwise(F.lit(0)).alias(c) for c in keep]
    placed = df.select("id", "src", key.alias("key"), *hashed).repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").drop("key")

    def number(batches):
        from pyspark import TaskContext

        at, me = 0, TaskContext.get().partitionId()
        for pdf in batches:
            yield pdf.assign(part=me, at=np.arange(at, at + len(pdf)))
            at += len(pdf)

    columns = "id long, src int, " + ", ".join(f"{c} long" for c in keep)
    placed = staged(placed.mapInPandas(number, columns + ", part int, at long"), "sorted")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect())  # one row per partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if not total:
        return spark.createDataFrame([], "a long, b long")
    ranked = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "before", "at")
    home = F.floor(F.col("rank") / block)
    blocks = ranked.withColumn("block", F.explode(F.when((F.col("rank") % block < window - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))))

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        own = (pdf["rank"] // block == pdf["block"]).to_numpy()
        ids, src = pdf["id"].to_numpy(), pdf["src"].to_numpy()
        cols = [pdf[c].to_numpy() for c in keep]
        out_a, out_b = [], []
        for d in range(1, min(window, len(pdf))):
            ok = own[:-d] & (src[:-d] + src[d:] > 0)
            alike = np.zeros(len(ok), bool)
            for c in cols:
                alike |= (c[:-d] == c[d:]) & (c[d:] != 0)
            ok &= alike
            out_a.append(ids[:-d][ok])
            out_b.append(ids[d:][ok])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return blocks.groupBy("block").applyInPandas(slide, "a long, b long")


def _similar(a: Column, b: Column) -> Column:
    """1 for equal, less by the share of edits, 0 under 0.6."""
    s = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, F.lit(1.0)).when(s >= 0.6, s).otherwise(F.lit(0.0))


def confidence() -> tuple[Column, Column]:
    """(confidence, whether the pair may be one entity at all) over columns a_* and b_*."""
    num, den = F.lit(0.0), F.lit(0.0)
    sims: dict[str, tuple[Column, Column]] = {}
    for f, (x, y) in {"core": ("core", "core"), "kind": ("kind_", "kind_"), "number": ("number", "number"), "street": ("street", "street"), "suffix": ("suffix", "suffix"), "unit": ("unit", "unit"), "city": ("city", "city"), "zip": ("zip", "zip")}.items():
        a, b = F.col(f"a_{x}"), F.col(f"b_{y}")
        known = (a != "") & (b != "")
        sims[f] = (known, _similar(a, b) if f in ("core", "street", "city") else (a == b).cast("double"))
    a, b = F.concat_ws("|", "a_predir", "a_postdir"), F.concat_ws("|", "b_predir", "b_postdir")
    sims["dirs"] = ((a != "|") & (b != "|"), (a == b).cast("double"))
    for f, (known, s) in sims.items():
        num = num + F.when(known, s * WEIGHTS[f]).otherwise(0.0)
        den = den + F.when(known, WEIGHTS[f]).otherwise(0.0)
    named, same_name = sims["core"][0], (sims["core"][1] >= 0.75) & ~words_apart(F.col("a_words_"), F.col("b_words_")) & same_kind(F.col("a_kind_"), F.col("b_kind_"))
    numbered, same_number = sims["number"]
    street_ok = ~sims["street"][0] | (sims["street"][1] >= 0.6) | (F.col("a_sound") == F.col("b_sound"))
    figures = F.regexp_replace("a_street", r"[^0-9]", "") == F.regexp_replace("b_street", r"[^0-9]", "")
    strict = lambda f: ~sims[f][0] | (sims[f][1] == 1.0)
    # a nameless record needs the whole address, a houseless one the name and the street
    possible = (F.when(named, same_name).otherwise(numbered & (sims["street"][1] >= 0.75) & strict("unit") & strict("suffix"))
                & F.when(numbered, same_number == 1.0).otherwise(named & sims["street"][0]) & street_ok & figures
                & (sims["zip"][0] & (sims["zip"][1] == 1.0) | sims["city"][0] & (sims["city"][1] >= 0.7) | named & ~sims["zip"][0] & ~sims["city"][0]))
    scale = F.when(named, 1.0).otherwise(0.85) * F.when(numbered, 1.0).otherwise(0.9)
    return F.round(scale * num / F.greatest(den, F.lit(1e-9)), 6), possible


def best_pairs(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one pairs of the largest total weight among (s, g, weight > 0), by shortest augmenting paths.

    Only the given pairs are walked, never a matrix. Every s has a place of its own of weight 0 besides, so that it may
    stay alone; ties of a path go to the smaller g."""
    of: dict[int, list[tuple[int, float]]] = {}
    weight: dict[tuple[int, int], float] = {}
    for s, g, w in edges:
        weight[s, g] = max(w, weight.get((s, g), 0.0))
    for (s, g), w in sorted(weight.items()):
        of.setdefault(s, []).append((g, w))
    if len(weight) == 1:
        return [(s, g, w) for (s, g), w in weight.items()]
    price: dict = {}
    taken: dict = {}
    has: dict = {}
    for start in of:
        # reduced costs are kept non-negative; a place of one's own is the key (1, s), a partner (0, g)
        far: dict = {}
        came: dict = {}
        done: dict = {}
        best = min(-w - price.get((0, g), 0.0) for g, w in of[start])
        base = {start: min(best, -price.get((1, start), 0.0))}
        heap: list = []

        def reach(s: int, d: float, base_s: float) -> None:
            for g, w in [*(((0, g), w) for g, w in of[s]), ((1, s), 0.0)]:
                n = d + max(0.0, -w - price.get(g, 0.0) - base_s)
                if g not in done and n < far.get(g, 9e9):
                    far[g], came[g] = n, s
                    heapq.heappush(heap, (n, g))

        reach(start, 0.0, base[start])
        while True:
            d, g = heapq.heappop(heap)
            if g in done or d > far[g]:
                continue
            done[g] = d
            s = taken.get(g)
            if s is None:
                break
            own = 0.0 if g[0] else weight[s, g[1]]
            reach(s, d, -own - price.get(g, 0.0))
        end, total = g, d
        for g, d in done.items():
            price[g] = price.get(g, 0.0) + d - total
        while True:
            s = came[end]
            taken[end], has[s], end = s, end, has.get(s)
            if s == start:
                break
    return [(s, g[1], weight[s, g[1]]) for s, g in sorted(has.items()) if not g[0]]


def _solve(batches):
    """mapInPandas function over rows (component, s, g, confidence) sorted by component: several components a task."""
    held: list[tuple[int, int, float]] = []
    last = None
    for pdf in batches:
        out = []
        for c, s, g, w in zip(pdf["component"].tolist(), pdf["s"].tolist(), pdf["g"].tolist(), pdf["confidence"].tolist()):
            if c != last and held:
                out += best_pairs(held)
                held = []
            last = c
            held.append((s, g, w))
        yield pd.DataFrame(out, columns=["s", "g", "confidence"])
    yield pd.DataFrame(best_pairs(held) if held else [], columns=["s", "g", "confidence"])


def auction(edges: DataFrame, step: float = 0.001) -> DataFrame:
    """One-to-one pairs (s, g, confidence) by auction rounds in DataFrames: for components of any size.

    Each s without a partner bids for its best g, the more the better it is than the second best (or than staying
    alone); each g goes to the highest bid. The total is within step for each s of the largest one, and is the largest
    if step times their number is less than the least difference of two totals. Rounds go on until no s bids."""
    spark = edges.sparkSession
    owners = spark.createDataFrame([], "g long, s long, price double")
    away = spark.createDataFrame([], "s long")
    while True:
        open_ = edges.join(owners.select("s"), "s", "left_anti").join(away, "s", "left_anti")
        valued = open_.join(owners.select("g", "price"), "g", "left").select("s", "g", (F.col("confidence") - F.coalesce("price", F.lit(0.0))).alias("gain"), F.coalesce("price", F.lit(0.0)).alias("price"))
        # the two best, ties by a hash of the pair; a limit by group is applied before the shuffle
        place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("gain"), F.xxhash64("s", "g"), "g"))
        two = valued.withColumn("place", place).where("place <= 2")
        first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
        second = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("gain"))), F.lit(0.0)))
        bids = staged(two.groupBy("s").agg(first("g").alias("g"), first("gain").alias("gain"), (first("price") + first("gain") - second + step).alias("price")), "auction-bids")
        if bids.isEmpty():
            return edges.join(owners.select("s", "g"), ["s", "g"])
        away = staged(away.unionByName(bids.where("gain <= 0").select("s")), "auction-away")
        won = bids.where("gain > 0").groupBy("g").agg(F.max(F.struct("price", F.xxhash64("s", "g").alias("h"), "s")).alias("m")).select("g", F.col("m.s").alias("s"), F.col("m.price").alias("price"))
        owners = staged(owners.join(won.select("g"), "g", "left_anti").unionByName(won), "auction-owners")


def assign(scored: DataFrame, exact_edges: int = 500_000, step: float = 0.001) -> DataFrame:
    """One-to-one pairs (s, g, confidence) of the largest total confidence.

    Pairs that meet no other are taken as they are. Components of at most exact_edges pairs are solved exactly, many in
    a task; larger ones, which may not fit into a task, by auction() with the given step.
    """
    edges = staged(scored.where("confidence > 0").groupBy("s", "g").agg(F.max("confidence").alias("confidence")), "assign-edges")
    several = F.col("_s") + F.col("_g") > 2
    counted = edges.join(edges.groupBy("s").agg(F.count(F.lit(1)).alias("_s")), "s").join(edges.groupBy("g").agg(F.count(F.lit(1)).alias("_g")), "g")
    counted = staged(counted.select("s", "g", "confidence", several.alias("several")), "assign-counted")
    out = counted.where("not several").select("s", "g", "confidence")
    open_ = counted.where("several").drop("several")
    comp = components(open_.select((F.col("s") * 2).alias("a"), (F.col("g") * 2 + 1).alias("b")))
    tagged = staged(open_.join(comp.where("id % 2 = 0").select(F.shiftright("id", 1).alias("s"), "component"), "s"), "assign-components")
    large = staged(tagged.groupBy("component").count().where(F.col("count") > exact_edges).select("component"), "assign-large")
    # a number of partitions that adaptive execution leaves as it is: the work is Python's, not bytes
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = tagged.join(large, "component", "left_anti").select("component", "s", "g", "confidence").repartition(parts, F.xxhash64("component")).sortWithinPartitions("component", "s", "g")
    out = out.unionByName(small.mapInPandas(_solve, "s long, g long, confidence double"))
    if large.isEmpty():
        return out
    return out.unionByName(auction(tagged.join(large, "component", "left_semi").select("s", "g", "confidence"), step))


def _read_names(df: DataFrame, reader) -> DataFrame:
    """df with kind_, core and words_ for business_name; reader is a broadcast NameReader."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.drop("business_name").schema.fields)

    def run(batches):
        for pdf in batches:
            read = [reader.value.read(n) or ("", [], [], "") for n in pdf["business_name"]]
            out = pdf.drop(columns=["business_name"])
            out["kind_"] = [x[0] for x in read]
            out["core"] = ["".join(x[1]) for x in read]
            out["words_"] = [x[1] for x in read]
            yield out

    return df.mapInPandas(run, schema + ", kind_ string, core string, words_ array<string>")


def match_sites(left: DataFrame, left_id: str, right: DataFrame, right_id: str, vocab: DataFrame, least: float = 0.72, window: int = 8) -> DataFrame:
    """(left id, right id, confidence); ids of both sides may overlap, every pair of matching rows is listed."""
    reader = left.sparkSession.sparkContext.broadcast(learned_reader(left.select("business_name").unionByName(right.select("business_name"))))  # bounded
    both = (_read_names(read_parts(left, left_id, vocab, ["business_name"]), reader).withColumn("src", F.lit(0))
            .unionByName(_read_names(read_parts(right, right_id, vocab, ["business_name"]), reader).withColumn("src", F.lit(1))))
    # ids of the two sources are kept apart
    read = staged(both.where(F.col("id").isNotNull()).withColumn("id", F.col("id") * 2 + F.col("src")), "sites")
    reps = staged(read.groupBy("src", *_ALL).agg(F.min("id").alias("id")), "site-reps")
    pairs = None
    for key in sort_keys().values():
        p = neighbours(reps, key, ["number", "core", "street"], window)
        pairs = p if pairs is None else pairs.unionByName(p)
    side = lambda p: reps.select(F.col("id").alias(p), F.col("src").alias(f"{p}_src"), *[F.col(c).alias(f"{p}_{c}") for c in _ALL])
    score, possible = confidence()
    compared = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(possible & (F.col("a_region").isin("", F.col("b_region")) | (F.col("b_region") == ""))).withColumn("confidence", score).where(F.col("confidence") >= least)
    compared = staged(compared.select("a", "b", "a_src", "b_src", "confidence", ((F.col("a_core") != "") & (F.col("b_core") != "")).alias("named")), "site-pairs")
    # listings of the second source that are one entity; a nameless one must not tie two names together
    same = compared.where((F.col("a_src") == 1) & (F.col("b_src") == 1) & F.col("named"))
    groups = staged(components(same.select("a", "b")), "site-groups")
    cross = (compared.where(F.col("a_src") != F.col("b_src"))
             .select(F.when(F.col("a_src") == 0, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(F.col("a_src") == 0, F.col("b")).otherwise(F.col("a")).alias("r"), "confidence", "named"))
    cross = staged(cross.join(groups.withColumnRenamed("id", "r"), "r", "left").select("s", "r", F.coalesce("component", "r").alias("g"), "confidence", "named"), "site-cross")
    chosen = staged(assign(cross.where("named").select("s", "g", "confidence")).select("s", "g"), "site-chosen")
    matched = cross.where("named").join(chosen, ["s", "g"]).select("s", "r", "confidence")
    # other listings of a chosen group match as well, with the group's confidence
    of_group = chosen.join(groups.select(F.col("id").alias("r"), F.col("component").alias("g")), "g").join(cross.where("named").groupBy("s", "g").agg(F.max("confidence").alias("confidence")), ["s", "g"]).select("s", "r", "confidence")
    # nameless listings go to their site if it is the only one they fit
    nameless = cross.where("not named").groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("confidence").alias("confidence")).where("n = 1").select("s", "r", "confidence")
    of_reps = matched.unionByName(of_group).unionByName(nameless).groupBy("s", "r").agg(F.max("confidence").alias("confidence"))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ["src", *_ALL]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    members = staged(read.alias("l").join(reps.alias("r"), cond).select(F.col("l.id").alias("id"), F.col("r.id").alias("rep")), "site-members")
    return (of_reps.join(members.select(F.col("rep").alias("s"), F.col("id").alias("left_")), "s").join(members.select(F.col("rep").alias("r"), F.col("id").alias("right_")), "r")
            .select(F.shiftright("left_", 1).alias(left_id), F.shiftright("right_", 1).alias(right_id), "confidence"))


def p4_matches(clinics: DataFrame, payers: DataFrame, vocab: DataFrame) -> DataFrame:
    return match_sites(clinics, "site_id", payers, "payer_site_id", vocab)


def p4_found(clinics: DataFrame, payers: DataFrame, vocab: DataFrame) -> DataFrame:
    return p4_matches(clinics, payers, vocab).select("site_id", "payer_site_id")

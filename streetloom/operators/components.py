"""Connected components of a link table, by alternating star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.session import staged


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """(id, component): component is the smallest id reachable. Self-links and repeated links don't matter.

    Large-star and small-star steps alternate until nothing changes, which takes rounds in the logarithm of the
    longest path; hubs only ever send their links to their smallest neighbour. Every round is a written table, so that
    a lost executor costs one round. The smallest neighbours are written too: the join with them then has a plain
    shuffle on both sides, which adaptive execution splits where a hub owns a large share. Links that have not settled
    after most_rounds raise an error; an unfinished result is never returned.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = staged(links, "links")
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = staged(small, "links")
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")

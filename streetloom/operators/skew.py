"""Joins that hold when one key owns a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, hot_share: int = 2000) -> DataFrame:
    """Inner join of rows with a table that is unique on keys and holds in column n how many rows each key has.

    Keys with at least 1/hot_share of all counted rows are joined by broadcast: by the pigeonhole principle there
    are at most hot_share of them at any size. All other keys are small, so their shuffle join can't be skewed.
    Null keys match null keys. Column n is kept; rows and unique may share no other column than the keys.
    """
    limit = unique.agg((F.coalesce(F.sum(n), F.lit(0)) / hot_share).alias("least")).first()["least"]
    hot = unique.where(F.col(n) >= F.lit(max(float(limit), 1.0)))
    cold = unique.where(F.col(n) < F.lit(max(float(limit), 1.0)))
    mine = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[c for c in hot.columns if c not in keys])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        on = c if on is None else on & c
    drop = [f"_hot_{k}" for k in keys]
    a = rows.join(F.broadcast(mine), on, "inner").drop(*drop)
    rest = rows.join(F.broadcast(mine.select(*drop)), on, "left_anti")
    theirs = cold.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[c for c in cold.columns if c not in keys])
    b = rest.join(theirs, on, "inner").drop(*drop)
    return a.unionByName(b)

"""Joins that survive a key which holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys above 1 % of the rows: by arithmetic never more than this many, however large the table.
MAX_HOT = 100
#: Rows of a key up to which one task takes them all.
HEAVY = 50_000


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The at most MAX_HOT most frequent keys (nulls left out); counts are combined before the shuffle."""
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.orderBy(F.desc("__n"), *keys).limit(MAX_HOT).select(*keys)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], hot_right: DataFrame | None = None) -> DataFrame:
    """Left join to a ``right`` that is unique in ``keys``; null keys find nothing.

    Rows of ``left`` with one of its MAX_HOT most frequent keys are joined to a broadcast of at most MAX_HOT rows of
    ``right``, so no task gets all rows of a hot key; the rest is shuffled by key. No row is lost or repeated. ``hot_right``:
    the rows of ``right`` for the most frequent keys, at most MAX_HOT, where the caller knows them already.
    """
    if hot_right is None:
        hot = F.broadcast(hot_keys(left, keys).withColumn("__hot", F.lit(True)))
        hot_right = right.join(hot.drop("__hot"), keys, "left_semi")
    else:
        hot = F.broadcast(hot_right.select(*keys).withColumn("__hot", F.lit(True)))
    hot_right = F.broadcast(hot_right)
    tagged = left.join(hot, keys, "left")
    columns = [*left.columns, *(c for c in right.columns if c not in keys)]
    few = tagged.filter(F.col("__hot")).join(hot_right, keys, "left").select(*columns)
    many = tagged.filter(F.col("__hot").isNull()).join(right, keys, "left").select(*columns)
    return few.unionByName(many)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """lookup_join to a stored ``right`` that has in its column ``n``, which is left out, how many rows of ``left`` have the key at most.

    Without a key of more than HEAVY rows it is a plain left join: branches for hot keys double a plan with each join, and all of
    them, their broadcasts and their code are held by the driver.
    """
    heavy = right.filter(F.col(n) > HEAVY)
    if heavy.isEmpty():
        return left.join(right.drop(n), keys, "left")
    return lookup_join(left, right.drop(n), keys, heavy.orderBy(F.desc(n), *keys).limit(MAX_HOT).drop(n))

"""Distances between the distributions of groups, for many pairs in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_pairs(groups: DataFrame, within: Sequence[str] = (), group: str = "network") -> DataFrame:
    """``a, b`` with a < b of the groups, inside each value of ``within``."""
    own = groups.select(*within, group).distinct()
    left, right = own.withColumnRenamed(group, "a"), own.withColumnRenamed(group, "b")
    joined = left.join(right, list(within)) if within else left.join(right, F.col("a") < F.col("b"))
    return joined.where("a < b")


def distances(samples: DataFrame, pairs: DataFrame | None = None, within: Sequence[str] = (), also: Sequence[str] = (), group: str = "network", value: str = "v") -> DataFrame:
    """``within, also, a, b, wasserstein, ks`` of each pair of groups' values.

    Values are counted first, so ties meet in one row and a large group shrinks
    before it is dealt to its pairs. ``also`` are keys that both members share
    but that pairs don't have, such as a kind of value or a band.
    """
    w, x = list(within), list(also)
    counted = samples.where(F.col(value).isNotNull()).groupBy(*w, *x, group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    pairs = group_pairs(samples, w, group) if pairs is None else pairs
    first = counted.join(pairs, [*w], "inner") if w else None
    if first is None:
        a = counted.join(pairs, F.col(group) == F.col("a")).select(*x, "a", "b", "_v", F.col("_c").alias("_na"), F.lit(0).cast("long").alias("_nb"))
        b = counted.join(pairs, F.col(group) == F.col("b")).select(*x, "a", "b", "_v", F.lit(0).cast("long").alias("_na"), F.col("_c").alias("_nb"))
    else:
        a = counted.withColumnRenamed(group, "a").join(pairs, [*w, "a"]).select(*w, *x, "a", "b", "_v", F.col("_c").alias("_na"), F.lit(0).cast("long").alias("_nb"))
        b = counted.withColumnRenamed(group, "b").join(pairs, [*w, "b"]).select(*w, *x, "a", "b", "_v", F.lit(0).cast("long").alias("_na"), F.col("_c").alias("_nb"))
    keys = [*w, *x, "a", "b"]
    both = a.unionByName(b).groupBy(*keys, "_v").agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
    order, whole = Window.partitionBy(*keys).orderBy("_v"), Window.partitionBy(*keys)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs(F.sum("_na").over(running) / F.sum("_na").over(whole) - F.sum("_nb").over(running) / F.sum("_nb").over(whole))
    steps = both.select(*keys, gap.alias("_g"), (F.coalesce(F.lead("_v").over(order), F.col("_v")) - F.col("_v")).alias("_w"))
    return steps.groupBy(*keys).agg(F.sum(F.col("_g") * F.col("_w")).alias("wasserstein"), F.max("_g").alias("ks"))

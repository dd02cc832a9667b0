"""Degrees and graph Laplacians as coordinate tables ``network, src, dst, v``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NETWORK = ["network"]


def degree(w: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, src, deg``: row sums of the weights."""
    return w.groupBy(*(by or _NETWORK), "src").agg(F.sum("w").alias("deg"))


def unnormalised(w: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Degree matrix less weights; a self-loop lowers the diagonal."""
    by = by or _NETWORK
    off = w.where("src <> dst").select(*by, "src", "dst", (-F.col("w")).alias("v"))
    loops = w.groupBy(*by, "src").agg(F.sum("w").alias("deg"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("_own"))
    return off.unionByName(loops.select(*by, "src", F.col("src").alias("dst"), (F.col("deg") - F.col("_own")).alias("v")))


def symmetric_normalised(w: DataFrame, nodes: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Identity less weights divided by the roots of both degrees, which count 1e-12 at least.

    ``nodes`` (``network, node_id``) adds nodes without an edge, whose diagonal is 1.
    """
    by = by or _NETWORK
    deg = degree(w, by).withColumn("deg", F.greatest("deg", F.lit(1e-12)))
    scaled = w.join(deg.withColumnRenamed("deg", "_a"), [*by, "src"]).join(deg.select(*by, F.col("src").alias("dst"), F.col("deg").alias("_b")), [*by, "dst"])
    scaled = scaled.select(*by, "src", "dst", (-F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("v"))
    ids = nodes.select(*by, F.col("node_id").alias("src")) if nodes is not None else deg.select(*by, "src")
    one = ids.select(*by, "src", F.col("src").alias("dst"), F.lit(1.0).alias("v"))
    if nodes is None:  # a table of weights may hold self-loops, which meet the diagonal
        return scaled.unionByName(one).groupBy(*by, "src", "dst").agg(F.sum("v").alias("v"))
    return scaled.unionByName(one).groupBy(*by, "src", "dst").agg(F.sum("v").alias("v"))


def dirichlet_energy(w: DataFrame, values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, energy``: the centred Rayleigh quotient of ``values(network, node_id, y)`` under the unnormalised Laplacian.

    Taken over edges, half the sum of w (y_i - y_j)^2, so that no matrix is made.
    """
    by = by or _NETWORK
    mean = values.groupBy(*by).agg(F.avg("y").alias("_m"))
    size = values.join(mean, by).groupBy(*by).agg(F.sum((F.col("y") - F.col("_m")) * (F.col("y") - F.col("_m"))).alias("_s"))
    a = values.select(*by, F.col("node_id").alias("src"), F.col("y").alias("_a"))
    b = values.select(*by, F.col("node_id").alias("dst"), F.col("y").alias("_b"))
    jump = F.col("_a") - F.col("_b")
    total = w.join(a, [*by, "src"]).join(b, [*by, "dst"]).groupBy(*by).agg((0.5 * F.sum(F.col("w") * jump * jump)).alias("_t"))
    return total.join(size, by).select(*by, (F.col("_t") / (F.col("_s") + 1e-30)).alias("energy"))


def rayleigh(laplacian: DataFrame, values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``network, energy``: the centred Rayleigh quotient under any Laplacian table."""
    by = by or _NETWORK
    mean = values.groupBy(*by).agg(F.avg("y").alias("_m"))
    flat = values.join(mean, by).select(*by, "node_id", (F.col("y") - F.col("_m")).alias("y"))
    size = flat.groupBy(*by).agg(F.sum(F.col("y") * F.col("y")).alias("_s"))
    a = flat.select(*by, F.col("node_id").alias("src"), F.col("y").alias("_a"))
    b = flat.select(*by, F.col("node_id").alias("dst"), F.col("y").alias("_b"))
    total = laplacian.join(a, [*by, "src"]).join(b, [*by, "dst"]).groupBy(*by).agg(F.sum(F.col("v") * F.col("_a") * F.col("_b")).alias("_t"))
    return total.join(size, by).select(*by, (F.col("_t") / (F.col("_s") + 1e-30)).alias("energy"))

"""Tables behind the figures; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bound import ceiling_curve, spectral_bound
from .compare import compare_networks
from .profile import statistics

BINS = 50


def ceiling_data(nodes: DataFrame, pairs: DataFrame, features: Sequence[str] = (), k_max: int = 64) -> DataFrame:
    """``network, k, r2, r2_baseline``."""
    base = spectral_bound(nodes, pairs, features, 1).select("network", F.col("r2_imd").alias("r2_baseline"))
    return ceiling_curve(nodes, pairs, features, k_max).join(base, "network")


def bottleneck_map_data(nodes: DataFrame, modes: DataFrame, log_scale: bool = False, floor: float = 1e-10) -> DataFrame:
    """``network, mode, node_id, lng, lat, mass, position`` by rising mass; with a floor for a log scale. Nodes and modes must match."""
    w = Window.partitionBy("network", "mode")
    square = F.col("psi") * F.col("psi")
    total = F.sum(square).over(w)
    mass = modes.select("network", "mode", "node_id", (square / F.when(total > 0, total).otherwise(1.0)).alias("mass"))
    if log_scale:
        mass = mass.withColumn("mass", F.greatest("mass", F.greatest(F.min(F.when(F.col("mass") > 0, F.col("mass"))).over(w), F.lit(floor))))
    joined = mass.join(nodes.select("network", "node_id", "lat", "lng"), ["network", "node_id"])
    return joined.withColumn("position", F.row_number().over(w.orderBy("mass", "node_id"))).select("network", "mode", "node_id", "lng", "lat", "mass", "position")


def spectrum_data(spectrum: DataFrame, factor: float = 5.0) -> DataFrame:
    """``network, mode, lambda, ipr, uniform, extended``: the last two are the lines 1/N and factor/N."""
    return spectrum.select("network", "mode", "lambda", "ipr", (1.0 / F.col("n")).alias("uniform"), (factor / F.col("n")).alias("extended"))


def histogram(values: DataFrame, by: Sequence[str], value: str = "v", bins: int = BINS) -> DataFrame:
    """``by, bin, left, width, density`` over each group's own range; the last bin is closed at the right."""
    b = list(by)
    ends = values.groupBy(*b).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    half = F.when(F.col("_hi") > F.col("_lo"), 0.0).otherwise(0.5)
    ends = ends.select(*b, (F.col("_lo") - half).alias("_lo"), (F.col("_hi") + half).alias("_hi"), "_n")
    placed = values.join(ends, b).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int"))
    counted = placed.groupBy(*b, "bin").agg(F.count(F.lit(1)).alias("_c"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return grid.join(counted, [*b, "bin"], "left").select(*b, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), width.alias("width"), (F.coalesce("_c", F.lit(0)) / (F.col("_n") * width)).alias("density"))


def comparison_data(spectrum: DataFrame, a, b) -> tuple[DataFrame, DataFrame]:
    """Histograms ``network, kind, bin, left, width, density`` of two networks, and their rows of statistics."""
    two = spectrum.where(F.col("network").isin([a, b]))
    values = two.select("network", F.expr("stack(2, 'lambda', lambda, 'log_ipr', log10(ipr + 1e-12)) as (kind, v)"))
    return histogram(values, ["network", "kind"]), statistics(two)


def matrix_data(spectrum: DataFrame, alpha: float = 5.0) -> DataFrame:
    """``a, b, s`` for a heat map, upper triangle."""
    return compare_networks(spectrum, alpha).select("a", "b", F.col("spectral_similarity").alias("s"))


def cv_data(scores: DataFrame) -> DataFrame:
    """``network, fold, baseline, augmented, baseline_mean, augmented_mean``."""
    w = Window.partitionBy("network")
    return scores.select("network", "fold", "baseline", "augmented", F.avg("baseline").over(w).alias("baseline_mean"), F.avg("augmented").over(w).alias("augmented_mean"))


def overview_data(nodes: DataFrame, pairs: DataFrame, spectrum: DataFrame, features: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The panels of one overview: map of the most localised mode, spectrum, ceiling curve and statistics."""
    order = Window.partitionBy("network").orderBy(F.desc("ipr"), "mode")
    worst = spectrum.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("network", "mode")
    one = pairs.join(worst, ["network", "mode"], "left_semi").select("network", "mode", F.explode(F.arrays_zip("node_ids", "psi")).alias("_z")).select("network", "mode", F.col("_z.node_ids").alias("node_id"), F.col("_z.psi").alias("psi"))
    out = {"map": bottleneck_map_data(nodes, one), "spectrum": spectrum_data(spectrum), "summary": statistics(spectrum)}
    return out | ({"ceiling": ceiling_curve(nodes, pairs, features)} if "y" in nodes.columns else {})

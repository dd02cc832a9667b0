"""Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    return haversine_radians(F.radians(lat_a), F.radians(lng_a), F.cos(F.radians(lat_a)), F.radians(lat_b), F.radians(lng_b), F.cos(F.radians(lat_b)))


def haversine_radians(lat_a: Column, lng_a: Column, cos_a: Column, lat_b: Column, lng_b: Column, cos_b: Column) -> Column:
    """The same of points in radians whose latitudes' cosines are known."""
    half_lat = F.sin((lat_b - lat_a) / 2)
    half_lng = F.sin((lng_b - lng_a) / 2)
    a = half_lat * half_lat + cos_a * cos_b * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def rbf(distance: Column, sigma: Column) -> Column:
    """Gaussian weight of a distance."""
    return F.exp(-distance * distance / (2 * sigma * sigma))


def standardised(column: str, by: list[str], epsilon: float = 1e-12) -> Column:
    """Centred and divided by the population deviation plus ``epsilon``."""
    w = Window.partitionBy(*by)
    return (F.col(column) - F.avg(column).over(w)) / (F.stddev_pop(column).over(w) + epsilon)


def scaled(column: str, by: list[str]) -> Column:
    """Divided by the population deviation, not centred; a deviation of 1e-12 or less counts as 1."""
    deviation = F.stddev_pop(column).over(Window.partitionBy(*by))
    return F.col(column) / F.when(deviation > 1e-12, deviation).otherwise(1.0)


def min_max(column: str, by: list[str]) -> Column:
    """Rescaled to [0, 1]; a range under 1e-12 gives 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high - low < 1e-12, 0.0).otherwise((F.col(column) - low) / (high - low))


def centred(column: str, by: list[str]) -> Column:
    """Less its mean."""
    return F.col(column) - F.avg(column).over(Window.partitionBy(*by))

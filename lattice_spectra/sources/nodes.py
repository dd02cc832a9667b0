"""Sources: tables on disk to the canonical node table.

``nodes`` is keyed by ``(network, node_id)`` and carries ``lat, lng`` in degrees
or ``vec``, any features and a target ``y``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, missing: str = "raise") -> DataFrame | None:
    """Parquet scan; columns that the file lacks are left out. ``missing='skip'`` gives None for an absent path."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        if missing == "skip":
            return None
        raise FileNotFoundError(path) from None
    return found if columns is None else found.select(*[c for c in columns if c in found.columns])


def network_path(root: str, network: str, kind: str, routes: dict[str, str] | None = None) -> str:
    """Where a network's table lies: its own route, or ``root/network=.../kind``."""
    return (routes or {}).get(network, f"{root}/network={network}/{kind}.parquet")


def zero_filled(column: str | Column, width: int = 6) -> Column:
    """Left zero filling that never cuts longer ids."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def from_arrays(spark: SparkSession, network: str, lat=None, lng=None, coords=None, features=None, target=None) -> DataFrame:
    """In-memory arrays to nodes; ``coords`` wins over ``lat`` and ``lng``. Lengths must agree."""
    if coords is None:
        if lat is None or lng is None:
            raise ValueError("give coords, or lat and lng")
        coords = np.column_stack([np.asarray(lat, float).ravel(), np.asarray(lng, float).ravel()])
    coords = np.asarray(coords, float)
    if coords.ndim != 2:
        raise ValueError("coords must have two dimensions")
    n = len(coords)
    frame = pd.DataFrame({"network": network, "node_id": np.arange(n)})
    if coords.shape[1] >= 2:
        frame["lat"], frame["lng"] = coords[:, 0], coords[:, 1]
    frame["vec"] = [row.tolist() for row in coords]
    if features is not None:
        features = np.asarray(features, float)
        if features.ndim != 2 or len(features) != n:
            raise ValueError("features must be a matrix with a row for each node")
        for j in range(features.shape[1]):
            frame[f"x{j + 1}"] = features[:, j]
    if target is not None:
        target = np.asarray(target, float).ravel()
        if len(target) != n:
            raise ValueError("target must have a value for each node")
        frame["y"] = target
    return spark.createDataFrame(frame)


def station_table(features: DataFrame, demand: DataFrame, id_column: str, value_log: str, needed: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Mean un-logged demand of each station joined to its features; stations without either go.

    The demand is averaged before the join, so the shuffle carries one row for
    each station and task.
    """
    key = F.col(id_column).cast("string") if width is None else zero_filled(id_column, width)
    mean = demand.where(~F.isnan(value_log)).groupBy(key.alias("_id")).agg(F.avg(F.expm1(value_log)).alias("y"))
    joined = features.withColumn("_id", key).join(mean, "_id", "left")
    return joined.na.drop(subset=["y", *needed]).drop(id_column).withColumnRenamed("_id", id_column)


def customers(spark: SparkSession, sf_dir: str, network: str = "c_nationkey") -> DataFrame:
    """Customers as geographic nodes of their nation (or ``n_regionkey``), at spread-out places derived from their keys.

    ``x1`` is the account balance, ``x2`` the number of orders, ``y`` the mean
    order price; customers without orders have null ``x2`` and ``y``.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("x2"), F.avg("o_totalprice").alias("y"))
    part = lambda factor: F.col("c_custkey") * F.lit(factor) - F.floor(F.col("c_custkey") * F.lit(factor))
    own = table("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    if network == "n_regionkey":
        own = own.join(F.broadcast(table("nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col(network).cast("int").alias("network"), F.col("c_custkey").alias("node_id"),
        (48.8 + 0.1 * part(0.6180339887498949)).alias("lat"), (2.3 + 0.1 * part(0.7548776662466927)).alias("lng"),
        F.col("c_acctbal").alias("x1"), "x2", "y",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as feature nodes of one network; ``y`` is the label."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit(0).alias("network"), F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("double").alias("y"))


def spiral_town(spark: SparkSession, network: str, n: int = 100, seed: int = 0, quarters: int = 5, width: float = 0.004) -> DataFrame:
    """A made town: quarters on a golden-angle spiral, each half as wide again as the one before.

    Node i is in quarter ``i % quarters``, at a drawn angle and distance. ``x1``
    to ``x4`` are waves of the place, drawn anew for each seed, plus noise; ``y``
    falls with the distance from the first quarter and rises with ``x1``.
    """
    rng = np.random.default_rng(seed)
    own = np.arange(n) % quarters
    turn, reach = own * np.pi * (3 - np.sqrt(5)), 0.012 * np.sqrt(own)
    angle, far = rng.uniform(0, 2 * np.pi, n), width * 1.5**own / 3 * np.sqrt(rng.uniform(0, 1, n))
    east, north = reach * np.cos(turn) + far * np.cos(angle), reach * np.sin(turn) + far * np.sin(angle)
    waves = rng.uniform(40, 400, (4, 2))
    x = np.sin(np.column_stack([east, north]) @ waves.T) + 0.6 * rng.standard_normal((n, 4))
    y = 30 * np.exp(-np.hypot(east, north) / 0.01) + 4 * x[:, 0] + rng.standard_normal(n)
    return from_arrays(spark, network, lat=45.2 + north, lng=5.7 + east / np.cos(np.radians(45.2)), features=x, target=y)


def uniform_box(spark: SparkSession, network: str, n: int = 50, seed: int = 0) -> DataFrame:
    """Nodes spread evenly over a box."""
    rng = np.random.default_rng(seed)
    return from_arrays(spark, network, lat=rng.uniform(48.8, 48.9, n), lng=rng.uniform(2.3, 2.4, n))

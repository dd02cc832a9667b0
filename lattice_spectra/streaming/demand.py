"""Demand of stations kept up to date from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def station_means(spark: SparkSession, folder: str, schema: StructType, id_column: str, value_log: str) -> DataFrame:
    """A streaming ``id, y``: the mean un-logged demand of each station over all Parquet files that have come so far.

    State is one sum and one count for each station. Write it in complete or
    update mode; the result joins to features as ``station_table`` does.
    """
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.where(F.col(value_log).isNotNull() & ~F.isnan(value_log)).groupBy(F.col(id_column).cast("string").alias(id_column)).agg(F.avg(F.expm1(value_log)).alias("y"))

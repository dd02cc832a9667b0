"""Queries over tables of published results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def excess(atlas: DataFrame) -> DataFrame:
    """Adds ``ipr_excess_z, ipr_ratio, size_bin`` to ``mean_ipr, ipr_null_mean, ipr_null_std, n``."""
    size = F.when(F.col("n") <= 200, "small").when(F.col("n") <= 800, "medium").otherwise("large")
    return atlas.withColumn("ipr_excess_z", (F.col("mean_ipr") - F.col("ipr_null_mean")) / F.col("ipr_null_std")).withColumn("ipr_ratio", F.col("mean_ipr") / F.col("ipr_null_mean")).withColumn("size_bin", size)


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by two labels, with a column for each of ``values``."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def label_summary(rows: DataFrame, label: str, value: str) -> DataFrame:
    """``label, n, mean, std, median`` with the sample deviation."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.median(value).alias("median"))


def block_gain(block: DataFrame, random: DataFrame) -> DataFrame:
    """Mean gains of each city under block and random cross-validation, and what block scores lose."""
    own = block.groupBy("city").agg(F.avg("r2_base").alias("r2_base"), F.avg("r2_aug").alias("r2_aug"), F.avg(F.col("r2_aug") - F.col("r2_base")).alias("gain"))
    other = random.groupBy("city").agg(F.avg("r2_aug").alias("r2_aug_random"), F.avg(F.col("r2_aug") - F.col("r2_base")).alias("gain_random"))
    return own.join(other, "city").withColumn("r2_drop", F.col("r2_aug_random") - F.col("r2_aug")).withColumn("gain_drop", F.col("gain_random") - F.col("gain"))

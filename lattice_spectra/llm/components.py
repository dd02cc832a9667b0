"""Connected components of a link table, by least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links`` (columns ``a, b``); comp is its least node.

    Each round takes the least label among a node's neighbours (a minimum, so a
    hub is pre-aggregated before the shuffle) and then jumps to the label's own
    label. Rounds are cut by tables in the shared folder and end when no label
    changes; nothing is collected but one count. The last table may be given to
    ``discard``.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    table = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        moved = step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("beyond", "comp")).alias("comp"))
        moved = materialize(moved, "labels")
        discard(table)
        labels, table = moved.select("node", "comp"), moved
        if moved.where("comp <> was").isEmpty():
            discard(both)
            labels._scratch = table._scratch
            return labels

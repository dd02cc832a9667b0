"""A stated set of query vectors against all vectors: rows are indexed once, in bounded blocks, and probed by blocks of queries."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors, and queries, that one task holds (on average, dealt by a hash of the id).
ROWS = 8192
QUERIES = 4096
#: Centres that rows are dealt around at most, and rows of the sample for each.
CENTRES, PER_CENTRE = 256, 32
#: Blocks in one file of the index.
BLOCKS_A_FILE = 8


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id long, vec array<double>``: rows with an id and a whole, finite vector."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    if all(len(v) == width for v in rows):
        return np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, width))
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def by_hash(rows: DataFrame, n: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """Deals rows over ``ceil(n / ROWS)`` blocks by a hash; what adds ``block``, and the number of blocks."""
    blocks = max(1, -(-n // ROWS))
    return lambda df: df.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int")), blocks


def by_centre(rows: DataFrame, n: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """Deals rows to blocks of alike ones, as ``by_hash`` returns it: by the nearest of some sampled centres, large ones in parts by a hash.

    The sample is bounded: ``PER_CENTRE`` rows of least hash for each of
    ``CENTRES`` centres at most. Counts of all rows by centre set the parts.
    """
    wanted = min(CENTRES, -(-n // ROWS))
    if wanted < 2:
        return by_hash(rows, n)
    sample = [r["vec"] for r in rows.orderBy(F.xxhash64("id", F.lit(5)), "id", "vec").limit(PER_CENTRE * wanted).select("vec").collect()]
    width = max(map(len, sample)) or 1
    x = matrix(pd.Series(sample), width)
    centres = x[:: max(1, len(x) // wanted)][:wanted]
    for _ in range(8):
        own = _near(x, centres)
        centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])

    def dealt(batches):
        for frame in batches:
            frame["centre"] = _near(matrix(frame.vec.map(lambda v: v[:width]), width), centres) if len(frame) else np.zeros(0, int)
            yield frame

    def near(df: DataFrame) -> DataFrame:
        return df.select("id", "vec").mapInPandas(dealt, "id long, vec array<double>, centre int")

    counts = {r["centre"]: r["n"] for r in near(rows).groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each centre
    parts = [max(1, -(-counts.get(c, 0) // ROWS)) for c in range(len(centres))]
    first = np.cumsum([0, *parts[:-1]]).tolist()
    table = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("parts")) for a, b in zip(first, parts, strict=True)])
    spread = table[F.col("centre")]
    return lambda df: near(df).withColumn("block", (spread["first"] + F.pmod(F.xxhash64("id", "vec"), spread["parts"])).cast("int")).drop("centre"), sum(parts)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre nearest to each row."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(x @ centres.T - (centres * centres).sum(axis=1) / 2, nan=-np.inf).argmax(axis=1)


def search(rows: DataFrame, is_query: Column, build: Callable, probe: Callable, k: int, score: str, deal: Callable = by_hash, home_first: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best of what ``probe`` returns for each pair of blocks.

    ``build`` makes the index of a block from a pandas frame (id, vec), once;
    the indexes are a table in the shared folder. ``probe(queries, index)`` gets
    a frame (id, vec, least) and returns query ids, ids and scores, k rows a
    query at most. Every query block meets every row block once; both are
    bounded, so one task's memory doesn't grow with the table. With
    ``home_first`` queries first meet the block that they are dealt to, and
    ``least`` is the score that others must reach from then on (else null). An
    id that repeats is one query (its least vector), and each of its rows a
    candidate of other queries.
    """
    wanted = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    n, q = rows.count(), wanted.count()
    place, n_blocks = deal(rows, n)
    n_queries = max(1, -(-q // QUERIES))

    def indexed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [frame.block.iloc[0]], "index": [pickle.dumps(build(frame[["id", "vec"]]), protocol=5)]})

    blocks = materialize(place(rows).groupBy("block").applyInPandas(indexed, "block int, index binary"), "blocks", BLOCKS_A_FILE)
    kind = "float64" if score == "double" else "int64"

    def both(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = ([], [], [])
        if len(queries) and len(members):
            found = probe(queries.rename(columns={"q_id": "id", "q_vec": "vec", "q_least": "least"}), pickle.loads(members["index"].iloc[0]))
        return pd.DataFrame({"query_id": np.asarray(found[0], "int64"), "vec_id": np.asarray(found[1], "int64"), "score": np.asarray(found[2], kind)})

    schema = f"query_id long, vec_id long, score {score}"
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    asked = place(wanted).select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), F.col("block").alias("q_home"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_queries)).cast("int").alias("q_qb"))
    none = F.lit(None).cast(score).alias("q_least")
    if home_first and n > ROWS:
        own = asked.select("q_id", "q_vec", F.col("q_home").alias("q_block"), none)
        first = materialize(own.groupBy("q_block").cogroup(blocks.groupBy("block")).applyInPandas(both, schema), "first")
        least = first.groupBy(F.col("query_id").alias("q_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
        asked = asked.join(least, "q_id", "left").withColumn("q_least", F.when(F.col("_n") >= k, F.col("_least"))).drop("_n", "_least")
        pairs = asked.withColumn("q_block", every).where("q_block <> q_home")
    else:
        pairs = asked.withColumn("q_least", none).withColumn("q_block", every)
        first = None
    right = blocks.select(F.col("block").alias("r_block"), "index", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("r_qb"))
    found = pairs.select("q_id", "q_vec", "q_least", "q_qb", "q_block").groupBy("q_qb", "q_block").cogroup(right.groupBy("r_qb", "r_block")).applyInPandas(both, schema)
    if first is not None:
        found = found.unionByName(first)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

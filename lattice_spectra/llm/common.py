"""Shared helpers: scratch tables in the cluster's shared folder, document
columns, Arrow access and 64-bit hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: While a table is made: shuffle files go when it is there, and workers get smaller batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can read and write.

    The session's ``spark.checkpoint.dir`` is used where it is set. Where it is
    not, a local master gets a temporary folder (driver and executors are one
    process) and a cluster a folder of the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lattice.scratch.dir", None)
    if not found:
        if spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
            found = "file://" + tempfile.mkdtemp(prefix="lattice-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("lattice.scratch.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it goes when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/lattice-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return root


def materialize(df: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: lost executors cost a re-read, not a recomputation.
    The shuffle files that the table was made from go at once; the table goes
    by ``discard``, or with the application. ``rows_a_file`` bounds the rows of a
    file (0: unbounded), for rows of megabytes. Settings of ``_WRITING`` hold for
    the session while the table is written and are put back, so queries that
    run at the same time should have sessions of their own.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Values of a label up to which their counts are broadcast.
VALUES = 10_000


#: Slices of a label's sample by hash, each ranked by a task of its own.
SLICES = 16


def bounded_sample(rows: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    """The ``n`` rows of least ``order`` (a hash) of each value of ``by``, with their rank ``_r`` from 1.

    Values with many more rows are thinned by the hash's high bits first, by
    their counts, so that what is ranked has a few times ``n`` rows of each
    value, whatever the table's size. Ranks are taken in slices of the hash, so
    that one value isn't one task. Counts are broadcast if there are at most
    ``VALUES`` of them. Of rows with equal hashes any may come first.
    """
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_all"))
    few = counts.limit(VALUES + 1).collect()
    if len(few) <= VALUES:
        counts = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in few], counts.schema))
    share = F.least(F.lit(1.0), F.lit(4.0 * n + 100) / F.col("_all"))
    place = (F.col("_h").cast("double") / 2.0**64 + 0.5) / share
    near = rows.withColumn("_h", order).join(counts, by).withColumn("_s", F.floor(place * SLICES).cast("int")).where(place <= 1).drop("_all")
    near = materialize(near, "sample")
    before = Window.partitionBy(by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = near.groupBy(by, "_s").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select(by, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = near.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_s").orderBy("_h")))
    return inside.join(first, [by, "_s"]).withColumn("_r", F.col("_first") + F.col("_at")).where(F.col("_r") <= n).drop("_s", "_at", "_first")


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, where it still has Spark's own: whole texts are long rows."""
    for k, default, v in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864", "8388608")):
        name = f"spark.sql.execution.arrow.{k}"
        if spark.conf.get(name, default).rstrip("b") == default:
            spark.conf.set(name, v)


_held: dict[tuple, object] = {}


def release() -> None:
    """Lets go of what other operators keep in this worker, and gives what is free back to the system."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held(key: tuple, make: Callable[[], object]) -> object:
    """What an operator keeps in a worker between tasks; another operator's goes, as workers are shared."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def crc_part(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus`` (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of an Arrow string array without nulls."""
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
        large = True
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xCA5A826395121157)
    return x ^ (x >> U64(32))


def ranked(df: DataFrame, klass: list[str], order: list[str], spread: int = 64) -> DataFrame:
    """Adds ``rank``: gapless from 0 inside each class, without one task per class.

    Rows of a class are dealt over ``spread`` slices by a hash of ``order``;
    slice counts give each slice its first rank, so that a class with a third
    of all rows is still numbered by ``spread`` tasks. ``order`` must tell the
    rows of a class apart for a result that doesn't depend on the partitioning.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    counts = sliced.groupBy(*klass, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*klass).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*klass, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*klass, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(first, [*klass, "_slice"]).withColumn("rank", (F.col("_first") + F.col("_at")).cast("long")).drop("_slice", "_at", "_first")

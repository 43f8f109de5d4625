"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Rows that executors and workers of the pipeline's stages hold of the texts at a time.
BATCH_ROWS = 1000
#: Rows from which a key can count as one that holds many; narrow rows that are worth a task.
MANY, TASK_ROWS = 1000, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "weldsight-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the folder that ``written`` made, once what was read from it is written or checkpointed itself."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A frame of so many narrow rows in no more tasks than they are worth."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows, read in no more tasks than they are worth."""
    out = cut(df)
    return narrow(out, out.count())


def lookup(rows: DataFrame, named: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``named``, which has one small row for each key, also where few keys hold most rows.

    Keys with over a quarter of a partition's share of the rows, hence at most 4 for each partition, are looked up in
    a broadcast table; the others are shuffled. Both frames are read more than once, so callers cut them first.
    """
    least = max(MANY, rows.count() // (4 * partitions(rows.sparkSession)) + 1)
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least).select(key)
    keys = [r[0] for r in many.collect() if r[0] is not None]  # 4 for each partition at most
    if not keys:
        return rows.join(named, key, how)
    few = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in keys], many.schema))
    hot = rows.join(few, key, "left_semi").join(F.broadcast(named.join(few, key, "left_semi")), key, how)
    return hot.unionByName(rows.join(few, key, "left_anti").join(named, key, how))


def trim() -> None:
    """Gives memory that a task has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` for the jobs that run inside: what executors hold of long texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def settled_in_place(spark: SparkSession):
    """Plans inside keep their partitions as written down, so that a checkpoint is known to be dealt by its keys."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column without nulls; offsets start at zero."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 for every i, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - begin, lengths)


def slots(df: DataFrame, part: str, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``part``, without one task for each value.

    Rows are numbered within (part, bucket); the offsets come from the counts of the buckets, so the caller bounds
    the number of buckets for each part. Rows of a lower bucket come first.
    """
    with_bucket = df.withColumn("_bucket", bucket)
    counts = with_bucket.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(part, "_bucket").orderBy(*order)
    numbered = with_bucket.withColumn("_row", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, [part, "_bucket"])
    return joined.withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_bucket", "_before", "_row")

"""Helpers shared by the training-data operators: tables, the shared folder and Arrow columns."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

WORD = r"[^\x20\x09-\x0D]+"
_SERIAL = itertools.count()
#: Whether Spark drops a plan's shuffle files at its end; else they stay until the driver's next full collection, and disks may fill first.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset a local one is set in local mode alone, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop's file system removes it when the application ends."""
    path = f"{shared_dir(spark)}/plinth-{spark.sparkContext.applicationId}/{next(_SERIAL)}-{name}-{uuid.uuid4().hex[:8]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage; lost executors don't lose it. Its shuffle files go when it is written."""
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plinth_path = path
    return out


def release(df: DataFrame) -> None:
    """Drops a table of materialize() which nothing reads any more."""
    if path := getattr(df, "_plinth_path", None):
        drop_path(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary Arrow column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def doc_key(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """_id and _th, by which rows join with their equals: the id (its hash where it is no integer, the text's where it is null) and a 32-bit hash of id and text, which tells apart the rows that share an id."""
    own = F.col(id_col)
    whole = own.cast("long") if isinstance(df.schema[id_col].dataType, IntegralType) else F.when(own.isNotNull(), F.xxhash64(own))
    return F.coalesce(whole, F.xxhash64(F.lit("null"), F.col(text_col))).alias("_id"), F.hash(own, F.col(text_col)).alias("_th")


def batches_of(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Splits batches at rows so that each holds about most_bytes at most, or one row."""
    for b in batches:
        if b.nbytes <= most_bytes:
            yield b
            continue
        step = max(1, math.ceil(b.num_rows / math.ceil(b.nbytes / most_bytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1]
    return starts, np.diff(np.r_[starts, len(values)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """arange(s, s + n) for each pair, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total)

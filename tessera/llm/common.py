"""Helpers shared by the training-data operators: shared tables, Arrow text access, sizing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where no checkpoint folder is set, a local session makes a temporary one; on a cluster that is an error, since
    executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage. `release` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_at = path
    return written


def release(*written: DataFrame | None) -> None:
    """Delete tables that `materialize` wrote, once nothing that is still to be computed reads them."""
    for df in written:
        if df is not None:
            jvm, path = df.sparkSession._jvm, df.written_at
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def sized(df: DataFrame, label: str, most_rows: int = 1_000_000) -> DataFrame:
    """`df`, of a few ids a row, written and counted: broadcast up to `most_rows`, joined by a shuffle beyond."""
    df = materialize(df, label)
    out = F.broadcast(df) if df.count() <= most_rows else df.hint("shuffle_merge")
    out.written_at = df.written_at
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, total_bytes: int, target_bytes: int) -> int:
    """Partitions of about `target_bytes` each, at least the session's shuffle width."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(width, -(-int(total_bytes) // target_bytes))


def fold_of(column, modulus: int):
    """crc32 of the id as text, modulo `modulus`: the fixed split into folds."""
    return F.crc32(column.cast("string")) % F.lit(modulus)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with 64-bit offsets, nulls as empty strings."""
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a large_string array, without copying the text."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, ends


def row_slices(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes each (one longer row stands alone)."""
    low, n = 0, len(ends) - 1
    while low < n:
        high = int(np.searchsorted(ends, ends[low] + limit, side="right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


def take_rows(batch: pa.RecordBatch, low: int, high: int) -> pa.RecordBatch:
    return batch.slice(low, high - low)

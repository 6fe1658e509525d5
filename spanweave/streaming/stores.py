"""Snapshots, latest-per-key stores and span coverage over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from spanweave.operators.store import upsert


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, key: str, at: str, forget_after: str) -> DataFrame:
    """Rows whose key was not seen within ``forget_after``: the streaming form of a snapshot difference."""
    return stream.withWatermark(at, forget_after).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Rows per key and tumbling window; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Runs of rows no further apart than ``gap``; the window's end is the last row's time plus the gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).select(F.col("w.start").alias("start"), "last", *keys, "n")


def maintain_latest(stream: DataFrame, folder: str, key: str, updated: str, schema: T.StructType) -> DataStreamWriter:
    """Keep the latest row per key in versions of a Parquet store, one per batch; a repeated batch writes its version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current_store(spark, folder, number, schema)
        upsert(before, batch, key, updated).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(merge)


def current_store(spark: SparkSession, folder: str, before: int, schema: T.StructType) -> DataFrame:
    """The store as the batch before left it, empty at first."""
    if before == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/version={before - 1}")

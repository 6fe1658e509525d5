"""Views of the supplied tables as the engine's tables. Times are whole seconds in double, so sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds per unit of an event's value.
SECONDS = 600
#: Width of time bins for joins over event spans.
BIN_S = 86_400.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a span: key, id, kind, start_s, end_s, value."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), start.alias("start_s"), "value")
    return events.withColumn("end_s", F.col("start_s") + F.floor(F.col("value") * SECONDS) + 1)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as expected lines; one of three speakers by number."""
    who = F.element_at(F.array(*map(F.lit, ("click", "signup", "view"))), (F.col("id") % 3).cast("int") + 1)
    return spans(spark, sf_dir).where("kind = 'purchase'").select("key", F.col("id").alias("line"), who.alias("speaker"), "start_s", "end_s")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other events as activity; ``error`` is a channel that no speaker owns."""
    return spans(spark, sf_dir).where("kind <> 'purchase'").select("key", F.col("id").alias("region"), F.col("kind").alias("channel"), "start_s", "end_s")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a script: one character of text is a tenth of a second, turns follow each other."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("line"), F.col("role").alias("speaker"), "text")
    w = Window.partitionBy("key").orderBy("line")
    n = F.length("text")
    return t.withColumns({"end_s": F.sum(n).over(w) / 10, "start_s": (F.sum(n).over(w) - n) / 10})

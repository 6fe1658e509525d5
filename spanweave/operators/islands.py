"""Runs of neighbouring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_runs(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Number the runs of each key; ``breaks`` is true where a row does not continue the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_b", F.when(first | breaks, 1).otherwise(0)).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def ahead_in_blocks(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of all rows ahead of each in its key.

    ``df`` has a column block that follows the order. The maximum is taken within blocks and over the blocks ahead, and the
    greater one counts, so that a key with all rows is as many tasks as it has blocks.
    """
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "block").agg(F.max(value).alias("_of"))
    before = ends.select(*keys, "block", F.max("_of").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return df.withColumn("_own", F.max(value).over(inside)).join(before, [*keys, "block"]).withColumn(name, F.greatest("_own", "_before")).drop("_own", "_before")


def number_in_blocks(df: DataFrame, keys: list[str], order: list[str], opens: str, name: str) -> DataFrame:
    """Like number_runs(), by blocks: how many rows up to each one have ``opens``."""
    one = F.when(F.col(opens), 1).otherwise(0)
    total = df.groupBy(*keys, "block").agg(F.sum(one).alias("_n"))
    before = total.select(*keys, "block", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(one).over(Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_own", own).join(before, [*keys, "block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_n")


def blocks(missing: DataFrame, keys: list[str], gap_s: float, least: int, quiet: float) -> DataFrame:
    """Blocks of at least ``least`` missing lines: close in time, of consecutive numbers, in quiet slots.

    Adds block_id (in time order), block_n and block_first; null for lines in no block.
    """
    w = Window.partitionBy(*keys).orderBy("start_s", "line")
    calm = lambda c: F.coalesce(c, F.lit(0.0)) <= quiet
    joins = (F.col("start_s") - F.lag("end_s").over(w) <= gap_s) & calm(F.col("slot")) & calm(F.lag("slot").over(w)) & F.coalesce(F.col("line") - F.lag("line").over(w) == 1, F.lit(True))
    runs = number_runs(missing, keys, ["start_s", "line"], ~F.coalesce(joins, F.lit(False)))
    run = Window.partitionBy(*keys, "run")
    sized = runs.withColumn("n", F.count(F.lit(1)).over(run))
    kept = F.col("n") >= least
    first = F.row_number().over(run.orderBy("start_s", "line")) == 1
    opened = sized.withColumn("opens", F.when(kept & first, 1).otherwise(0))
    ids = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumns({"block_id": F.when(kept, ids), "block_n": F.when(kept, F.col("n")), "block_first": F.when(kept, F.col("opens") == 1)}).drop("run", "n", "opens")


def clusters(anchors: DataFrame, keys: list[str], gap_s: float, edge_s: float, least: int = 2) -> DataFrame:
    """Spans of anchors no further apart than ``gap_s``, widened by ``edge_s``; single anchors make none."""
    w = Window.partitionBy(*keys).orderBy("at_s")
    runs = number_runs(anchors, keys, ["at_s"], F.col("at_s") - F.lag("at_s").over(w) > gap_s)
    return runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("anchors"), (F.min("at_s") - edge_s).alias("start_s"), (F.max("at_s") + edge_s).alias("end_s")).where(F.col("anchors") >= least).drop("run")

"""Nearest matches in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(points: DataFrame, others: DataFrame, keys: list[str], ids: list[str], at: str, other_at: str, within: float) -> DataFrame:
    """Per point the nearest other at most ``within`` seconds away on either side; of equals the earlier.

    Points are looked for in their own and the two neighbouring bins of that width, so a join never pairs
    what is further apart.
    """
    p = points.withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col(at) / within) + d)))
    o = others.select(*keys, F.col(other_at).alias("near_s")).withColumn("bin", F.floor(F.col("near_s") / within))
    gap = F.abs(F.col("near_s") - F.col(at))
    pairs = p.join(o, [*keys, "bin"]).where(gap <= within)
    return pairs.groupBy(*keys, *ids, at).agg(F.min(F.struct(gap.alias("gap"), F.col("near_s"))).alias("best")).select(*keys, *ids, at, F.col("best.near_s").alias("near_s"))


def offsets(lines: DataFrame, regions: DataFrame, keys: list[str], ids: list[str], within: float, min_anchors: int) -> DataFrame:
    """Per key the median signed distance from line starts to their nearest region starts; 0 with too few anchors."""
    found = nearest(lines, regions, keys, ids, "start_s", "start_s", within)
    delta = F.col("near_s") - F.col("start_s")
    enough: Column = F.count(F.lit(1)) >= min_anchors
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("anchors"), F.when(enough, F.median(delta)).otherwise(0.0).alias("offset_s"))


def best_in_window(lines: DataFrame, others: DataFrame, keys: list[str], ids: list[str], score: Column, within: float, shift: float = 0.0, bin_width: float = 60.0) -> DataFrame:
    """Per line the other that starts at most ``within`` seconds before or after it (moved by ``shift``) with the highest ``score`` above 0; of equals the first.

    ``score`` uses the lines' columns and the others', these prefixed with ``r_``.
    """
    low, high = F.col("start_s") + shift - within, F.col("end_s") + shift + within
    spread = lines.withColumn("bin", F.explode(F.sequence(F.floor(low / bin_width), F.floor(high / bin_width))))
    near = others.select(*keys, *(F.col(c).alias(f"r_{c}") for c in others.columns if c not in keys)).withColumn("bin", F.floor(F.col("r_start_s") / bin_width))
    pairs = spread.join(near, [*keys, "bin"]).where((F.col("r_start_s") >= low) & (F.col("r_start_s") <= high)).withColumn("_score", score).where("_score > 0")
    best = F.max(F.struct("_score", (-F.col("r_start_s")).alias("_at"))).alias("_best")
    return pairs.groupBy(*keys, *ids).agg(best).select(*keys, *ids, F.col("_best._score").alias("score"), (-F.col("_best._at")).alias("at_s"))

"""Half-open spans: overlap joins, coverage, coalescing, anti-joins.

Touching spans do not overlap. Sums guard unmatched rows explicitly, because ``least`` and
``greatest`` skip nulls and would credit them with their whole duration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.operators.islands import ahead_in_blocks, number_in_blocks


#: How many times wider the bins of the next class of lengths are.
STEP = 8


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared seconds of two spans, 0 where either is missing."""
    return F.when(a0.isNull() | b0.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)))


def _bins(df: DataFrame, start: str, end: str, width: Column | float) -> DataFrame:
    """A row per bin that the span touches."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bin_width: float, any_length: bool = False) -> DataFrame:
    """Pairs of left and right rows of equal keys that overlap, each pair once.

    Both sides are spread over bins of ``bin_width`` seconds and joined on keys and bin, so a key with many
    spans is not one pairwise block; a pair counts only in the bin where its overlap begins. Right columns
    but the keys are prefixed with ``r_``. A span costs a row for each bin; where some are far longer than others,
    ``any_length`` bounds that at the price of another look at both sides' lengths.
    """
    if any_length:
        return _overlap_by_class(left, right, keys, bin_width)
    r = _bins(right, "start_s", "end_s", bin_width).select(*keys, "bin", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    both = _bins(left, "start_s", "end_s", bin_width).join(r, [*keys, "bin"])
    begins = F.greatest(F.col("start_s"), F.col("r_start_s"))
    return both.where((F.col("r_start_s") < F.col("end_s")) & (F.col("start_s") < F.col("r_end_s")) & (F.col("bin") == F.floor(begins / bin_width))).drop("bin")


def _overlap_by_class(left: DataFrame, right: DataFrame, keys: list[str], bin_width: float) -> DataFrame:
    """The pairs of overlap_join() for spans of all lengths.

    Spans of up to ``STEP`` bins are of class 0, those of up to ``STEP`` times that of class 1, whose bins are as many
    times wider, and so on, so a span lies in ``STEP`` + 1 bins of its class at most, however long it is. A pair meets in
    the bins of the longer one's class, in a list of its own for either side being that. Shorter spans go to a class only if
    the other side has it; the classes of a side are one aggregate.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log(float(STEP), (F.col("end_s") - F.col("start_s")) / bin_width) - 1)).cast("int")
    classed = lambda df: df.withColumn("_level", F.coalesce(F.when(F.col("end_s") > F.col("start_s"), level), F.lit(0)))
    a, b = classed(left), classed(right)
    levels = lambda df: F.coalesce(df.agg(F.collect_set("_level").alias("x")).scalar(), F.array().cast("array<int>"))
    entry = lambda m, longer: F.struct(m.alias("m"), F.lit(longer).alias("longer"))
    at = lambda keep, longer: F.transform(F.filter("_levels", keep), lambda m: entry(m, longer))
    width = bin_width * F.pow(F.lit(float(STEP)), F.col("_at.m"))

    def spread(df: DataFrame, others: DataFrame, own: str, more: Column) -> DataFrame:
        posted = df.withColumn("_levels", levels(others)).withColumn("_at", F.explode(F.concat(F.array(entry(F.col("_level"), own)), more)))
        return _bins(posted, "start_s", "end_s", width)

    ours = spread(a, b, "left", at(lambda m: m > F.col("_level"), "right"))
    theirs = spread(b, a, "right", at(lambda m: m >= F.col("_level"), "left"))
    r = theirs.select(*keys, "_at", "bin", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    begins = F.greatest(F.col("start_s"), F.col("r_start_s"))
    both = ours.join(r, [*keys, "_at", "bin"]).where((F.col("r_start_s") < F.col("end_s")) & (F.col("start_s") < F.col("r_end_s")))
    return both.where(F.col("bin") == F.floor(begins / width)).drop("_at", "bin", "_level", "_levels")


def coverage(spans: DataFrame, regions: DataFrame, keys: list[str], ids: list[str], bin_width: float, by: list[str] | None = None) -> DataFrame:
    """Per span (and per ``by`` of the regions) the overlap seconds, coverage and hull of the regions that it overlaps.

    Regions are not merged first: overlapping ones count twice and coverage can exceed 1. Spans without
    any overlap have no row; join back to keep them.
    """
    groups = [f"r_{c}" for c in by or []]
    hit = overlap_join(spans, regions, keys, bin_width)
    over = F.sum(overlap_seconds(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s")))
    out = hit.groupBy(*keys, *ids, "start_s", "end_s", *groups).agg(over.alias("overlap_s"), F.min("r_start_s").alias("hull_start_s"), F.max("r_end_s").alias("hull_end_s"))
    return out.withColumn("coverage", F.col("overlap_s") / F.greatest(F.lit(1e-9), F.col("end_s") - F.col("start_s")))


def uncovered(spans: DataFrame, others: DataFrame, keys: list[str], ids: list[str], bin_width: float) -> DataFrame:
    """Spans that overlap no other: an interval anti-join."""
    return spans.join(overlap_join(spans, others, keys, bin_width).select(*keys, *ids).distinct(), [*keys, *ids], "left_anti")


def coalesce_spans(spans: DataFrame, keys: list[str], block_s: float | None = None) -> DataFrame:
    """The union of each key's spans; touching ones merge. With ``block_s`` a key is worked on in blocks of that many seconds, so a hot one is no single task."""
    span = [*keys, "start_s", "end_s"]
    if block_s is None:
        order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
        reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(reach.isNull() | (F.col("start_s") > reach), 1).otherwise(0)
        island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
        numbered = spans.select(*span).withColumn("opens", opens).withColumn("island", island)
    else:
        blocked = spans.select(*span, F.floor(F.col("start_s") / block_s).alias("block"))
        reached = ahead_in_blocks(blocked, keys, ["start_s", "end_s"], F.col("end_s"), "reach")
        numbered = number_in_blocks(reached.withColumn("opens", F.col("reach").isNull() | (F.col("start_s") > F.col("reach"))), keys, ["start_s", "end_s"], "opens", "island")
    return numbered.groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")


def best_covering(spans: DataFrame, regions: DataFrame, keys: list[str], ids: list[str], bin_width: float, exclude: Column | None = None) -> DataFrame:
    """Per span the channel that covers it best; of equals the one first by name. ``exclude`` drops pairs."""
    found = coverage(spans, regions, keys, ids, bin_width, by=["channel"])
    if exclude is not None:
        found = found.where(~exclude)
    rank = F.row_number().over(Window.partitionBy(*keys, *ids).orderBy(F.col("coverage").desc(), "r_channel"))
    return found.withColumn("rank", rank).where("rank = 1").drop("rank").withColumnRenamed("r_channel", "channel")


def pair_scores(lines: DataFrame, regions: DataFrame, keys: list[str], bin_width: float) -> DataFrame:
    """For every channel and speaker of a key: shared seconds, precision by the channel's and recall by the speaker's time.

    Both sides are coalesced first. Only pairs of one key are crossed: channels times speakers of an episode.
    """
    a = coalesce_spans(lines.select(*keys, "speaker", "start_s", "end_s"), [*keys, "speaker"])
    b = coalesce_spans(regions.select(*keys, "channel", "start_s", "end_s"), [*keys, "channel"])
    total = F.sum(F.col("end_s") - F.col("start_s"))
    pairs = a.groupBy(*keys, "speaker").agg(total.alias("line_s")).join(b.groupBy(*keys, "channel").agg(total.alias("speech_s")), keys)
    shared = F.sum(overlap_seconds(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s")))
    hit = overlap_join(a, b, keys, bin_width).groupBy(*keys, "speaker", F.col("r_channel").alias("channel")).agg(shared.alias("overlap_s"))
    out = pairs.join(hit, [*keys, "speaker", "channel"], "left").fillna(0.0, ["overlap_s"])
    share = lambda c: F.when(F.col(c) > 0, F.col("overlap_s") / F.col(c)).otherwise(0.0)
    return out.withColumns({"precision": share("speech_s"), "recall": share("line_s")})

"""Frames to regions: two-threshold speech segmentation and level statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.config import LEVEL, VAD, LevelConfig, VadConfig
from spanweave.functions.levels import decibels
from spanweave.operators.intervals import coalesce_spans, overlap_join


def detect_speech(frames: DataFrame, keys: list[str], cfg: VadConfig = VAD) -> DataFrame:
    """Padded, merged regions per track from frames (i, prob, step_s).

    A frame at ``on`` opens a region or goes on with it. It ends with the first frame below ``off`` behind its last
    frame at ``on`` if ``min_silence_s`` later one is still below; frames between the two thresholds do neither. So
    the frames from one at ``on`` up to the next are one group, and groups join to regions unless a silence parts them.
    """
    low = max(0.15, min(cfg.off, cfg.on - 0.15))
    w = Window.partitionBy(*keys).orderBy("i")
    loud, quiet = F.col("prob") >= cfg.on, F.col("prob") < low
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    at = frames.withColumn("_group", F.sum(F.when(loud, 1).otherwise(0)).over(upto(w)))
    place = lambda c: F.when(c, F.col("i"))
    size = frames.groupBy(*keys).agg((F.count(F.lit(1)) * F.first("step_s")).alias("_length"))
    groups = at.where("_group > 0").groupBy(*keys, "_group").agg(F.min("i").alias("_on"), F.min(place(quiet)).alias("_first"), F.max(place(quiet)).alias("_last"), F.first("step_s").alias("_step"))
    silent = F.coalesce((F.col("_last") - F.col("_first")) * F.col("_step") >= cfg.min_silence_s - 1e-9, F.lit(False))
    order = Window.partitionBy(*keys).orderBy("_group")
    opened = groups.withColumn("_silent", silent).withColumn("_opens", F.when(F.coalesce(F.lag("_silent").over(order), F.lit(True)), 1).otherwise(0))
    regions = opened.withColumn("_region", F.sum("_opens").over(upto(order))).groupBy(*keys, "_region").agg(
        F.min(F.col("_on") * F.col("_step")).alias("start_s"), F.max_by(F.when(F.col("_silent"), F.col("_first") * F.col("_step")), "_group").alias("_stop")
    )
    whole = regions.join(size, keys).withColumn("end_s", F.coalesce("_stop", "_length")).where(F.col("end_s") - F.col("start_s") >= cfg.min_speech_s - 1e-9)
    padded = whole.withColumns({"start_s": F.greatest(F.lit(0.0), F.col("start_s") - cfg.pad_s), "end_s": F.least("_length", F.col("end_s") + cfg.pad_s)})
    return coalesce_spans(padded, keys).withColumns({"start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)})


def frames_of_lines(lines: DataFrame, regions: DataFrame, keys: list[str], ids: list[str], bin_width: float, cfg: LevelConfig = LEVEL) -> DataFrame:
    """The stretches of speech by which a line's level is judged: its padded window cut with the regions, merged, so that no frame counts twice."""
    wide = lines.withColumns({"start_s": F.col("start_s") - cfg.pad_s, "end_s": F.col("end_s") + cfg.pad_s})
    cut = overlap_join(wide, regions.select(*keys, "start_s", "end_s"), keys, bin_width).select(*keys, *ids, F.greatest("start_s", "r_start_s").alias("start_s"), F.least("end_s", "r_end_s").alias("end_s"))
    return coalesce_spans(cut, [*keys, *ids])


def line_levels(line_frames: DataFrame, keys: list[str]) -> DataFrame:
    """Level and peak in dB per line from its frames (rms, peak), each frame once."""
    power = F.sqrt(F.avg(F.col("rms") * F.col("rms")))
    return line_frames.groupBy(*keys).agg(decibels(power).alias("level_db"), decibels(F.max("peak")).alias("peak_db"))


def levels_in_speech(lines: DataFrame, regions: DataFrame, frames: DataFrame, keys: list[str], ids: list[str], bin_width: float, cfg: LevelConfig = LEVEL) -> DataFrame:
    """Level and peak of lines (start_s, end_s) from the frames (start_s, end_s, rms, peak) that touch speech in their padded window, each once though it touches two stretches; lines without any have no row.

    Frames that begin together with other levels all count.
    """
    stretches = frames_of_lines(lines, regions, keys, ids, bin_width, cfg)
    hit = overlap_join(stretches, frames.select(*keys, "start_s", "end_s", "rms", "peak"), keys, bin_width)
    each = hit.select(*keys, *ids, F.col("r_start_s").alias("at"), F.col("r_rms").alias("rms"), F.col("r_peak").alias("peak")).distinct()
    return line_levels(each, [*keys, *ids])


def reference_level(frames: DataFrame, windows: DataFrame, keys: list[str], bin_width: float, first: int = 400) -> DataFrame:
    """The usual speech level of a track in dB: the median of the frames (start_s, end_s, rms) inside its ``first`` windows of speech."""
    ranked = windows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "end_s"))).where(F.col("_r") <= first)
    inside = overlap_join(ranked.select(*keys, "_r", "start_s", "end_s"), frames.select(*keys, "start_s", "end_s", "rms"), keys, bin_width)
    inside = inside.where((F.col("r_start_s") >= F.col("start_s")) & (F.col("r_end_s") <= F.col("end_s")))
    return inside.groupBy(*keys).agg(decibels(F.median("r_rms")).alias("reference_db"))


def sung(lines: DataFrame, frames: DataFrame, keys: list[str], ids: list[str], bin_width: float, window_s: float = 4.0, margin_db: float = -4.0, least_s: float = 0.1) -> DataFrame:
    """Lines with sung and sung_margin_db: how far the accompaniment's level lies above the voice's around a line's middle.

    ``frames``: keys, start_s, end_s, voice, music (RMS of equal frames). Null where less than ``least_s`` of frames is there.
    """
    middle = (F.col("start_s") + F.greatest(F.col("end_s"), F.col("start_s") + 0.3)) / 2
    around = lines.select(*keys, *ids, F.greatest(F.lit(0.0), middle - window_s).alias("start_s"), (middle + window_s).alias("end_s"))
    hit = overlap_join(around, frames.select(*keys, "start_s", "end_s", "voice", "music"), keys, bin_width)
    hit = hit.where((F.col("r_start_s") >= F.col("start_s")) & (F.col("r_end_s") <= F.col("end_s")))
    raw = lambda c: 20 * F.log10(F.greatest(F.sqrt(F.avg(F.col(c) * F.col(c))), F.lit(1e-9)))
    found = hit.groupBy(*keys, *ids).agg(F.sum(F.col("r_end_s") - F.col("r_start_s")).alias("_s"), (raw("r_music") - raw("r_voice")).alias("_d")).where(F.col("_s") >= least_s)
    return lines.join(found, [*keys, *ids], "left").withColumns({"sung": F.col("_d") >= margin_db, "sung_margin_db": F.round("_d", 1)}).drop("_s", "_d")


def level_flags(levels: DataFrame, speaker: list[str], cfg: LevelConfig = LEVEL) -> DataFrame:
    """LOUD, QUIET or null per audible line, against fixed bounds and the speaker's median."""
    audible = levels.where(F.col("level_db") > cfg.silence_db)
    own = audible.groupBy(*speaker).agg(F.median("level_db").alias("median_db"), F.count(F.lit(1)).alias("n"))
    low = (F.col("level_db") < cfg.quiet_db) | ((F.col("n") >= cfg.min_lines) & (F.col("level_db") < F.col("median_db") - cfg.relative_db))
    return audible.join(own, speaker).withColumn("flag", F.when(F.col("peak_db") >= cfg.hot_db, "LOUD").when(low, "QUIET"))


def upper_half(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper median of each key."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"k": F.row_number().over(w.orderBy(value)), "n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select(*keys, F.col(value).alias("upper_median"))

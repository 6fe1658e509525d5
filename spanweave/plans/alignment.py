"""Script alignment: which expected lines are missing, on another channel or shifted, and what is extra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.config import ALIGN, AlignConfig
from spanweave.operators.asof import offsets
from spanweave.operators.intervals import best_covering, coalesce_spans, coverage, overlap_join, uncovered
from spanweave.operators.mapping import group_named


def by_speaker(segments: DataFrame, characters: str = "characters") -> DataFrame:
    """A row per speaker of each segment; a line of several speakers counts in full for each."""
    return segments.withColumn("speaker", F.explode(characters)).drop(characters)


def judge_lines(scored: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """Type, subtype, drift and times of lines from their own coverage and hull and their best sibling's. A new tolerance needs no more than this."""
    covered = F.coalesce("own_coverage", F.lit(0.0))
    silent = covered < cfg.missing_coverage
    elsewhere = silent & F.coalesce(F.col("sibling_coverage") >= cfg.mismatch_coverage, F.lit(False))
    kind = F.when(elsewhere, "MISMATCH").when(silent, "MISSING").when(covered < cfg.aligned_coverage, "MISALIGNED").otherwise("OK")
    middle = (F.greatest("start_s", "hull_start_s") + F.least("end_s", "hull_end_s")) / 2 - (F.col("start_s") + F.col("end_s")) / 2
    typed = scored.withColumn("type", kind)
    pick = lambda other, own: F.when(F.col("type") == "MISMATCH", F.col(other)).when(F.col("type") == "MISALIGNED", F.col(own))
    drift = F.when(F.col("type") == "MISALIGNED", middle)
    return typed.withColumns(
        {
            "coverage": F.when(F.col("type") == "MISMATCH", F.col("sibling_coverage")).otherwise(covered),
            "drift_s": drift,
            "subtype": F.when(drift > 0, "late").when(drift.isNotNull(), "early"),
            "delivered_by": F.when(F.col("type") == "MISMATCH", F.col("sibling")),
            "audio_start_s": pick("sibling_start_s", "hull_start_s") - F.col("offset_s"),
            "audio_end_s": pick("sibling_end_s", "hull_end_s") - F.col("offset_s"),
        }
    )


def align(lines: DataFrame, regions: DataFrame, mapping: DataFrame, bin_width: float, cfg: AlignConfig = ALIGN, grouped: DataFrame | None = None) -> dict[str, DataFrame]:
    """findings, extras, offsets, sync warnings, unmapped speakers, and the scored lines that ``judge_lines`` can judge anew.

    ``lines``: key, line, speaker, start_s, end_s and what else findings shall carry, as the text; ``regions``: key, region,
    channel, start_s, end_s; ``mapping``: speaker, channel (several channels of a speaker count together, unmerged);
    ``grouped``: speakers heard in a bundle of small parts. Speakers without a delivered channel have no findings; they are
    unmapped unless grouped. Bundles are nobody's sibling and hold no missing line.
    """
    owned = regions.join(mapping, "channel")
    who = ["key", "speaker"]
    shift = offsets(lines.select(*who, "line", "start_s"), owned.select(*who, "start_s"), who, ["line"], cfg.max_offset_s, cfg.min_anchors)
    delivered = owned.select(*who).distinct()
    mapped = lines.join(mapping.select("speaker").distinct(), "speaker", "left_semi")
    unmapped = lines.select(*who).distinct().join(mapping.select("speaker").distinct(), "speaker", "left_anti")
    if grouped is not None:
        unmapped = unmapped.join(grouped.select("speaker").distinct(), "speaker", "left_anti")
    moved = mapped.join(shift.select(*who, "offset_s"), who, "left").fillna(0.0, ["offset_s"])
    moved = moved.withColumns({"start_s": F.col("start_s") + F.col("offset_s"), "end_s": F.col("end_s") + F.col("offset_s")})
    scored = moved.join(_covered(moved, owned, bin_width), [*who, "line"], "left")
    findings = judge_lines(scored, cfg)
    free = regions.join(mapping.select("channel"), "channel", "left_anti").where(~group_named(F.col("channel")))
    raw = findings.where("type = 'MISSING'").select(*who, "line", (F.col("start_s") - F.col("offset_s")).alias("start_s"), (F.col("end_s") - F.col("offset_s")).alias("end_s"))
    maybe = best_covering(raw, free.select("key", "channel", "start_s", "end_s"), ["key"], ["speaker", "line"], bin_width).where(F.col("coverage") >= cfg.unclaimed_coverage)
    findings = findings.join(maybe.select(*who, "line", F.col("channel").alias("possibly_in")), [*who, "line"], "left")
    long = owned.where(F.col("end_s") - F.col("start_s") >= cfg.min_extra_s)
    extras = uncovered(long.select(*who, "channel", "region", "start_s", "end_s"), moved.select(*who, "start_s", "end_s"), who, ["channel", "region"], bin_width)
    sync = shift.where(F.abs("offset_s") >= cfg.sync_warn_s).withColumn("direction", F.when(F.col("offset_s") > 0, "late").otherwise("early"))
    return {"findings": findings, "extras": extras, "offsets": shift, "sync": sync, "unmapped": unmapped, "delivered": delivered, "scored": scored}


def _covered(lines: DataFrame, owned: DataFrame, bin_width: float) -> DataFrame:
    """Per line and speaker the coverage and hull of the speaker's own channels and of the best other speaker's channel, from one join."""
    pairs = overlap_join(lines.select("key", "line", "speaker", "start_s", "end_s"), owned.select("key", "channel", F.col("speaker").alias("owner"), "start_s", "end_s"), ["key"], bin_width)
    shared = F.sum(F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s"))
    each = pairs.groupBy("key", "speaker", "line", "start_s", "end_s", "r_owner", "r_channel").agg(shared.alias("s"), F.min("r_start_s").alias("h0"), F.max("r_end_s").alias("h1"))
    own, seconds = F.col("r_owner") == F.col("speaker"), F.greatest(F.lit(1e-9), F.col("end_s") - F.col("start_s"))
    best = F.min(F.when(~own & ~group_named(F.col("r_channel")), F.struct((-F.col("s") / seconds).alias("c"), F.col("r_channel").alias("channel"), "h0", "h1")))
    out = each.groupBy("key", "speaker", "line").agg(F.sum(F.when(own, F.col("s") / seconds)).alias("own_coverage"), F.min(F.when(own, F.col("h0"))).alias("hull_start_s"), F.max(F.when(own, F.col("h1"))).alias("hull_end_s"), best.alias("best"))
    return out.withColumns({"sibling": F.col("best.channel"), "sibling_coverage": -F.col("best.c"), "sibling_start_s": F.col("best.h0"), "sibling_end_s": F.col("best.h1")}).drop("best")


def remap(mapping: DataFrame, issues: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapping (key, speaker, channel, mapped_by) and issues after a person's choices (key, speaker, channel; null: no channel).

    A chosen channel leaves whoever had it, a chosen speaker all channels that they had. Issues about the speaker go, and
    those about the channel but for groups that other speakers are in. Aligning anew needs the regions alone.
    """
    chosen, taken = overrides.select("key", "speaker"), overrides.where("channel is not null").select("key", "channel")
    left = mapping.join(chosen, ["key", "speaker"], "left_anti").join(taken, ["key", "channel"], "left_anti").select("key", "speaker", "channel", "mapped_by")
    manual = overrides.where("channel is not null").select("key", "speaker", "channel", F.lit("manual").alias("mapped_by"))
    about = issues.join(chosen, ["key", "speaker"], "left_anti").join(chosen.select("key", F.col("speaker").alias("other")), ["key", "other"], "left_anti")
    tracks = taken.withColumn("_taken", F.lit(True))
    kept = about.join(tracks, ["key", "channel"], "left").where((F.col("kind") == "grouped") | F.col("_taken").isNull()).select(*issues.columns)
    return left.union(manual), kept


def compare_timelines(original: DataFrame, dub: DataFrame, bin_width: float, cfg: AlignConfig = ALIGN) -> dict[str, DataFrame]:
    """Without a script: original spans (key, line, start_s, end_s) against the union of all dub channels."""
    lines = original.where(F.col("end_s") - F.col("start_s") >= cfg.min_line_s)
    union = coalesce_spans(dub, ["key"])
    shift = offsets(lines.select("key", "line", "start_s"), union.select("key", "start_s"), ["key"], ["line"], cfg.max_offset_s, cfg.min_anchors)
    move = lambda df: df.join(shift.select("key", "offset_s"), "key", "left").fillna(0.0, ["offset_s"]).withColumns({"start_s": F.col("start_s") + F.col("offset_s"), "end_s": F.col("end_s") + F.col("offset_s")})
    moved = move(lines)
    own = coverage(moved.select("key", "line", "start_s", "end_s"), union, ["key"], ["line"], bin_width).select("key", "line", F.col("coverage").alias("own_coverage"), "hull_start_s", "hull_end_s")
    nobody = {"sibling": F.lit(None).cast("string")} | {c: F.lit(None).cast("double") for c in ("sibling_coverage", "sibling_start_s", "sibling_end_s")}
    findings = judge_lines(moved.join(own, ["key", "line"], "left").withColumns(nobody), cfg)
    long = dub.where(F.col("end_s") - F.col("start_s") >= cfg.min_extra_s)
    extras = uncovered(long.select("key", "channel", "region", "start_s", "end_s"), move(original).select("key", "start_s", "end_s"), ["key"], ["channel", "region"], bin_width)
    return {"findings": findings, "extras": extras, "offsets": shift}

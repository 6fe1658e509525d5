"""Evidence gates, confidence tiers, song reprises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.config import GATES, GateConfig
from spanweave.functions.texts import content_words, line_key, songlike, split_words
from spanweave.operators.islands import clusters

#: Gate -> why a candidate that it stops counts as unchecked; others are decided.
UNCHECKED = {"long-span": "long", "reference-unreliable": "reference", "dub-unreadable": "reading", "slot-occupied": "occupied", "judge-garble": "garble"}


def gate(cfg: GateConfig = GATES) -> Column:
    """The first gate that stops a candidate, or null.

    Columns: text, start_s, end_s, ref_ok, dub_ok (booleans), slot (covered share), verdict (a judge's, null: none given).
    """
    return (
        F.when(songlike(F.col("text")), "song-like")
        .when(F.col("end_s") - F.col("start_s") > cfg.long_span_s, "long-span")
        .when(~F.coalesce("ref_ok", F.lit(False)), "reference-unreliable")
        .when(~F.coalesce("dub_ok", F.lit(True)), "dub-unreadable")
        .when(F.coalesce("slot", F.lit(0.0)) >= cfg.slot_occupied, "slot-occupied")
        .when(F.col("verdict") == "garble", "judge-garble")
        .when(F.col("verdict") == "present", "judge-present")
    )


def unchecked_breakdown(gated: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates per reason that nothing decided; songs and what the judge saw are decided."""
    reason = F.create_map(*(F.lit(x) for kv in UNCHECKED.items() for x in kv))[F.col("gate")]
    return gated.withColumn("reason", reason).where("reason is not null").groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def tier() -> Column:
    """Confidence of a finding. Columns: text, start_s, end_s, coverage, slot, fill, fragment, song_reprise, block_n, block_first."""
    words, seconds = F.size(split_words(F.coalesce("text", F.lit("")))), F.coalesce(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    fill, slot = F.col("fill"), F.col("slot")
    occupied = F.when(fill.isNotNull(), fill == "speech-like").otherwise(yes(slot >= 0.25))
    hole = F.when(fill.isNotNull(), fill == "silence").otherwise(yes(slot < 0.05))
    quiet = yes(fill == "ambience")
    return (
        F.when(yes(F.col("song_reprise")) | yes(F.col("fragment")) | (words <= 1), "low")
        .when(yes(F.col("block_n") >= 4), F.when(yes(F.col("block_first")), "medium").otherwise("low"))
        .when(occupied, "low")
        .when(hole & (words >= 3) & (seconds >= 0.35) & (F.col("coverage").isNull() | (F.col("coverage") < 0.75)), "high")
        .when(hole, "medium")
        .when(quiet, "low")
        .when(yes(F.col("coverage") < 0.35), "medium")
        .otherwise("low")
    )


def classify_fill(level_db: Column, reference_db: Column, spread_db: Column, seconds: Column, frames: Column, cfg: GateConfig = GATES) -> Column:
    """What fills a slot: silence, ambience or speech-like; null for too short a slot."""
    return F.when((seconds < 0.2) | (frames < 2), None).when(level_db - reference_db <= cfg.fill_silence_db, "silence").when(spread_db < cfg.fill_flat_db, "ambience").otherwise("speech-like")


def song_lines(lines: DataFrame, line_id: str, group: str, least: int = 2) -> DataFrame:
    """Words of lines that at least ``least`` groups (episodes) share, however ordered: a song bank."""
    # exploding keeps the filter from being pushed below and its key from being computed twice
    keyed = lines.select(group, F.explode(F.filter(F.array(line_key(F.col("text"))), lambda x: x.isNotNull())).alias("line")).distinct()
    shared = keyed.groupBy("line").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= least)
    return shared.select(F.explode(F.split("line", " ")).alias("word")).distinct()


def reprises(loose: DataFrame, lyrics: DataFrame, keys: list[str], cfg: GateConfig = GATES) -> DataFrame:
    """Loose lines that repeat a lyric block: enough shared words and share of their own; the first block in order.

    ``loose``: keys, line, text. ``lyrics``: keys, block, words (array). Joined on words, so only lines and
    blocks that share one ever meet.
    """
    own = loose.where((F.size(split_words(F.col("text"))) >= cfg.reprise_words) & (F.length(F.trim("text")) >= 10)).select(*keys, "line", content_words(F.col("text")).alias("words"))
    lines = own.select(*keys, "line", F.size("words").alias("own"), F.explode("words").alias("word"))
    blocks = lyrics.select(*keys, "block", F.explode(F.array_distinct("words")).alias("word"))
    shared = lines.join(blocks, [*keys, "word"]).groupBy(*keys, "line", "own", "block").agg(F.count(F.lit(1)).alias("shared"))
    hit = shared.where((F.col("shared") >= cfg.reprise_words) & (F.col("shared") >= cfg.reprise_share * F.col("own")))
    return hit.groupBy(*keys, "line").agg(F.min("block").alias("block"))


def reprise_neighbourhood(tagged: DataFrame, keys: list[str], cfg: GateConfig = GATES) -> DataFrame:
    """Spans around clusters of tagged lines (at_s), in which further loose lines count as sung."""
    return clusters(tagged, keys, cfg.cluster_gap_s, cfg.cluster_edge_s)


def song_tags(missing: DataFrame, keys: list[str], cfg: GateConfig = GATES, bank: DataFrame | None = None) -> DataFrame:
    """Loose missing lines that are sung: keys, line, source (bank, block or between) and the block whose words come again.

    ``missing``: keys, line, at_s, text, block (null for loose lines). Lines of blocks, and the words of ``bank`` (keys,
    word), are lyrics if they have ``reprise_words`` words or more. A loose line that repeats enough of one is a reprise.
    Two shared words do not make one, but they say that a song is on: reprises and such lines are anchors, and loose
    lines inside a cluster of anchors are sung, too.
    """
    lines = missing.select(*keys, "line", "at_s", "text", "block", content_words(F.coalesce("text", F.lit(""))).alias("words"))
    least = cfg.reprise_words
    # lyrics are numbered by time; the bank comes after them
    lyrics = lines.where(F.col("block").isNotNull()).select(*keys, F.struct(F.lit(0).alias("bank"), "at_s", "line", F.col("block").alias("id")).alias("lyric"), "words")
    if bank is not None:
        none = lambda c: F.lit(None).cast(lines.schema[c].dataType).alias("id" if c == "block" else c)
        lyrics = lyrics.union(bank.groupBy(*keys).agg(F.collect_set("word").alias("words")).select(*keys, F.struct(F.lit(1).alias("bank"), none("at_s"), none("line"), none("block")).alias("lyric"), "words"))
    lyrics = lyrics.where(F.size("words") >= least)
    again = reprises(lines.where("block is null").select(*keys, "line", "text"), lyrics.select(*keys, F.col("lyric").alias("block"), "words"), keys, cfg)
    worded = lines.select(*keys, "line", "at_s", F.explode("words").alias("word")).join(lyrics.select(*keys, "lyric", F.explode("words").alias("word")), [*keys, "word"])
    hints = worded.groupBy(*keys, "line", "at_s", "lyric").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= 2).select(*keys, "line", "at_s").distinct()
    spans = reprise_neighbourhood(hints.where("at_s is not null"), keys, cfg)
    loose = lines.where("block is null and at_s is not null").select(*keys, "line", "at_s").join(again.select(*keys, "line"), [*keys, "line"], "left_anti")
    # clusters of a key lie apart, so a line is in one at most; both sides meet in bins of the cluster's gap
    width = float(cfg.cluster_gap_s)
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_s") / width), F.floor(F.col("end_s") / width))))
    within = loose.withColumn("bin", F.floor(F.col("at_s") / width)).join(binned, [*keys, "bin"]).where((F.col("start_s") <= F.col("at_s")) & (F.col("at_s") <= F.col("end_s")))
    found = again.select(*keys, "line", F.when(F.col("block.bank") == 1, "bank").otherwise("block").alias("source"), F.col("block.id").alias("block"))
    between = within.select(*keys, "line", F.lit("between").alias("source"), F.lit(None).cast(lines.schema["block"].dataType).alias("block")).distinct()
    return found.union(between)

"""Roll-ups of findings: across languages, per character, as markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.names import untagged
from spanweave.functions.texts import songlike, split_words
from spanweave.functions.timecode import smpte

MOSTLY_ABSENT = 0.5


def language_stats(characters: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing and scripted lines per character and language, where any is missing.

    ``characters``: lang, character, lines, channel, grouped_in. ``missing``: lang, character, a row per
    missing line. A character without a track and not grouped misses all its lines.
    """
    n = missing.groupBy("lang", "character").agg(F.count(F.lit(1)).alias("found"))
    absent = F.col("channel").isNull() & F.col("grouped_in").isNull() & (F.col("lines") > 0)
    lost = F.when(absent, F.col("lines")).otherwise(F.coalesce("found", F.lit(0)))
    return characters.join(n, ["lang", "character"], "left").select("lang", "character", lost.alias("missing"), "lines").where("missing > 0")


def root_causes(stats: DataFrame, languages: DataFrame) -> DataFrame:
    """Why a character's lines are missing, from where they are: in all languages, in some fully, a few everywhere, or in some."""
    rate = F.col("missing") / F.col("lines")
    total = languages.count()
    absent = F.count_if(F.coalesce(rate >= MOSTLY_ABSENT, F.lit(False)))
    per = stats.groupBy("character").agg(F.count(F.lit(1)).alias("affected"), absent.alias("absent"), F.count_if(F.coalesce((rate > 0) & (rate < MOSTLY_ABSENT), F.lit(False))).alias("partial"), F.coalesce(F.max(rate), F.lit(0.0)).alias("worst_rate"), F.sum("missing").alias("missing"))
    cause = F.when(F.col("absent") == total, "script").when(F.col("absent") > 0, "delivery").when((F.col("affected") == total) & F.lit(total > 1), "hard-lines").otherwise("dub")
    return per.withColumns({"cause": cause, "delivered": total - F.col("affected")})


def headline(causes: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` of the script's side and of the dub's, worst first, and how many more there are on each."""
    side = F.when(F.col("cause").isin("script", "hard-lines"), "script").otherwise("dub")
    w = Window.partitionBy("side")
    ranked = causes.withColumn("side", side).withColumns({"rank": F.row_number().over(w.orderBy(F.col("affected").desc(), F.col("worst_rate").desc(), "character")), "more": F.greatest(F.count(F.lit(1)).over(w) - n, F.lit(0))})
    return ranked.where(F.col("rank") <= n).select("side", "rank", "character", "cause", "affected", "more")


def counts(findings: DataFrame, keys: list[str], column: str, values: tuple[str, ...]) -> DataFrame:
    """Findings per key and value, a column each."""
    return findings.groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v.lower().replace('-', '_')}") for v in values))


def verdict(missing: Column, undelivered: Column) -> Column:
    return F.when(undelivered > 0, "red").when(missing > 0, "orange").otherwise("green")


def marker_rows(findings: DataFrame, keys: list[str], fps: int = 25) -> DataFrame:
    """Markers for an editor: missing lines that are neither sung nor a reprise, numbered in time order.

    ``findings``: keys, line, start_s, type, tier, sung, song_reprise, speaker.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kept = findings.where((F.col("type") == "MISSING") & ~yes("sung") & ~yes("song_reprise"))
    colour = F.when(F.col("tier") == "high", "red").when(F.col("tier") == "medium", "orange").otherwise("yellow")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "line"))
    return kept.select(*keys, number.alias("no"), smpte(F.col("start_s"), fps).alias("at"), colour.alias("colour"), F.concat(F.lit("MISSING "), F.col("speaker")).alias("name"), "line")


def verify_order(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Position in which to check: whole lines before fragments, sure ones first, in time order; one row per block."""
    tier = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    one = findings.where(F.col("block_id").isNull() | F.col("block_first"))
    return one.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("fragment", F.lit(False)), tier, "start_s", "line")))


def recall_of_truth(truth: DataFrame, findings: DataFrame, keys: list[str], tolerance: float, bin_width: float = 600.0) -> DataFrame:
    """Per truth span whether a finding overlaps it within the tolerance, ends included."""
    spread = lambda df, more: df.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start_s") - more) / bin_width), F.floor((F.col("end_s") + more) / bin_width))))
    other = spread(findings.select(*keys, "start_s", "end_s"), tolerance).select(*keys, "bin", F.col("start_s").alias("f_start"), F.col("end_s").alias("f_end"))
    near = ~((F.col("f_end") + tolerance < F.col("start_s")) | (F.col("end_s") + tolerance < F.col("f_start")))
    hit = spread(truth, 0.0).join(other, [*keys, "bin"]).where(near).select(*keys, "truth").distinct().withColumn("found", F.lit(True))
    return truth.join(hit, [*keys, "truth"], "left").fillna(False, ["found"])


def run_status(parts: DataFrame) -> DataFrame:
    """The parts of each run in the order in which they are told, with the run's tally and header.

    ``parts``: run, lang, state (done, failed, running, skipped), missing, high (whether a finding is of high confidence).
    Failures come first, then what is done, most missing first, then what runs, then what was not delivered. A run is
    running while any part is, else failed if any part is; it is settled once nothing runs.
    """
    state, missing = F.col("state"), F.coalesce("missing", F.lit(0))
    rank = F.when(state == "failed", 0).when(state == "done", 1).when(state == "running", 2).otherwise(3)
    sign = F.when(state == "failed", "broken").when(state == "running", "waiting").when(state != "done", "absent").when(missing == 0, "green").when(F.coalesce("high", F.lit(False)), "orange").otherwise("yellow")
    tally = parts.groupBy("run").agg(*(F.count_if(state == s).alias(s) for s in ("done", "failed", "running", "skipped")))
    header = F.when(F.col("running") > 0, "running").when(F.col("failed") > 0, "failed").when(F.col("done") > 0, "done").otherwise("nothing")
    order = Window.partitionBy("run").orderBy(rank, F.when(state == "done", missing).otherwise(0).desc(), "lang")
    return parts.join(tally, "run").withColumns({"sign": sign, "position": F.row_number().over(order), "header": header, "settled": F.col("running") == 0})


def entities(segments: DataFrame) -> DataFrame:
    """A row per speaker (key) of segments (key, label, start_s, end_s, ord): labels, lines, seconds, first start and display name.

    The name is the most frequent label without tags that names one speaker, of equals the one seen first, else the key in title case.
    """
    clean = F.trim(untagged(F.col("label")))
    named = segments.select("key", clean.alias("name"), "ord").where("name <> '' and not contains(name, '/')").groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    name = named.groupBy("key").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("name"))
    seconds = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    rolled = segments.groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("aliases"), F.count(F.lit(1)).alias("line_count"), F.round(F.sum(seconds), 2).alias("total_s"), F.round(F.min("start_s"), 3).alias("first_s"))
    return rolled.join(name, "key", "left").withColumn("name", F.coalesce("name", F.initcap(F.replace("key", F.lit("_"), F.lit(" ")))))


def find(findings: DataFrame, language: str | None = None, kind: str | None = None, character: str | None = None, limit: int = 25) -> DataFrame:
    """The first findings by language and time (lang, type, character, start_s, line) of a language, a type, and characters whose name holds a text: a top-k report."""
    kept = findings
    if language:
        kept = kept.where(F.lower("lang") == language.lower())
    if kind:
        kept = kept.where(F.col("type") == kind.strip().upper())
    if character:
        kept = kept.where(F.lower("character").contains(character.strip().lower()))
    return kept.orderBy("lang", "start_s", "line").limit(limit)


def finding_order(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with position: missing, mismatched, misaligned, extra, others, each by the script's time, else the audio's."""
    rank = F.coalesce(*(F.when(F.col("type") == t, k) for k, t in enumerate(("MISSING", "MISMATCH", "MISALIGNED", "EXTRA"))), F.lit(4))
    order = Window.partitionBy(*keys).orderBy(rank, F.coalesce("script_start_s", "audio_start_s", F.lit(0.0)), "line")
    return findings.withColumn("position", F.row_number().over(order))


def worst_first(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Languages (lang, no_audio, missing, mismatch) with position: most undelivered characters first, then most missing, then most mismatched lines."""
    order = [F.coalesce(c, F.lit(0)).desc() for c in ("no_audio", "missing", "mismatch")]
    return summaries.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "lang")))


def _firsts(condition: Column, value: Column, order: Column, n: int) -> Column:
    """The first ``n`` values of a group, by order; its task holds the group's values once more."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.when(condition, F.struct(order.alias("o"), value.alias("v"))))), 1, n), lambda x: x["v"])


def overview(findings: DataFrame, characters: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """Per key findings by type, characters, tracks, and who has lines but neither a track nor a bundle.

    ``characters``: keys, character, lines, channel, grouped_in; ``channels``: keys, channel.
    """
    undelivered = F.col("channel").isNull() & F.col("grouped_in").isNull() & (F.col("lines") > 0)
    who = characters.groupBy(*keys).agg(F.count(F.lit(1)).alias("characters"), F.sort_array(F.collect_list(F.when(undelivered, F.col("character")))).alias("no_audio"))
    n = findings.groupBy(*keys).agg(*(F.count_if(F.col("type") == t).alias(c) for c, t in {"missing": "MISSING", "wrong_speaker": "MISMATCH", "misaligned": "MISALIGNED", "extra": "EXTRA"}.items()))
    tracks = channels.groupBy(*keys).agg(F.count_distinct("channel").alias("tracks"))
    return who.join(tracks, keys, "left").join(n, keys, "left").fillna(0)


def delivery_health(characters: DataFrame, channels: DataFrame, issues: DataFrame, keys: list[str], first: int = 4) -> DataFrame:
    """Per key tracks, how many are mapped and which are not (the first few), characters without a track, and repairs by kind.

    ``characters``: keys, character, lines, channel, grouped_in; ``channels``: keys, channel; ``issues``: keys, kind.
    """
    owned = characters.where("channel is not null").select(*keys, "channel").distinct().withColumn("_owned", F.lit(True))
    free = F.col("_owned").isNull()
    tracks = channels.select(*keys, "channel").distinct().join(owned, [*keys, "channel"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("tracks"), F.count_if(free).alias("unclaimed"), _firsts(free, F.col("channel"), F.col("channel"), first).alias("unclaimed_first"))
    absent = F.col("channel").isNull() & F.col("grouped_in").isNull() & (F.col("lines") > 0)
    who = characters.groupBy(*keys).agg(F.count_if(absent).alias("no_track"), F.count_distinct("channel").alias("mapped"))
    kinds = {"twins": "twin_merged", "swaps": "swap_repaired", "reassigned": "reassigned", "ambiguous": "ambiguous_name"}
    repairs = issues.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()))
    return tracks.join(who, keys, "left").join(repairs, keys, "left").fillna(0)


def digest(stats: DataFrame, findings: DataFrame, n: int = 4, examples: int = 6) -> DataFrame:
    """Per language missing lines, undelivered characters, the characters that miss most (the first few) and examples of missing lines.

    ``stats``: lang, character, missing, lines; ``findings``: lang, line, start_s of missing lines.
    """
    gone = F.col("missing") == F.col("lines")
    by = stats.groupBy("lang").agg(F.sum("missing").alias("missing"), F.count_if(gone).alias("no_audio"), _firsts(gone, F.col("character"), F.col("character"), n).alias("undelivered"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("missing")).alias("m"), "character"))), 1, n), lambda x: x["character"]).alias("top_missing"))
    # examples are ranked before they are collected, so only a few rows of a language meet
    few = findings.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("start_s", "line"))).where(F.col("_r") <= examples)
    shown = few.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"]).alias("examples"))
    return by.join(shown, "lang", "left").withColumn("undelivered_more", F.greatest(F.col("no_audio") - n, F.lit(0)))


def retimed(pairs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Lines present elsewhere than expected: of each line's pairs (line, start_s, other_start_s, sim) the best, of equals the first, if it is further off than the tolerance."""
    best = pairs.groupBy(*keys, "line", "start_s").agg(F.max(F.struct("sim", (-F.col("other_start_s")).alias("o"))).alias("b"))
    drift = -F.col("b.o") - F.col("start_s")
    return best.where(F.abs(drift) > tolerance).select(*keys, "line", F.round(drift, 2).alias("drift_s"), F.when(drift > 0, "late").otherwise("early").alias("direction"), F.round("b.sim", 3).alias("coverage"))


def admitted_extras(extras: DataFrame) -> DataFrame:
    """Extra lines (text, reliable; null: not known) that count: read reliably, not song-like, of two words or more."""
    text = F.col("text")
    return extras.where(F.coalesce("reliable", F.lit(True)) & (text.isNull() | (~songlike(text) & (F.size(split_words(text)) >= 2))))


def tier_evaluation(flags: DataFrame) -> DataFrame:
    """Per tier of flags (tier, fill, start, end): how many, their share, the share in silence and the upper median duration."""
    order = Window.partitionBy("tier").orderBy("seconds")
    timed = flags.withColumn("seconds", F.coalesce(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), F.lit(0.0)))
    ranked = timed.withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy("tier"))})
    out = ranked.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("fill", F.lit("")) == "silence").cast("double")).alias("silence_share"), F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("seconds"))).alias("median_s"))
    return out.join(flags.agg(F.count(F.lit(1)).alias("_all"))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def high_load(flags: DataFrame) -> DataFrame:
    """How many high flags (episode, tier) an episode has: least, upper median and most, episodes without any included."""
    each = flags.groupBy("episode").agg(F.count_if(F.col("tier") == "high").alias("high"))
    ranked = each.withColumns({"_k": F.row_number().over(Window.orderBy("high")), "_n": F.count(F.lit(1)).over(Window.partitionBy())})  # a row per episode
    return ranked.agg(F.min("high").alias("least"), F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("high"))).alias("median"), F.max("high").alias("most"))


def totals(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings as a person counts them: blocks once, reprises and fragments not. Columns: block_id, song_reprise, fragment, tier."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    blocks = F.count_distinct("block_id")
    grouped, reprise, fragment = F.count("block_id"), F.count_if(yes("song_reprise")), F.count_if(yes("fragment"))
    n = F.count(F.lit(1))
    return findings.groupBy(*keys).agg(n.alias("missing"), blocks.alias("blocks"), F.greatest(blocks, n - grouped - reprise - fragment + blocks).alias("findings"))


def actionable(findings: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to act on without sung lines and reprises: per tier (none counts as low), loose lines and blocks."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kept = findings.where(~yes("sung") & ~yes("song_reprise")).withColumn("tier", F.coalesce("tier", F.lit("low")))
    return kept.groupBy(*keys).agg(*(F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("high", "medium", "low")), (F.count_if(F.col("block_id").isNull()) + F.count_distinct("block_id")).alias("findings"))


def by_language(stats: DataFrame, languages: list[str]) -> DataFrame:
    """Missing lines of each character, a column per language."""
    return stats.groupBy("character").pivot("lang", languages).agg(F.sum("missing")).na.fill(0)


def voice_check(entry: Column, voice: Column, voice_id: Column, language: Column, uses: Column, score: Column, exact: float = 0.98, weak: float = 0.86) -> Column:
    """What is wrong with a character's voice, the first that applies."""
    return (
        F.when(entry.isNull(), "not in list")
        .when(voice.isNull(), "-")
        .when(voice_id.isNull(), "no voice id")
        .when(language.isNull(), "no language id")
        .when(uses > 1, "duplicate id")
        .when((score < exact) & (score >= weak), "verify match")
        .otherwise("ok")
    )


def first_hint(text: Column, hints: list[tuple[str, str]]) -> Column:
    """The hint of the first needle that the text holds, in the order given."""
    out = F.lit(None).cast("string")
    for needle, hint in reversed(hints):
        out = F.when(F.contains(F.lower(text), F.lit(needle.lower())), hint).otherwise(out)
    return out


def on_screen(findings: DataFrame, least_extra_s: float = 1.5) -> DataFrame:
    """Findings as a text report lists them: extra speech from ``least_extra_s`` seconds on, all else."""
    long = F.col("audio_end_s") - F.col("audio_start_s") >= least_extra_s
    return findings.where((F.col("type") != "EXTRA") | F.coalesce(long, F.lit(False)))


def write_report(report: DataFrame, path: str) -> None:
    """A table of findings as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_markers(rows: DataFrame, path: str) -> None:
    """Marker rows as CSV with a header, in time order; quotes inside cells are doubled."""
    rows.orderBy("no").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

"""Repair of a name-based mapping of characters to channels by whose lines the channels carry.

The passes run in a fixed order, each relational steps over one state per episode: ``mapping``
(episode, speaker, channel) and ``issues``. Where one step of a pass changes what the next one finds, they are taken in
the order of the mapping. Scores are those of ``intervals.pair_scores``, rounded to
three places before any threshold. Ties go to the order columns speaker_ord and channel_ord.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.config import MAPPING, MappingConfig
from spanweave.functions.names import squash, tokens
from spanweave.operators.grouped import column, map_groups
from spanweave.session import cut_lineage

# Words that name tracks of many small parts.
GROUP_TOKENS = (
    "ambience", "ambient", "background", "bg", "bit", "bits", "chatter", "crowd", "crowds", "ensemble",
    "gang", "gangs", "group", "groups", "grp", "guests", "kids", "mob", "mobs", "passengers", "patrons",
    "reactions", "students", "villager", "villagers", "vox", "walla", "wallas",
)
GROUP_PARTS = ("ambience", "chatter", "crowd", "ensemble", "walla")
ISSUE = "kind string, key long, speaker string, channel string, other string, precision double, recall double"


def group_named(channel: Column) -> Column:
    """Whether a track is named like a bundle of small parts."""
    return F.arrays_overlap(tokens(channel), F.array(*map(F.lit, GROUP_TOKENS))) | squash(channel).rlike("|".join(GROUP_PARTS))


def _issue(df: DataFrame, kind: str, speaker: str, channel: str, other: Column | None = None, precision: str | None = None, recall: str | None = None) -> DataFrame:
    nothing = F.lit(None)
    return df.select(F.lit(kind).alias("kind"), "key", F.col(speaker).alias("speaker"), F.col(channel).alias("channel"), (nothing.cast("string") if other is None else other).alias("other"), (F.col(precision) if precision else nothing.cast("double")).alias("precision"), (F.col(recall) if recall else nothing.cast("double")).alias("recall"))


def repair(named: DataFrame, scores: DataFrame, speakers: DataFrame, cfg: MappingConfig = MAPPING) -> tuple[DataFrame, DataFrame]:
    """Mapping (key, speaker, channel, mapped_by) and issues.

    ``named``: key, speaker, channel by name. ``scores``: key, speaker, channel, precision, recall,
    name_score, for all pairs of a key, with speaker_ord and channel_ord. ``speakers``: key, speaker,
    lines, line_s.
    """
    s = scores.withColumns({"precision": F.round("precision", 3), "recall": F.round("recall", 3), "group": group_named(F.col("channel"))}).join(speakers, ["key", "speaker"])
    by_channel = Window.partitionBy("key", "channel").orderBy(F.col("precision").desc(), "speaker_ord")
    owner = s.withColumns({"r": F.row_number().over(by_channel), "top": F.max("precision").over(Window.partitionBy("key", "channel"))}).where("r = 1")
    owner = owner.select("key", "channel", F.col("speaker").alias("owner"), F.col("precision").alias("owner_precision"), F.col("recall").alias("owner_recall"), F.col("lines").alias("owner_lines"), (F.col("group") & (F.col("top") < cfg.owner_precision)).alias("bundle"))
    s = cut_lineage(s.join(owner, ["key", "channel"]))
    scored = s.drop("owner", "owner_precision", "owner_recall", "owner_lines")
    # 1. bundles are nobody's own track
    held = named.join(s, ["key", "speaker", "channel"]).where("not bundle")
    # 2. a track whose voice is clearly that of a speaker without one goes to them
    mapping, claim = _reassign(held, cfg)
    issues = _issue(claim, "reassigned", "owner", "channel", F.col("speaker"), "owner_precision", "owner_recall")
    # 3. two tracks whose voices are each other's change places
    mapping, swap = _swap(mapping, scored, cfg)
    issues = issues.union(_issue(swap, "swap_repaired", "speaker_a", "channel_b", F.col("speaker_b"), "a_on_b"))
    # 4. speakers without a track get the free one that covers them best, if it is mostly theirs
    free = s.where("not bundle").join(mapping.select("key", "channel"), ["key", "channel"], "left_anti").join(mapping.select("key", "speaker"), ["key", "speaker"], "left_anti")
    columns = free.select("key", "speaker", "speaker_ord", "channel", "channel_ord", "precision", "recall")
    found = map_groups(columns.where("recall > 0"), ["key"], ["speaker_ord", "channel_ord"], lambda table, starts: _rescues(table, starts, cfg), "key long, speaker string, channel string, precision double, recall double, strong boolean")
    found = cut_lineage(found)
    rescued, possible = found.where("strong"), found.where("not strong")
    issues = issues.union(_issue(rescued, "rescued", "speaker", "channel", None, "precision", "recall")).union(_issue(possible, "possible_match", "speaker", "channel", None, "precision", "recall"))
    mapping = mapping.union(rescued.select("key", "speaker", "channel", F.lit("content")))
    beats = lambda x, own: (F.col(x) >= cfg.flag_precision) & (F.col(x) - F.col(own) >= cfg.margin)
    # 5. small parts inside a bundle count as delivered
    idle = s.join(mapping.select("key", "speaker"), ["key", "speaker"], "left_anti")
    small = idle.where(F.col("bundle") & (F.col("lines") <= cfg.bit_lines) & (F.col("line_s") <= cfg.bit_seconds) & (F.col("recall") >= cfg.group_recall)).join(possible.select("key", "speaker"), ["key", "speaker"], "left_anti")
    grouped = small.withColumn("r", F.row_number().over(Window.partitionBy("key", "speaker").orderBy(F.col("recall").desc(), "channel_ord"))).where("r = 1")
    issues = issues.union(_issue(grouped, "grouped", "speaker", "channel", None, "precision", "recall"))
    # 6. names that still hold, though the voice says otherwise
    kept = mapping.join(named, ["key", "speaker", "channel"], "left_semi").join(s, ["key", "speaker", "channel"])
    flagged = kept.where((F.col("owner") != F.col("speaker")) & beats("owner_precision", "precision"))
    issues = issues.union(_issue(flagged, "name_mismatch", "speaker", "channel", F.col("owner"), "precision"))
    # 7. unclaimed tracks that are a second one of a mapped speaker, by name or by name and voice
    orphan = s.where("not bundle").join(mapping.select("key", "channel"), ["key", "channel"], "left_anti")
    owned = orphan.join(mapping.select("key", "speaker"), ["key", "speaker"], "left_semi")
    top = lambda c: F.row_number().over(Window.partitionBy("key", "channel").orderBy(F.col(c).desc(), "speaker_ord"))
    by_name = owned.withColumn("r", top("name_score")).where((F.col("r") == 1) & (F.col("name_score") >= cfg.twin_name))
    by_voice = owned.withColumn("r", top("precision")).where((F.col("r") == 1) & (F.col("name_score") >= cfg.twin_fuzzy) & (F.col("precision") >= cfg.twin_precision) & (F.col("recall") >= cfg.twin_recall)).join(by_name.select("key", "channel"), ["key", "channel"], "left_anti")
    twins = by_name.unionByName(by_voice).drop("r")
    rival = orphan.select("key", "channel", F.col("speaker").alias("rival"), F.col("precision").alias("rival_precision"))
    veto = twins.join(rival, ["key", "channel"]).where((F.col("rival") != F.col("speaker")) & beats("rival_precision", "precision"))
    twins = twins.join(veto.select("key", "channel").distinct(), ["key", "channel"], "left_anti")
    issues = issues.union(_issue(twins, "twin_merged", "speaker", "channel", None, "precision"))
    # 8. file names with several speakers
    long_words = lambda c: F.filter(tokens(F.col(c)), lambda t: F.length(t) >= 4)
    names = s.where(F.arrays_overlap(long_words("speaker"), tokens(F.col("channel"))) | F.array_contains(tokens(F.col("channel")), F.col("speaker"))).groupBy("key", "channel").agg(F.count_distinct("speaker").alias("named"))
    worded = F.size(F.filter(F.split("channel", "_+"), lambda x: x.rlike("[A-Za-z]{3,}")))
    lint = s.select("key", "channel").distinct().join(names, ["key", "channel"], "left").where((F.coalesce("named", F.lit(0)) >= 2) | (worded >= 3)).withColumn("speaker", F.lit(None).cast("string"))
    issues = issues.union(_issue(lint, "ambiguous_name", "speaker", "channel"))
    # 9. speakers that no track carries
    absent = idle.join(grouped.select("key", "speaker"), ["key", "speaker"], "left_anti").groupBy("key", "speaker").agg(F.max("recall").alias("recall")).where(F.col("recall") < cfg.absent_recall).withColumn("channel", F.lit(None).cast("string"))
    issues = issues.union(_issue(absent, "verified_absent", "speaker", "channel", None, None, "recall"))
    return mapping.withColumnRenamed("by", "mapped_by"), issues


def _reassign(held: DataFrame, cfg: MappingConfig) -> tuple[DataFrame, DataFrame]:
    """The mapping (key, speaker, channel, by, turn, place) after tracks went to their owners, and the claims that were met.

    One after another, in the order of holders, an owner who has no track then takes theirs, and the holder has none from
    then on; ``turn`` and ``place`` keep that order, those who took a track after the others. What may happen is known
    beforehand, so each round settles every claim whose holder and owner no earlier open claim is about.
    """
    claims = held.where((F.col("owner") != F.col("speaker")) & (F.col("owner_precision") >= cfg.strong_precision) & (F.col("owner_recall") >= cfg.rescue_recall) & (F.col("owner_precision") - F.col("precision") >= cfg.margin) & (F.col("owner_lines") >= F.col("lines")))
    claims = cut_lineage(claims.select("key", "speaker", "channel", "owner", "owner_precision", "owner_recall", "speaker_ord"))
    mapped, met = held.select("key", "speaker"), claims.limit(0)
    open_claims = claims
    while not open_claims.isEmpty():
        about = open_claims.select("key", F.explode(F.array("speaker", "owner")).alias("who"), "speaker_ord").groupBy("key", "who").agg(F.min("speaker_ord").alias("first"))
        first = lambda c, about=about: about.select("key", F.col("who").alias(c), F.col("first").alias(f"{c}_first"))
        ready = open_claims.join(first("speaker"), ["key", "speaker"]).join(first("owner"), ["key", "owner"]).where((F.col("speaker_first") == F.col("speaker_ord")) & (F.col("owner_first") == F.col("speaker_ord"))).select(claims.columns)
        taken = mapped.select("key", F.col("speaker").alias("owner")).distinct()
        now = cut_lineage(ready.join(taken, ["key", "owner"], "left_anti").select(claims.columns))
        left = open_claims.join(ready.select("key", "speaker"), ["key", "speaker"], "left_anti").select(claims.columns)
        met, open_claims = met.union(now), cut_lineage(left)
        mapped = mapped.join(now.select("key", "speaker"), ["key", "speaker"], "left_anti").union(now.select("key", "owner"))
    kept = held.join(met.select("key", "channel"), ["key", "channel"], "left_anti").select("key", "speaker", "channel", F.lit("name").alias("by"), F.lit(0).alias("turn"), F.col("speaker_ord").alias("place"))
    return kept.union(met.select("key", "owner", "channel", F.lit("content"), F.lit(1), "speaker_ord")), met


def _swap(mapping: DataFrame, scores: DataFrame, cfg: MappingConfig) -> tuple[DataFrame, DataFrame]:
    """The mapping (key, speaker, channel, by) after swaps, and these.

    Pairs of speakers are gone through in the order of the mapping, and a swap changes what later pairs hold. So each round
    makes the first swap of every key that comes after its last one; there are as many rounds as a key has swaps, and one.
    Pairs come from voices that are strong on another's track, not from all pairs.
    """
    strong = scores.where(F.col("precision") >= cfg.flag_precision).select("key", "speaker", "channel", F.col("precision").alias("heard"))
    own = scores.select("key", "speaker", "channel", "precision")
    columns = ["key", "speaker_a", "channel_a", "speaker_b", "channel_b", "a_on_b", "pair"]
    state, swaps, last = cut_lineage(mapping), None, None
    while True:
        held = state.join(own, ["key", "speaker", "channel"]).withColumn("at", F.struct("turn", "place"))
        side = lambda x, held=held: held.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("speaker", "channel", "precision", "at")))
        hears = lambda who, where: strong.select("key", F.col("speaker").alias(f"speaker_{who}"), F.col("channel").alias(f"channel_{where}"), F.col("heard").alias(f"{who}_on_{where}"))
        pairs = hears("a", "b").join(side("b"), ["key", "channel_b"]).join(side("a"), ["key", "speaker_a"]).where("at_a < at_b").join(hears("b", "a"), ["key", "speaker_b", "channel_a"])
        pairs = pairs.where((F.col("a_on_b") - F.col("precision_b") >= cfg.margin) & (F.col("b_on_a") - F.col("precision_a") >= cfg.margin)).withColumn("pair", F.struct(F.col("at_a").alias("a"), F.col("at_b").alias("b"))).select(columns)
        if last is not None:
            pairs = pairs.join(last, "key", "left").where(F.col("last").isNull() | (F.col("pair") > F.col("last"))).select(columns)
        first = pairs.groupBy("key").agg(F.min_by(F.struct(*columns[1:]), "pair").alias("x")).select("key", "x.*")
        first = cut_lineage(first)
        if first.isEmpty():
            break
        swaps = first if swaps is None else swaps.union(first)
        now = first.select("key", F.col("pair").alias("last"))
        last = now if last is None else last.join(now.select("key"), "key", "left_anti").union(now)
        moved = first.select("key", F.col("speaker_a").alias("speaker"), F.col("channel_b").alias("to")).union(first.select("key", "speaker_b", "channel_a"))
        state = cut_lineage(state.join(moved, ["key", "speaker"], "left").select("key", "speaker", F.coalesce("to", "channel").alias("channel"), F.when(F.col("to").isNotNull(), "content").otherwise(F.col("by")).alias("by"), "turn", "place"))
    return state.select("key", "speaker", "channel", "by"), (swaps if swaps is not None else first).select(columns[:-1])


def _rescues(table: pa.Table, starts: np.ndarray, cfg: MappingConfig) -> pa.RecordBatch:
    """Speakers of each key by their best free recall, each to the best track still free; only strong matches take it. Rows are sorted by speaker and channel."""
    key, speaker, channel = (table[c].to_pylist() for c in ("key", "speaker", "channel"))
    recall, precision = column(table, "recall"), column(table, "precision")
    rows = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
        offers: dict[str, list[int]] = {}
        for i in range(a, b):
            offers.setdefault(speaker[i], []).append(i)
        taken = set()
        # sorting keeps the order of speakers, and of tracks, among equals
        for mine in sorted(offers.values(), key=lambda rs: -max(recall[rs])):
            left = [i for i in mine if channel[i] not in taken]
            best = max(left, key=lambda i: (recall[i], -i), default=None)
            if best is not None and recall[best] >= cfg.rescue_recall and precision[best] >= cfg.rescue_precision:
                strong = bool(precision[best] >= cfg.strong_precision)
                rows.append((key[best], speaker[best], channel[best], float(precision[best]), float(recall[best]), strong))
                taken |= {channel[best]} if strong else set()
    names = ("key", "speaker", "channel", "precision", "recall", "strong")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

"""Inventories of files: trees, tracks, assets, series, stored results."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanweave.functions.names import common_prefix, cut_prefix, squash, voice_languages
from spanweave.functions.timecode import samples

AUDIO = r"(?i)\.(wav|flac|mp3|m4a|aif|aiff|ogg)$"
# Languages in the order they are looked for, and how names spell them.
LANGUAGES = {
    "Malayalam": ("malayalam", "mala", "mal"), "Tamil": ("tamil", "tam"), "Telugu": ("telugu", "tel"), "Kannada": ("kannada", "kann", "kan"),
    "Bengali": ("bengali", "bengoli", "beng", "bng", "ben"), "Marathi": ("marathi", "mar"), "Hindi": ("hindi", "hin"),
}


def scan_tree(nodes: DataFrame, root: Column, max_depth: int = 3) -> DataFrame:
    """Leaves below the roots with their depth and path; ``nodes``: id, parent, name, folder. One join per level."""
    level = nodes.where(root).select("id", "folder", F.lit(0).alias("depth"), F.col("name").alias("path"))
    found = level
    children = nodes.select(F.col("id").alias("child"), F.col("parent").alias("id"), F.col("name").alias("child_name"), F.col("folder").alias("child_folder"))
    for depth in range(1, max_depth + 1):
        level = level.where("folder").select("id", "path").join(children, "id").select(F.col("child").alias("id"), F.col("child_folder").alias("folder"), F.lit(depth).alias("depth"), F.concat_ws("/", "path", "child_name").alias("path"))
        found = found.unionByName(level)
    return found.where("not folder").drop("folder")


def tracks(files: DataFrame, keys: list[str]) -> DataFrame:
    """Audio files as channels: the name without the folder's common prefix; of equal names the last path. Adds channel_ord."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    audio = files.where(F.col("name").rlike(AUDIO)).withColumn("stem", stem)
    prefix = audio.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 1, cut_prefix(common_prefix(F.min("stem"), F.max("stem")))).otherwise("").alias("prefix"))
    named = audio.join(prefix, keys).withColumn("channel", F.expr("substring(stem, length(prefix) + 1)"))
    last = F.row_number().over(Window.partitionBy(*keys, "channel").orderBy(F.col("path").desc()))
    kept = named.withColumn("r", last).where("r = 1")
    return kept.select(*keys, "channel", "path", F.row_number().over(Window.partitionBy(*keys).orderBy("channel")).alias("channel_ord"))


# Extensions of scripts and audio, words in the names of track folders, and languages there as whole words.
SCRIPT_ENDS, AUDIO_ENDS = ("csv", "doc", "docx", "pdf", "srt", "txt", "xlsx"), ("aif", "aiff", "flac", "m4a", "mp3", "ogg", "wav")
TRACK_FOLDERS = ("dub", "for ai", "speaker", "stems", "track", "vo", "voiceover")
FOLDER_LANGUAGES = ("ben", "bengali", "hin", "hindi", "kan", "kannada", "mal", "malayalam", "mar", "marathi", "punjabi", "tam", "tamil", "tel", "telugu")


def classify(name: Column, folder: Column) -> Column:
    """script, original, track or other. Scripts and audio go by extension; audio is a track in a folder of tracks or a
    language, whatever its own name says, and an original elsewhere."""
    low, at = F.lower(name), F.lower(F.coalesce(folder, F.lit("")))
    ext = F.regexp_extract(low, r"[^.].*?\.([^.]*)$", 1)
    tracks = reduce(or_, (F.contains(at, F.lit(w)) for w in TRACK_FOLDERS)) | at.rlike(rf"\b(?:{'|'.join(FOLDER_LANGUAGES)})\b")
    return F.when(ext.isin(*SCRIPT_ENDS), "script").when(ext.isin(*AUDIO_ENDS), F.when(tracks, "track").otherwise("original")).otherwise("other")


def language_of(name: Column) -> Column:
    """The first listed language that the name spells out or shortens, letters' bounds around."""
    return F.coalesce(*(F.when(F.lower(name).rlike(f"(?<![a-z])(?:{'|'.join(spelled)})(?![a-z])"), language) for language, spelled in LANGUAGES.items()))


def descend(nodes: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """start and id of the folder that holds a folder's tracks: down through folders without audio that have exactly one folder in them.

    ``nodes``: id, parent, name, folder; ``start``: id. One join per level.
    """
    inside = nodes.groupBy(F.col("parent").alias("id")).agg(F.bool_or(~F.col("folder") & F.col("name").rlike(AUDIO)).alias("_audio"), F.count_if("folder").alias("_folders"), F.max(F.when(F.col("folder"), F.col("id"))).alias("_only"))
    at = start.select(F.col("id").alias("start"), "id")
    for _ in range(max_depth):
        at = at.join(inside, "id", "left").select("start", F.when(~F.col("_audio") & (F.col("_folders") == 1), F.col("_only")).otherwise(F.col("id")).alias("id"))
    return at


def owner_of(folders: DataFrame, registry: DataFrame) -> DataFrame:
    """folder and the first entry (by ord) whose folders, an array, hold it; null for nobody's. Configuration is exploded, so ids join."""
    owned = registry.select("entry", "ord", F.explode("folders").alias("folder")).groupBy("folder").agg(F.min_by("entry", "ord").alias("entry"))
    return folders.select("folder").join(owned, "folder", "left")


def newest_revision(files: DataFrame, keys: list[str], stages: tuple[str, ...]) -> DataFrame:
    """The file (name) of each key at the first stage, in the order given, that has one; of several the last by name, as revisions sort. ``mix`` and ``stmix`` are any mix but a premix."""
    plain = squash(F.col("name"))
    at = lambda stage: plain.contains("mix") & ~plain.contains("premix") if stage in ("mix", "stmix") else plain.contains(stage)
    rank = F.coalesce(*(F.when(at(stage), k) for k, stage in enumerate(stages)))
    name = F.coalesce(*(F.when(F.col("_stage") == k, stage) for k, stage in enumerate(stages)))
    return pick(files.withColumn("_stage", rank).where("_stage is not null"), keys, [F.col("_stage"), F.col("name").desc()]).withColumn("stage", name).drop("_stage")


def pick(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The candidate of each key that comes first: shortest name, preferred stage, newest revision, as ordered."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def readiness(files: DataFrame, keys: list[str], least_tracks: int = 2) -> DataFrame:
    """Whether a key has a script, an original and a folder with enough tracks; ``files``: keys, kind, folder."""
    folders = files.groupBy(*keys, "folder").agg(F.count_if(F.col("kind") == "track").alias("tracks"), F.bool_or(F.col("kind") == "script").alias("script"), F.bool_or(F.col("kind") == "original").alias("original"))
    out = folders.groupBy(*keys).agg(F.bool_or("script").alias("script"), F.bool_or("original").alias("original"), F.count_if(F.col("tracks") >= least_tracks).alias("folders"))
    return out.withColumn("ready", F.col("script") & F.col("original") & (F.col("folders") >= 1))


def resolve(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests (request) to registry entries (entry, ord, key, aliases): by key, else by name, else one inside the other from three characters on.

    The exact steps are equi-joins; only what they leave is compared with the registry, which is configuration.
    """
    req = requests.select("request", squash(F.col("request")).alias("q")).distinct()
    names = registry.select("entry", "ord", "key", F.explode(F.concat(F.array("key"), "aliases")).alias("name")).withColumns({"n": squash(F.col("name")), "step": F.when(F.col("name") == F.col("key"), 0).otherwise(1)})
    exact = req.join(names, req["q"] == names["n"]).select("request", "entry", "step", "ord")
    rest = req.join(exact.select("request").distinct(), "request", "left_anti")
    inside = (F.length("q") >= 3) & (F.length("n") >= 3) & (F.contains("q", "n") | F.contains("n", "q"))
    loose = rest.join(names, inside).select("request", "entry", F.lit(2).alias("step"), "ord")
    return pick(exact.union(loose), ["request"], [F.col("step"), F.col("ord")]).select("request", "entry", "step")


def alias_hits(texts: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """Texts and the one entry whose alias they hold as whole words; texts with hits of several entries are left open (null).

    ``aliases``: entry, alias, of three characters or more. Aliases of n words are joined on the texts' runs of n words,
    and what joins is then looked for in the text as it stands.
    """
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    known = aliases.where(F.length("alias") >= 3).select("entry", F.lower("alias").alias("alias"), split(F.col("alias")).alias("_w")).withColumn("run", F.array_join("_w", " ")).withColumn("_n", F.size("_w"))
    lengths = [r[0] for r in known.select("_n").distinct().collect()]  # as many as aliases differ in words
    words = texts.select(text, split(F.col(text)).alias("_t")).where(F.size("_t") > 0)

    def runs_of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: F.array_join(F.slice("_t", i + 1, n), " "))
        return F.when(F.size("_t") >= n, every).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in lengths]
    if not runs:
        return texts.select(text).where(F.lit(False)).select(text, F.lit(None).cast("string").alias("entry"), F.lit(0).cast("long").alias("hits"))
    met = words.select(text, F.explode(F.array_distinct(F.concat(*runs))).alias("run")).join(known, "run")
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), "alias", F.lit(r"\E(?![a-z0-9])"))
    hit = met.where(F.regexp_like(F.lower(text), quoted))
    return hit.groupBy(text).agg(F.when(F.count_distinct("entry") == 1, F.min("entry")).alias("entry"), F.count_distinct("entry").alias("hits"))


def mode_vote(values: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key, of equals the first seen."""
    counted = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    return pick(counted, keys, [F.col("votes").desc(), F.col("first")]).drop("first")


def uniform(values: DataFrame, keys: list[str], value: str, share: float = 0.9, least: int = 3) -> DataFrame:
    """Whether the values of a key are alike: enough of them, the least at ``share`` of the greatest or more."""
    out = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("uniform", (F.col("n") >= least) & (F.col("low") >= share * F.col("high")))


def load_results(files: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Stored results (path, content: a JSON object a file) as one table with their path, and the log of files that were skipped.

    Fields that old files lack are null. A file that is no object, or whose fields do not have the schema's types, costs
    one row of the log (path, bytes, reason) and nothing else.
    """
    corrupt = "_corrupt"
    asked = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    read = files.select("path", "content", F.from_json("content", asked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    blank = F.coalesce("content", F.lit("")).rlike(r"^\s*$")
    reason = F.when(blank, "empty").when(~F.startswith(F.ltrim(F.regexp_replace("content", r"\s", " ")), F.lit("{")), "no object").when(F.col("r").isNull() | F.col(f"r.{corrupt}").isNotNull(), "broken")
    judged = read.withColumn("reason", reason)
    skipped = judged.where("reason is not null").select("path", F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes"), "reason")
    return judged.where("reason is null").select("path", *(F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields)), skipped


def read_results(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Results from files, a JSON object each, and the log of skipped ones. A file of no bytes is in neither, as Spark opens none."""
    return load_results(spark.read.format("binaryFile").load(paths).select("path", F.col("content").cast("string").alias("content")), schema)


def latest_results(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One result of each key, as language: that which comes last; a rerun replaces what was there."""
    return pick(results, keys, [F.col(order).desc()])


#: What is read of a stored report.
REPORT = "errors array<struct<type:string,script_start_s:double,script_end_s:double,text:string,coverage:double,slot_speech_cov:double,fill:string,fill_rel_db:double,fill_dyn_db:double,fragment:boolean,song_reprise:string,block:struct<id:int,n:int,first:boolean>,confidence:string>>"


def flatten_reports(reports: DataFrame) -> DataFrame:
    """A row per missing line of stored reports (run, workbook, report as JSON), series and episode from the workbook's name; fields that old reports lack are null."""
    part = F.split("workbook", "_")
    named = F.size(part) >= 2
    episode = F.try_element_at(F.filter(part, lambda x: F.upper(x).rlike("^EP[0-9]+$")), F.lit(1))
    e = reports.select("run", F.when(named, part[0]).otherwise("").alias("series"), F.when(named, F.coalesce(F.upper(episode), F.lit(""))).otherwise("").alias("episode"), F.explode(F.from_json("report", REPORT)["errors"]).alias("e")).where("e.type = 'MISSING'")
    renamed = {"start": "script_start_s", "end": "script_end_s", "coverage": "coverage", "slot_cov": "slot_speech_cov", "fill": "fill", "fill_rel_db": "fill_rel_db", "fill_dyn_db": "fill_dyn_db"}
    return e.select("run", "series", "episode", *(F.col(f"e.{c}").alias(n) for n, c in renamed.items()), F.coalesce("e.text", F.lit("")).alias("text"), F.coalesce("e.fragment", F.lit(False)).alias("fragment"), F.col("e.song_reprise").alias("song"), F.col("e.block.id").alias("block_id"), F.col("e.block.n").alias("block_n"), F.col("e.block.first").alias("block_first"), F.col("e.confidence").alias("confidence"))


def read_markers(spark: SparkSession, path: str, fps: int = 25) -> DataFrame:
    """A marker CSV (No., In, Color, Name, Comment) as no, name, comment and sample position. A header alone is no markers.

    Raises on missing columns, blank names, positions that are no time code, and markers out of order.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    if missing := {"In", "Name", "Comment"} - {c.lstrip("\ufeff") for c in raw.columns}:
        raise ValueError(f"{path}: no column for {sorted(missing)}")
    rows = raw.select(F.monotonically_increasing_id().alias("_row"), F.trim(F.coalesce("Name", F.lit(""))).alias("name"), F.trim(F.coalesce("Comment", F.lit(""))).alias("comment"), samples(F.trim("In"), fps).alias("position"))
    order = Window.orderBy("_row")  # one file of markers
    checked = rows.withColumn("_before", F.lag("position").over(order)).withColumn("no", F.row_number().over(order))
    bad = checked.agg(F.count_if(F.col("name") == "").alias("blank"), F.count_if(F.col("position") < F.col("_before")).alias("late")).first()
    if bad.blank:
        raise ValueError(f"{path}: a marker has a blank name")
    if bad.late:
        raise ValueError(f"{path}: markers are not in time order")
    return checked.select("no", "name", "comment", "position")


def voice_entries(cell: Column) -> Column:
    """(language, name, id) of a cell of voices; a voice of two languages is listed for each."""
    listed = F.transform(voice_ids(cell), lambda v: F.transform(voice_languages(v["name"]), lambda x: F.struct(x.alias("language"), v["name"].alias("name"), v["id"].alias("id"))))
    return F.flatten(listed)


def voice_ids(cell: Column) -> Column:
    """(name, id) pairs of a cell: an id is a word of 20 to 22 letters and digits, its name what stands before it."""
    parts = F.regexp_extract_all(cell, F.lit(r"(?s)(.*?)(?<![A-Za-z0-9])([A-Za-z0-9]{20,22})(?![A-Za-z0-9])"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_replace(F.regexp_replace(p, r"[A-Za-z0-9]{20,22}$", ""), r"^\s+|\s+$", "").alias("name"), F.regexp_extract(p, "([A-Za-z0-9]{20,22})$", 1).alias("id")))

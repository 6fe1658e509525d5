"""Which delivered file a request means: originals, dubbed mixes, sets of speaker tracks.

Listings are tables of files and folders, where a request's roots are configuration: which folders of a series to look
into, in which order. Everything is joined on folder ids; names decide by episode and stage.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.names import episode_number, folder_episode, squash
from spanweave.sources.files import pick

# Extensions of videos and of speaker tracks, and the stages of a mix in the order they are preferred.
VIDEO, TRACK = (".m4v", ".mkv", ".mov", ".mp4"), (".aif", ".aiff", ".flac", ".wav")
STAGES = ("stmix", "premix")
#: Where an original is looked for, the best first.
ROLES = ("mix", "premix", "video")


def ends(name: Column, *extensions: str) -> Column:
    return reduce(or_, (F.endswith(F.lower(name), F.lit(e)) for e in extensions))


def at_stage(name: Column, stage: str) -> Column:
    """Whether a name says the stage; ``mix`` and ``stmix`` are both the final mix, any but a premix."""
    plain = squash(name)
    return plain.contains("mix") & ~plain.contains("premix") if stage in ("mix", "stmix") else plain.contains(stage)


def originals(files: DataFrame, roots: DataFrame, requests: DataFrame) -> DataFrame:
    """Every file that could be the original of a request (series, episode), with its role, and ``default`` for the one taken.

    ``files``: folder, id, name; ``roots``: series, role (of ROLES), folder, ord. A final mix, the shortest name first,
    comes before a premix of the first folder that has one, that before a video, the last name first.
    """
    name, role = F.col("name"), F.col("role")
    found = roots.join(files, "folder").withColumn("episode", episode_number(name)).join(requests, ["series", "episode"])
    found = found.where(F.when(role == "video", ends(name, *VIDEO)).otherwise(ends(name, ".wav")))
    plain = squash(name)
    fits = F.when(role == "mix", plain.contains("stmix") & ~plain.contains("premix")).when(role == "premix", plain.contains("premix")).otherwise(True)
    rank = F.coalesce(*(F.when(role == r, k) for k, r in enumerate(ROLES)))
    first = [(~fits).cast("int"), rank, F.when(role == "premix", F.col("ord")), F.when(role != "video", F.length("name")), F.when(role == "video", name).desc(), F.col("id")]
    place = F.row_number().over(Window.partitionBy("series", "episode").orderBy(*first))
    return found.select("series", "episode", "role", "id", "name", ((place == 1) & fits).alias("default"))


def episode_folders(folders: DataFrame, roots: DataFrame, requests: DataFrame) -> DataFrame:
    """The folders below a request's roots that name its episode; ``folders``: parent, id, name, ``roots``: series, lang, folder, ord and more."""
    inside = folders.select(F.col("parent").alias("folder"), F.col("id").alias("sub"), F.col("name").alias("sub_name"), folder_episode(F.col("name")).alias("episode"))
    return roots.join(requests, ["series", "lang"]).join(inside, ["folder", "episode"])


def dub_mixes(folders: DataFrame, files: DataFrame, roots: DataFrame, requests: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The mix of each request (series, lang, episode) with its stage: of the first root whose episode folder has one, at the first stage there is, the last name.

    ``roots``: series, lang, folder, ord, own; in a folder that is not a language's own the name must say the language.
    """
    subs = pick(episode_folders(folders, roots, requests), ["series", "lang", "episode", "folder"], [F.col("sub")])
    name = F.col("name")
    wavs = subs.join(files.select(F.col("folder").alias("sub"), "id", "name"), "sub").where(ends(name, ".wav") & (F.col("own") | F.contains(F.upper(name), F.upper("lang"))))
    stage = F.coalesce(*(F.when(at_stage(name, s), F.struct(F.lit(k).alias("k"), F.lit(s).alias("stage"))) for k, s in enumerate(stages)))
    staged = wavs.withColumn("at", stage).where("at is not null")
    best = pick(staged, ["series", "lang", "episode"], [F.col("ord"), F.col("at.k"), name.desc(), F.col("id")])
    return best.select("series", "lang", "episode", "id", "name", F.col("at.stage").alias("stage"))


def speaker_sets(folders: DataFrame, files: DataFrame, roots: DataFrame, requests: DataFrame, least: int = 3, share: float = 0.9) -> DataFrame:
    """The first folder of each request with ``least`` tracks or more, how many there are, how many are short and whether they are alike in size.

    Tracks far shorter than the longest carry no place in time, so a mixed set cannot be summed.
    """
    tracks = files.where(ends(F.col("name"), *TRACK)).select(F.col("folder").alias("sub"), F.coalesce("size", F.lit(0)).alias("size"))
    longest = tracks.groupBy("sub").agg(F.count(F.lit(1)).alias("tracks"), F.max("size").alias("longest")).where(F.col("tracks") >= least)
    sets = tracks.join(longest, "sub").groupBy("sub", "tracks").agg(F.count_if(F.col("size") < share * F.col("longest")).alias("short"))
    found = episode_folders(folders, roots, requests).join(sets, "sub")
    best = pick(found, ["series", "lang", "episode"], [F.col("ord"), F.col("sub")])
    return best.select("series", "lang", "episode", F.col("sub").alias("id"), F.col("sub_name").alias("name"), "tracks", "short", (F.col("short") == 0).alias("uniform"))

"""Exact deduplication by content-defined chunk recipes (operator 6), in DataFrame functions only.

A text is cut where its content says so: after at least ``MIN_CHUNK`` characters at the first
sentence end or line break, at the latest after ``MAX_CHUNK``. Chunks are reduced to distinct
(identifier, content) rows, each content moving once; an identifier that names two contents is found
there and replaced by numbered ones, so identifiers are verified and not only hashed. A document is
then its ordered list of identifiers, and equal lists mean equal texts: grouping and the way back
move lists, never texts.

Defined results: a null text equals an empty one; among equal texts the row with the largest doc_id
stays; a null doc_id never beats another, and rows repeated with one doc_id share its verdict; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, text_or_empty

MIN_CHUNK, MAX_CHUNK = 1024, 4096
CUTS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?\n]|.{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    """The content-defined pieces of a text, in order; joined they give it again."""
    return F.when(F.length(text) <= MIN_CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(CUTS), F.lit(0)))


def _distinct_chunks(docs: DataFrame, identify: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk").distinct()


def recipes(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256 and the verified recipe of every row; ``docs`` has doc_id and text."""
    plain = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("text")), lambda c: F.struct(identify(c).alias("id"), F.lit(0).alias("k"))).alias("recipe"))
    distinct = _distinct_chunks(docs, identify)
    shared = checkpoint(distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if shared.isEmpty():
        return plain
    number = F.row_number().over(Window.partitionBy("id").orderBy("chunk"))
    numbered = distinct.join(shared, "id", "left_semi").select("id", "chunk", number.alias("number"))
    each = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
    each = each.withColumn("id", identify(F.col("chunk"))).join(numbered, ["id", "chunk"], "left")
    step = F.struct("pos", "id", F.coalesce("number", F.lit(0)).alias("k"))
    rows = each.groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return rows.select("doc_id", "text_sha256", F.transform("steps", lambda s: F.struct(s["id"].alias("id"), s["k"].alias("k"))).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per row of ``docs``."""
    made = checkpoint(recipes(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), identify))
    groups = checkpoint(made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return made.join(groups, "recipe").select("doc_id", "keep_id", "group_size", kept, "text_sha256")

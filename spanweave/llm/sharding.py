"""Sharding by proportional stratified interleaving (operator 12), in DataFrame functions only.

Rows of each stratum (source) are shuffled by a seeded digest and ranked. With n rows in its stratum, the row of rank
r (from 0) takes the fraction (r + v) / n, where v is the stratum's own seeded offset in [0, 1); so a stratum's rows
lie 1 / n apart, and small strata do not all fall into the middle. All rows sorted by fraction are one sequence in
which each stretch has the mixture of the whole, within one row or so a stratum. The sequence is cut into equal counts
(law ``rows``: at most one apart), so a shard is a stretch and its slot the place in it.

Neither the order within a stratum nor the sequence is sorted in one task. Digests and fractions are uniform, so both
sorts go by buckets of equal width: counts a bucket give prefix sums, a window numbers rows within a bucket.

Defined results: a null text has no bytes, a null source is the empty string; rows that are equal in doc_id, source
and text may take each other's place; with fewer rows than shards some shards are empty; an empty table gives an empty
result; groups of equal texts are not kept together, as only the mixture counts; further columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty

SHARDS, SEED, OVERHEAD = 40, 42, 16
#: Buckets of each sort; a bucket of 10^11 rows has some six million.
BUCKETS = 1 << 14
#: Hexadecimal digits of a digest that make a number below 2^52, so that doubles hold it exactly.
DIGITS = 13


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def _unit(digest: Column) -> Column:
    """A digest as a double in [0, 1)."""
    return _number(digest).cast("double") / float(1 << 4 * DIGITS)


def _numbered(rows: DataFrame, stratum: list[str], bucket: Column, order: list[str], name: str, counts: bool = False) -> DataFrame:
    """Each row's place from 0 in the order by bucket and ``order`` within its stratum as ``name``, and the stratum's size as ``{name}_of``."""
    held = rows.withColumn("bucket", bucket)
    sizes = held.groupBy(*stratum, "bucket").agg(F.count(F.lit(1)).alias("members"))
    upto = Window.partitionBy(*stratum).orderBy("bucket")
    ahead = sizes.select(*stratum, "bucket", (F.sum("members").over(upto) - F.col("members")).alias("ahead"), F.sum("members").over(Window.partitionBy(*stratum)).alias(f"{name}_of"))
    place = F.row_number().over(Window.partitionBy(*stratum, "bucket").orderBy(*order)).cast("long")
    ranked = held.withColumn("place", place).join(ahead, [*stratum, "bucket"])
    return ranked.withColumn(name, F.col("ahead") + F.col("place") - 1).drop("bucket", "place", "ahead")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", carry: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, text_crc32, position, shard, slot and the columns to carry; only digests and sizes move, never texts."""
    doc_id, source, text = F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), text_or_empty(text_col)
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.sha2(text.cast("binary"), 256)).cast("binary"))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    rows = materialize(docs.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shuffled.alias("shuffled"), *carry))
    width = (1 << 4 * DIGITS) // buckets
    ranked = _numbered(rows, ["source"], F.floor(_number(F.col("shuffled")) / F.lit(width)).cast("int"), ["shuffled", "doc_id"], "rank")
    offset = _unit(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source")).cast("binary")))
    spread = materialize(ranked.withColumn("fraction", (F.col("rank") + offset) / F.col("rank_of")).drop("rank", "rank_of"))
    placed = _numbered(spread, [], F.floor(F.col("fraction") * buckets).cast("int"), ["fraction", "source", "shuffled", "doc_id"], "position")
    shard = F.expr(f"position * {shards} div position_of")
    begins = F.expr(f"(shard * position_of + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "position", F.col("shard").cast("int"), (F.col("position") - begins).alias("slot"), *carry)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write all columns of ``docs`` below ``path``, a folder ``shard=N`` a shard, its rows in slot order; options as for assign()."""
    row, shard, slot = (f"{c}_{uuid.uuid4().hex}" for c in ("row", "shard", "slot"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    places = assign(numbered, carry=(row,), **options).select(row, F.col("shard").alias(shard), F.col("slot").alias(slot))
    whole = numbered.join(places, row).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    whole.select(*others, F.col(slot).alias("slot"), F.col(shard).alias("shard")).write.partitionBy("shard").parquet(path)

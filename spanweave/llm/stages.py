"""The operators as stages over documents: each returns the documents its decisions leave.

Defined results, for every stage: null and empty texts are empty texts, long ones are read whole; an empty
table gives an empty table; columns beside those read are carried along whatever their names, and a
missing ``n_chars`` stays missing. A decision goes by a digest of a row's doc_id and text, so of rows that share a
doc_id, or have none, each has its own verdict. Of repeated rows (equal doc_id and text) quality rules and
secret scans keep all, exact and near-duplicate removal one. Ties are those of the operators: of equal
texts the largest doc_id stays, of a SimHash component the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact_dedup, quality, secrets, simhash
from .common import checkpoint


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the columns of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def text_key(sha: Column) -> Column:
    """What decisions go by: a 256-bit digest of a row's doc_id and its text's digest, in which different rows do not collide."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), sha).cast("binary"), 256))


def text_sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def keep_once(docs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs``, which has the column ``key``, whose key is in ``kept``, one of those with equal keys."""
    (again,) = unused(docs, "again")
    rows = docs.join(kept.groupBy(key).agg((F.count(F.lit(1)) > 1).alias(again)), key)
    # the join's shuffle serves both sides; only rows whose key comes again are compared
    return rows.where(~F.col(again)).union(rows.where(F.col(again)).dropDuplicates([key])).drop(key, again)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Without the documents that the quality rules reject."""
    (key,) = unused(docs, "key")
    keyed = docs.withColumn(key, text_key(text_sha()))
    known = labels.join(keyed.select("doc_id", key), "doc_id").select(F.col(key).alias("doc_id"), "quality")
    verdict = quality.quality_rules(keyed, known, id_col=key).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(verdict, key, "left_semi").select(*named(docs))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    (key,) = unused(docs, "key")
    kept = exact_dedup.exact_dedup(docs).where("kept").select(text_key(F.col("text_sha256")).alias(key))
    return keep_once(docs.withColumn(key, text_key(text_sha())), kept, key).select(*named(docs))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each SimHash component: that with the smallest doc_id."""
    (key,) = unused(docs, "key")
    keyed = docs.withColumn(key, text_key(text_sha()))
    kept = simhash.simhash_components(keyed.select("doc_id", "text", key), carry=(key,)).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return keep_once(keyed, kept.select(key), key).select(*named(docs))


def named(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def redacted(docs: DataFrame) -> DataFrame:
    """All documents, secrets in their texts replaced by marks and n_chars, if there, counted anew."""
    clean = secrets.redact(docs, secrets.learn(checkpoint(secrets.scan(docs))))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*named(docs))

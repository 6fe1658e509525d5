"""Text features."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it: Spark repeats shared parts of array functions."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def split_words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f]+"), lambda w: w != "")


def content_words(text: Column) -> Column:
    """Distinct words of Latin or Indic letters and digits, of two characters or more, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^0-9a-zA-ZÀ-ɏऀ-ൿ]+"), lambda w: F.length(w) >= 2))


def songlike(text: Column) -> Column:
    """Six words or more, fewer than half of them distinct."""
    return once(split_words(text), lambda w: (F.size(w) >= 6) & (F.size(F.array_distinct(w)) < 0.5 * F.size(w)))


def reliable(quality: Column, text: Column) -> Column:
    """Whether a transcript line can be trusted: no-speech probability, compression ratio and log probability of its engine."""
    engine, nsp, cr, alp = quality["engine"], quality["nsp"], quality["cr"], quality["alp"]
    return (
        F.when(quality.isNull() | (nsp >= 0.5), False)
        .when(cr > F.when(engine == "sarvam", 1.7).otherwise(2.4), False)
        .when((engine == "scribe") & (alp < -0.35), False)
        .otherwise(F.coalesce(alp > -1.2, F.lit(False)) | (F.size(split_words(text)) >= 4))
    )


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """UTF-8 bytes over zlib bytes; 0 for an empty text. Spark has no such function."""
    raw = [(t or "").encode() for t in text]
    return pd.Series([len(r) / len(zlib.compress(r)) if r else 0.0 for r in raw])


def line_key(text: Column) -> Column:
    """Sorted distinct words longer than two characters, or null for fewer than three: one key for a line however it is sung."""
    long = F.sort_array(F.filter(content_words(text), lambda x: F.length(x) > 2))
    return once(long, lambda w: F.when(F.size(w) >= 3, F.array_join(w, " ")))

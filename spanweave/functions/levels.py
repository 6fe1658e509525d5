"""Levels and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decibels(x: Column) -> Column:
    """A level in decibels; just below full scale it stays negative, -0.0, as SQL has it."""
    level = 20 * F.log10(F.greatest(x, F.lit(1e-9)))
    return F.when((level < 0) & (level > -0.05), F.lit(-0.0)).otherwise(F.round(level, 1))


def clamp(x: Column, bound: float) -> Column:
    """A shift, at most ``bound`` either way: a garbage median must not move every slot onto its neighbour."""
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def tolerated_coverage(tolerance_s: Column) -> Column:
    """The share of a line that must be covered at a tolerance."""
    return F.greatest(F.lit(0.2), F.least(F.lit(0.8), 1 - tolerance_s * 0.5))

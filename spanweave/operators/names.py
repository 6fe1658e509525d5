"""Fuzzy joins of names: similarity, one-to-one assignment, matches with a guard against ambiguity."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanweave.config import NAMES, NameConfig
from spanweave.functions.names import AFFIXES, squash, tokens
from spanweave.operators.grouped import map_groups


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two strings, which no built-in function gives; each pair of a batch is compared once, and null costs nothing."""
    known: dict[tuple[str, str], float] = {}
    for pair in zip(a, b, strict=True):
        if pair[0] is not None and pair[1] is not None and pair not in known:
            known[pair] = SequenceMatcher(None, *pair).ratio()
    return pd.Series([known.get(pair, 0.0) for pair in zip(a, b, strict=True)], dtype=float)


def score_names(pairs: DataFrame, channel: str, label: str, affixes: tuple[str, ...] = AFFIXES, cfg: NameConfig = NAMES) -> DataFrame:
    """``pairs`` plus name_score: 1 for equal names, ``tokens`` where one's words are all the other's, ``glued``
    where one is inside the other and long enough, and at least the matching-block ratio. ``affixes`` are words
    that only channels carry. Equal names and names without letters are not compared."""
    words = F.array_except(tokens(F.col(channel)), F.array(*map(F.lit, affixes)).cast("array<string>"))
    kept = F.filter(tokens(F.col(channel)), lambda t: ~t.isin(*affixes)) if affixes else tokens(F.col(channel))
    df = pairs.withColumns({"_c": F.array_join(kept, ""), "_l": squash(F.col(label)), "_ct": words, "_lt": tokens(F.col(label))})
    subset = (F.size(F.array_except("_ct", "_lt")) == 0) | (F.size(F.array_except("_lt", "_ct")) == 0)
    inside = (F.contains("_c", "_l") | F.contains("_l", "_c")) & (F.least(F.length("_c"), F.length("_l")) >= cfg.glued_length)
    plain = F.when(subset, cfg.tokens).when(inside, cfg.glued).otherwise(0.0)
    empty, equal = (F.col("_c") == "") | (F.col("_l") == ""), F.col("_c") == F.col("_l")
    compared = lambda c: F.when(~(empty | equal), F.col(c))
    scored = df.withColumn("_ratio", ratio(compared("_c"), compared("_l")))
    return scored.withColumn("name_score", F.when(empty, 0.0).when(equal, 1.0).otherwise(F.greatest(plain, F.col("_ratio")))).drop("_c", "_l", "_ct", "_lt", "_ratio")


def score_aliases(pairs: DataFrame, channel: str, labels: str, ids: list[str], affixes: tuple[str, ...] = AFFIXES, cfg: NameConfig = NAMES) -> DataFrame:
    """Per ``ids`` the best name_score of a channel's name with any of the labels (an array: name, id, aliases, further terms)."""
    each = pairs.select(*ids, channel, F.explode(F.array_distinct(labels)).alias("_label"))
    best = score_names(each, channel, "_label", affixes, cfg).groupBy(*ids).agg(F.max("name_score").alias("name_score"))
    return pairs.join(best, ids, "left").fillna(0.0, ["name_score"])


def match_voices(characters: DataFrame, entries: DataFrame, keys: list[str], within: list[str], entry: str, scores: list[tuple[str, str, Callable[[Column, Column], Column]]], accept: float = 0.80, exact: float = 0.98) -> DataFrame:
    """Per character (keys) the voice list's best entry of the same ``within``, by whichever of ``scores`` is highest, if it is high enough.

    A score is named by a column of ``characters``, one of ``entries`` and what the two give; null scores nothing. Of equal
    scores an entry with an id (has_id) goes first, then the list's order (ord). Generic names (generic) need ``exact``.

    The best pair is the best by one score, and of entries with one value only the first can be that. So each score is
    worked out once per pair of distinct values, and characters are joined to the results: no pairs of rows are made.
    """
    found, tops = characters, [f"_top{n}" for n in range(len(scores))]
    for top, (left, right, score) in zip(tops, scores, strict=True):
        first = F.min(F.struct((~F.col("has_id")).alias("bare"), "ord", F.col(entry).alias("entry"))).alias("first")
        firsts = entries.where(F.col(right).isNotNull()).groupBy(*within, F.col(right).alias("_right")).agg(first)
        values = characters.where(F.col(left).isNotNull()).select(*within, F.col(left).alias("_left")).distinct()
        scored = values.join(firsts, within).withColumn("_less", -F.round(score(F.col("_left"), F.col("_right")), 9)).where("_less is not null")
        best = scored.groupBy(*within, F.col("_left").alias(left)).agg(F.min(F.struct(F.col("_less").alias("less"), "first")).alias(top))
        found = found.join(best, [*within, left], "left")
    either = found.select(*keys, F.array_min(F.array(*tops)).alias("top"), "generic").where("top is not null")
    best = either.groupBy(*keys).agg(F.min(F.struct("top", "generic")).alias("best")).select(*keys, F.col("best.top.first.entry").alias(entry), (-F.col("best.top.less")).alias("score"), "best.generic")
    return best.where(F.col("score") >= F.when(F.col("generic"), exact).otherwise(accept)).select(*keys, entry, F.round("score", 3).alias("score"))


def assign_greedily(pairs: DataFrame, keys: list[str], left: str, right: str, score: str, accept: float) -> DataFrame:
    """One-to-one pairs of each key, best score first; of equals the greatest left and right name.

    A key is an episode with tens of names on either side; a task walks many keys after each other.
    """
    kept = pairs.where(F.col(score) >= accept).select(*keys, left, right, score)

    def assign(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        a, b = table[left].to_pylist(), table[right].to_pylist()
        taken, begins = [], set(starts.tolist())
        for row in range(table.num_rows):
            if row in begins:
                seen_left, seen_right = set(), set()
            if a[row] not in seen_left and b[row] not in seen_right:
                seen_left.add(a[row])
                seen_right.add(b[row])
                taken.append(row)
        return table.take(pa.array(taken, pa.int64())).combine_chunks().to_batches()[0]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_groups(kept, keys, [F.col(c).desc() for c in (score, left, right)], assign, schema)


def match_roster(pairs: DataFrame, keys: list[str], entry: str, base: str, generic: str, cfg: NameConfig = NAMES) -> DataFrame:
    """Per key the best-scoring roster entry, unless an entry of another base comes within the ambiguity margin.

    ``pairs`` has name_score; ``generic`` marks names that need a higher score.
    """
    rank = Window.partitionBy(*keys).orderBy(F.col("name_score").desc(), entry)
    ranked = pairs.withColumns({"rank": F.row_number().over(rank), "top": F.first(base).over(rank)})
    best = ranked.groupBy(*keys).agg(
        F.max("name_score").alias("name_score"),
        F.max(F.when(F.col("rank") == 1, F.col(entry))).alias(entry),
        F.max(F.when(F.col(base) != F.col("top"), F.col("name_score"))).alias("rival_score"),
        F.bool_or(generic).alias(generic),
    )
    enough = F.col("name_score") >= F.when(F.col(generic), cfg.roster_generic).otherwise(cfg.roster_accept)
    return best.where(enough & ~F.coalesce(F.col("rival_score") >= F.col("name_score") - cfg.ambiguity, F.lit(False)))


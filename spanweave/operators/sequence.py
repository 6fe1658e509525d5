"""Order-preserving alignment of two sequences of lines by similarity, within a band of time.

Only lines at most ``band_s`` apart may pair, so a line's row of scores needs no more columns than the
others near it: others that lie before the band of a line and of all later ones can only be extra, those
behind it are left to later lines. A row is computed from the one before it as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.config import SEQUENCE, SequenceConfig

PAIRED = "kind string, i int, j int, sim double"
PAIR, MERGE, SKIP = 1, 2, 3
#: Scores closer than this are equal; of equals a pair goes before a merge, that before a missing and that before an extra line.
EPSILON = 1e-9


def bands(starts: np.ndarray, other_starts: np.ndarray, cfg: SequenceConfig = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Per line the first and the last number of others that may have been used up after it; both never fall."""
    order = np.sort(other_starts)
    if (order == other_starts).all():
        low, high = np.searchsorted(order, starts - cfg.band_s, "left"), np.searchsorted(order, starts + cfg.band_s, "right")
    else:  # others out of order: all from the first to the last near one
        near = np.abs(starts[:, None] - other_starts[None, :]) <= cfg.band_s
        low = np.where(near.any(axis=1), near.argmax(axis=1), len(other_starts))
        high = np.where(near.any(axis=1), len(other_starts) - near[:, ::-1].argmax(axis=1), 0)
    low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
    # a merge may take one other from beyond the band
    return np.maximum(low - 1, 0), np.minimum(np.maximum(high, low) + 1, len(other_starts))


def best_path(pairs: list[tuple[int, int, float]], starts: np.ndarray, other_starts: np.ndarray, gap: float, least: float, cfg: SequenceConfig = SEQUENCE) -> list[tuple[str, int, int, float]]:
    """Pairs, missing and extra lines on the best monotone path; ``pairs``: line, other and similarity, absent ones being 0.

    One line may take two neighbouring others at ``merge_cost``, of which those below the bounds count as extra-free.
    """
    m = len(other_starts)
    low, high = bands(starts, other_starts, cfg)
    rows: list[dict[int, float]] = [{} for _ in starts]
    for i, j, s in pairs:
        if s >= least and abs(starts[i] - other_starts[j]) <= cfg.band_s:
            rows[i][j] = s
    first, value = 0, np.zeros(1)  # the row before: states first, first + 1, ...
    steps: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(starts)):
        a, b = int(low[i]), int(high[i])
        # what the row before is worth from state a on: lower ones skip up to it, missing higher ones skip from the last
        size = b - a + 1
        before, origin = np.full(size, -np.inf), np.full(size, -1)
        lead = max(0, min(a - first, len(value) - 1))
        reach = value[: lead + 1] - gap * (a - first - np.arange(lead + 1)) if a >= first else np.empty(0)
        keep = slice(max(0, first - a), min(size, first + len(value) - a))
        if keep.stop > keep.start:
            before[keep] = value[a + keep.start - first : a + keep.stop - first]
            origin[keep] = np.arange(a + keep.start, a + keep.stop)
        if len(reach) and reach.max() > before[0] + EPSILON:
            k = int(reach.argmax())
            before[0], origin[0] = reach[k], first + k
        last = max(0, keep.stop - 1)
        if keep.stop < size:
            tail = np.arange(last + 1, size)
            before[tail], origin[tail] = before[last] - gap * (tail - last), origin[last]
        sim = np.full(size + 1, -np.inf)  # sim[k]: other a + k - 1
        for j, s in rows[i].items():
            sim[j + 1 - a] = s
        one = np.r_[-np.inf, before[:-1]] + sim[:size]
        two = np.r_[-np.inf, -np.inf, before[:-2]][:size] + np.maximum(sim[:size], np.r_[-np.inf, sim[: size - 1]]) - cfg.merge_cost
        none = before - gap
        how, best = np.full(size, PAIR, np.int8), one
        for option, kind in ((two, MERGE), (none, SKIP)):
            better = option > best + EPSILON
            better |= np.isneginf(best) & ~np.isneginf(option)
            how, best = np.where(better, kind, how).astype(np.int8), np.where(better, option, best)
        # extra lines: the best earlier state of the row, less the gaps up to here
        lifted = best + gap * np.arange(size)
        top = np.maximum.accumulate(lifted)
        here = lifted >= top - EPSILON
        source = np.maximum.accumulate(np.where(here, np.arange(size), 0))
        first, value = a, best[source] - gap * (np.arange(size) - source)
        steps.append((a, how, source + a, origin))
    end = first + int(np.argmax(value - gap * (m - first - np.arange(len(value))) + EPSILON * np.arange(len(value))))
    out = [("extra", -1, j, 0.0) for j in range(end, m)]
    state = end
    for i in range(len(starts) - 1, -1, -1):
        a, how, source, origin = steps[i]
        taken = int(source[state - a])
        out += [("extra", -1, j, 0.0) for j in range(taken, state)]
        kind = how[taken - a]
        used = {PAIR: 1, MERGE: 2, SKIP: 0}[int(kind)]
        mine = [("pair", i, j, rows[i][j]) for j in range(taken - used, taken) if j in rows[i]]
        out += mine or [("missing", i, -1, 0.0)]
        state = int(origin[taken - used - a])
        out += [("extra", -1, j, 0.0) for j in range(state, taken - used)]
    return out + [("extra", -1, j, 0.0) for j in range(state)]


def align_sequences(lines: DataFrame, others: DataFrame, sims: DataFrame, key: str, adaptive: bool = True, cfg: SequenceConfig = SEQUENCE) -> DataFrame:
    """Per key the best path over lines (i, start_s) and others (j, start_s), numbered from 0; ``sims``: i, j, sim, absent pairs being 0.

    The least similarity and the gap cost follow the median of the lines' best similarities, an aggregate. Only
    pairs within the band and above the bound are collected, so a key's task holds its lines and their near pairs.
    """
    best = lines.select(key, "i").join(sims.groupBy(key, "i").agg(F.max("sim").alias("best")), [key, "i"], "left").groupBy(key).agg(F.median(F.coalesce("best", F.lit(0.0))).alias("level"))
    bound = F.greatest(F.lit(0.30), F.least(F.lit(0.5), 0.62 * F.col("level"))) if adaptive else F.lit(cfg.min_sim)
    cost = F.greatest(F.lit(0.20), 0.55 * F.col("level")) if adaptive else F.lit(cfg.gap)
    levels = best.select(key, bound.alias("least"), cost.alias("gap"))
    ordered = lambda df, n: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(n, "start_s"))), lambda x: x["start_s"]).alias(f"{n}s"))
    near = sims.join(lines.select(key, "i", F.col("start_s").alias("s")), [key, "i"]).join(others.select(key, "j", F.col("start_s").alias("o")), [key, "j"]).join(levels, key)
    near = near.where((F.abs(F.col("s") - F.col("o")) <= cfg.band_s) & (F.col("sim") >= F.col("least"))).groupBy(key).agg(F.collect_list(F.struct("i", "j", "sim")).alias("pairs"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    whole = ordered(lines, "i").join(ordered(others, "j"), key, "full").join(near, key, "left").join(levels, key, "left")
    whole = whole.select(key, empty(F.col("is"), "array<double>").alias("is"), empty(F.col("js"), "array<double>").alias("js"), empty(F.col("pairs"), "array<struct<i:int,j:int,sim:double>>").alias("pairs"), F.coalesce("least", F.lit(0.3)).alias("least"), F.coalesce("gap", F.lit(0.2)).alias("gap"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, a, b, pairs, least, gap in pdf.itertuples(index=False):
                rows += [(k, *step) for step in best_path([(p["i"], p["j"], p["sim"]) for p in pairs], np.asarray(a, float), np.asarray(b, float), gap, least, cfg)]
            yield pd.DataFrame(rows, columns=[key, "kind", "i", "j", "sim"])

    return whole.mapInPandas(align, f"{key} {lines.schema[key].dataType.simpleString()}, {PAIRED}")

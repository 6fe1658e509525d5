"""Timelines that were cut and joined: concatenated windows, words to lines, drift between two envelopes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.operators.grouped import column, fold_groups, map_groups
from spanweave.operators.islands import ahead_in_blocks, number_in_blocks, number_runs


def concatenated(windows: DataFrame, keys: list[str], pad_s: float = 0.2, gap_s: float = 0.5, ids: tuple[str, ...] = ()) -> DataFrame:
    """Where each padded window starts on the timeline of all windows in a row with gaps between; adds from_s, to_s and at_s. Windows that start together go by their end, then by ``ids``; those without a start come last."""
    padded = windows.withColumns({"from_s": F.greatest(F.lit(0.0), F.col("start_s") - pad_s), "to_s": F.col("end_s") + pad_s})
    before = Window.partitionBy(*keys).orderBy(F.col("start_s").asc_nulls_last(), F.col("end_s").asc_nulls_last(), *ids).rowsBetween(Window.unboundedPreceding, -1)
    return padded.withColumn("at_s", F.coalesce(F.sum(F.col("to_s") - F.col("from_s") + gap_s).over(before), F.lit(0.0)))


def map_back(points: DataFrame, placed: DataFrame, keys: list[str], gap_s: float = 0.5, bin_width: float = 600.0) -> DataFrame:
    """Points (at) of the joined timeline in original time: within the window they fall into, a point in a gap at the window's edge."""
    length = F.col("to_s") - F.col("from_s")
    p = placed.select(*keys, "from_s", "to_s", "at_s").withColumn("bin", F.explode(F.sequence(F.floor(F.col("at_s") / bin_width), F.floor((F.col("at_s") + length + gap_s) / bin_width))))
    inside = points.withColumn("bin", F.floor(F.col("at") / bin_width)).join(p, [*keys, "bin"]).where((F.col("at") >= F.col("at_s")) & (F.col("at") < F.col("at_s") + length + gap_s))
    return inside.withColumn("original_s", F.col("from_s") + F.least(F.col("at") - F.col("at_s"), length)).drop("from_s", "to_s", "at_s", "bin")


def words_to_lines(words: DataFrame, keys: list[str], gap_s: float = 0.7, block_s: float | None = None) -> DataFrame:
    """Lines of words: a new one after a pause, after a word that ends a sentence (ends), or in another window (window). With ``block_s`` a key is worked on in blocks of that many seconds."""
    order = ["start_s", "word"]
    if block_s is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        breaks = (F.col("start_s") - F.lag("end_s").over(w) > gap_s) | F.lag("ends").over(w) | (F.col("window") != F.lag("window").over(w))
        runs = number_runs(words, keys, order, breaks, "line")
    else:
        # the word ahead is the greatest by order of those ahead
        said = F.struct(*order, "end_s", "ends", "window")
        ahead = ahead_in_blocks(words.withColumn("block", F.floor(F.col("start_s") / block_s)), keys, order, said, "_ahead")
        breaks = (F.col("start_s") - F.col("_ahead.end_s") > gap_s) | F.col("_ahead.ends") | (F.col("window") != F.col("_ahead.window"))
        runs = number_in_blocks(ahead.withColumn("_opens", F.coalesce(breaks, F.lit(True))), keys, order, "_opens", "line")
    return runs.groupBy(*keys, "line").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("words"))


def best_shifts(a: np.ndarray, b: np.ndarray, window: int, most: int, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best shift, peak and margin of every window (rows of ``a``) against ``b``, rows of which hold frames from ``most`` before the window on; NaN where there is none.

    All shifts of a window are one correlation by Fourier transform; means and norms of the shifted segments come from
    prefix sums. Scores are rounded to nine digits, of equal ones the smallest shift wins.
    """
    size = 1 << (window + b.shape[1] - 1).bit_length()
    centred = a - a.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(centred, axis=1)
    there = np.isfinite(b)
    known = np.where(there, b, 0.0)
    # sums of values near their mean lose fewer digits
    known = np.where(there, known - known.sum(axis=1, keepdims=True) / np.maximum(1, there.sum(axis=1, keepdims=True)), 0.0)
    dots = np.fft.irfft(np.fft.rfft(known, size) * np.conj(np.fft.rfft(centred, size)), size)[:, : 2 * most + 1]
    ahead = lambda x: np.pad(np.cumsum(x, axis=1), ((0, 0), (1, 0)))
    over = lambda x: (s := ahead(x))[:, window : window + 2 * most + 1] - s[:, : 2 * most + 1]
    spread = np.sqrt(np.maximum(0.0, over(known**2) - over(known) ** 2 / window))
    usable = (over(there.astype(np.int64)) == window) & (spread >= 1e-6)
    scores = np.where(usable, np.round(dots / (np.where(norm > 0, norm, 1.0)[:, None] * np.where(usable, spread, 1.0)), 9), -1.0)
    best = scores.argmax(axis=1)
    peak = scores[np.arange(len(a)), best]
    far = np.abs(np.arange(2 * most + 1) - best[:, None]) >= apart
    rival = np.where(far, scores, -np.inf).max(axis=1)
    return best - most, peak, peak - np.where(np.isfinite(rival), rival, 0.0)


def drift(frames: DataFrame, key: str, window: int, hop: int, most: int, apart: int, peak: float = 0.55, margin: float = 0.10, quiet: float = 0.05, block: int = 64) -> DataFrame:
    """Windows of an original's envelope that match the dub's at a shift: key, at, shift, peak, margin.

    ``frames``: key, i from 0 without gaps, a (the original) and b (the dub), null beyond the end of either. A window of
    the original, every ``hop`` frames, is compared with each whole segment of the dub that begins up to ``most`` frames
    before or after it. It is accepted from ``peak`` on if no shift ``apart`` frames away or more comes closer than ``margin``;
    windows whose deviation is below ``quiet`` have nothing to match. A track goes to tasks in blocks of ``block`` windows
    with the frames around them, so shifts cost no rows and no track is one task.
    """
    span = block * hop  # frames from one block's first window to the next one's
    reach = (block - 1) * hop + window
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - (reach + most - 1)) / span))
    spread = frames.select(key, F.col("i").cast("long").alias("i"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.explode(F.sequence(low, F.floor((F.col("i") + most) / span))).alias("block"))

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        i, a, b, number = (column(table, c) for c in ("i", "a", "b", "block"))
        rows: list[tuple[np.ndarray, ...]] = []
        for s, e in zip(starts, np.append(starts[1:], len(i)), strict=True):
            base = int(number[s]) * span
            line = np.full((2, reach + 2 * most), np.nan)
            at = i[s:e] - (base - most)
            line[:, at] = a[s:e], b[s:e]
            places = np.arange(block) * hop
            pieces = np.lib.stride_tricks.sliding_window_view(line[0, most : most + reach], window)[places]
            wanted = np.flatnonzero(np.isfinite(pieces).all(axis=1))
            wanted = wanted[pieces[wanted].std(axis=1) >= quiet]
            if len(wanted):
                around = np.lib.stride_tricks.sliding_window_view(line[1], window + 2 * most)[places[wanted]]
                shift, top, lead = best_shifts(pieces[wanted], around, window, most, apart)
                kept = np.flatnonzero((top >= peak) & (lead >= margin))
                rows.append((np.full(len(kept), s), base + places[wanted[kept]], shift[kept], top[kept], lead[kept]))
        who, at, shift, top, lead = map(np.concatenate, zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 5
        return pa.RecordBatch.from_arrays([table[key].take(pa.array(who, pa.int64())).combine_chunks(), *(pa.array(x, t) for x, t in ((at, pa.int64()), (shift, pa.int64()), (top, pa.float64()), (lead, pa.float64())))], [key, "at", "shift", "peak", "margin"])

    return map_groups(spread, [key, "block"], ["i"], run, f"`{key}` {frames.schema[key].dataType.simpleString()}, at long, shift long, peak double, margin double")


def drift_at(points: DataFrame, windows: DataFrame, keys: list[str], ids: list[str], fallback: float, within: float = 60.0) -> DataFrame:
    """Points (at_s) with drift_s: that of the nearest confident window (center_s, drift_s) at most ``within`` away, of equals the earlier, else ``fallback``."""
    p = points.select(*keys, *ids, "at_s").withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("at_s") / within) + d)))
    w = windows.select(*keys, "center_s", "drift_s").withColumn("bin", F.floor(F.col("center_s") / within))
    away = F.abs(F.col("center_s") - F.col("at_s"))
    near = p.join(w, [*keys, "bin"]).where(away <= within).groupBy(*keys, *ids).agg(F.min(F.struct(away.alias("away"), "center_s", "drift_s")).alias("best"))
    return points.join(near, [*keys, *ids], "left").withColumn("drift_s", F.coalesce("best.drift_s", F.lit(float(fallback)))).drop("best")


def chunked(placed: DataFrame, keys: list[str], most_s: float = 560.0) -> DataFrame:
    """Placed windows (from_s, to_s, at_s of ``concatenated``) with chunk: runs whose joined length stays within ``most_s``, cut between windows.

    Where a chunk ends depends on where it began, so the windows of a recording are gone through in order, a chunk's end
    found by search; between batches only its begin and number are held. A longer window is alone.
    """

    def run(table: pa.Table, state: tuple[float, int] | None) -> tuple[pa.RecordBatch, tuple[float, int]]:
        at, low, high = (column(table, c) for c in ("at_s", "from_s", "to_s"))
        ends, chunk, row = at + high - low, np.zeros(len(at), np.int32), 0
        begin, n = state or (at[0], 0)
        first = state is None
        while row < len(at):
            stop = max(row + first, row + int(np.searchsorted(ends[row:], begin + most_s, "right")))
            # the sum may round the other way than the difference that counts
            while stop > row + first and ends[stop - 1] - begin > most_s:
                stop -= 1
            while stop < len(at) and ends[stop] - begin <= most_s:
                stop += 1
            chunk[row:stop] = n
            row = stop
            if row < len(at):
                begin, n, first = at[row], n + 1, True
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in (*keys, "from_s", "to_s", "at_s")), pa.array(chunk)], [*keys, "from_s", "to_s", "at_s", "chunk"]), (float(begin), n)

    kept = placed.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("from_s", "to_s", "at_s")))
    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in keys)
    return fold_groups(kept, keys, ["at_s"], run, f"{schema}, from_s double, to_s double, at_s double, chunk int")


def monotone(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Events that go beyond all before them: reported progress never falls back or repeats."""
    before = F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", before).where(F.col(value) > F.coalesce("_before", F.lit(float("-inf")))).drop("_before")


def resampled(samples: DataFrame, keys: list[str], step_s: float) -> DataFrame:
    """Samples (at_s, value) linearly interpolated at multiples of ``step_s`` between a key's first and last one."""
    w = Window.partitionBy(*keys).orderBy("at_s")
    segments = samples.withColumns({"_to": F.lead("at_s").over(w), "_next": F.lead("value").over(w)})
    # each stretch owns the multiples from its start on, the last one its end, too
    last = F.coalesce("_to", F.col("at_s"))
    low, high = F.ceil(F.col("at_s") / step_s), F.floor(last / step_s) - F.when(F.col("_to").isNotNull() & (F.floor(last / step_s) * step_s == last), 1).otherwise(0)
    at = segments.withColumn("_k", F.explode(F.when(high >= low, F.sequence(low, high)))).withColumn("_at", F.col("_k") * step_s)
    share = F.when(F.col("_to") > F.col("at_s"), (F.col("_at") - F.col("at_s")) / (F.col("_to") - F.col("at_s"))).otherwise(0.0)
    return at.select(*keys, F.col("_at").alias("at_s"), (F.col("value") + share * (F.coalesce("_next", "value") - F.col("value"))).alias("value"))


def nearby(points: DataFrame, others: DataFrame, keys: list[str], ids: list[str], within: float) -> DataFrame:
    """Per point (at_s) how many others lie within ``within`` seconds; joined over bins of that width."""
    p = points.withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("at_s") / within) + d)))
    o = others.select(*keys, F.col("at_s").alias("other_s")).withColumn("bin", F.floor(F.col("other_s") / within))
    hit = p.join(o, [*keys, "bin"]).where(F.abs(F.col("other_s") - F.col("at_s")) <= within)
    counts = hit.groupBy(*keys, *ids).agg(F.count(F.lit(1)).alias("n"))
    return points.join(counts, [*keys, *ids], "left").fillna(0, ["n"]).select(*keys, *ids, "n")

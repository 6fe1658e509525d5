"""Vectors of lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.levels import dot
from spanweave.operators.grouped import column, fold_groups, map_groups

#: Least and most vectors of a block that a task holds, and the products that it makes at once.
BLOCK, PRODUCTS = (4_096, 65_536), 1 << 22


def centred(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Vectors less the mean of their key's, brought to length 1: what all lines have in common no longer makes them alike.

    The mean is taken place by place, so no key's vectors are gathered; a vector equal to the mean stays zero.
    """
    moved = less_mean(vectors, keys, vector)
    length = F.sqrt(dot(F.col(vector), F.col(vector)))
    return moved.withColumn("_length", length).withColumn(vector, F.transform(vector, lambda x: x / F.greatest(F.col("_length"), F.lit(1e-12)))).drop("_length")


def less_mean(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Vectors less the mean of their key's, of whatever length."""
    place = vectors.select(*keys, F.posexplode(vector).alias("_p", "_v")).groupBy(*keys, "_p").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    mean = place.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("_mean"))
    return vectors.join(mean, keys).withColumn(vector, F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)).drop("_mean")


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows in double; as in SQL, they must have one length and no null places."""
    lists = vectors.combine_chunks()
    lengths, places = pc.unique(pc.list_value_length(lists)), lists.flatten()
    if len(lengths) != 1 or places.null_count:
        raise ValueError("vectors that are compared must have one length and no null places")
    return places.to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), lengths[0].as_py())


def best_inner(queries: DataFrame, others: DataFrame, keys: list[str], id: str, vector: str = "vector", block: tuple[int, int] = BLOCK) -> DataFrame:
    """Per query's id sim, the greatest inner product in double with a vector of the same keys and another id; null where these are all null, no row where there are none.

    All pairs are compared, so the time is quadratic, but no pair is a row: vectors of a key go to blocks by their id, a
    twentieth of the key within the bounds of ``block``, and each query to all blocks of its key. A task holds a block and
    makes the products of the queries that pass by as products of matrices, a piece at a time, so a key of any size is spread
    over tasks and nothing of it must be held whole.
    """
    size = F.greatest(F.lit(block[0]), F.least(F.lit(block[1]), F.ceil(F.col("_n") / 20)))
    sizes = others.groupBy(*keys).agg(F.count(vector).alias("_n"), F.min(id).alias("_low"), F.max(id).alias("_high")).withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_n") / size)))
    asked, held = (df.where(F.col(id).isNotNull()).join(sizes, keys) for df in (queries, others))
    go = lambda df, asks, at: df.where(F.col(vector).isNotNull()).select(*keys, at.alias("_block"), F.lit(asks).alias("_asks"), id, vector)
    met = go(held, False, F.pmod(F.xxhash64(id), "_blocks")).unionByName(go(asked, True, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))))

    def run(table: pa.Table, state: list[pa.Table] | tuple[np.ndarray, np.ndarray] | None) -> tuple[pa.RecordBatch, list[pa.Table] | tuple[np.ndarray, np.ndarray]]:
        n = table.num_rows - int(column(table, "_asks").sum())
        # tables of the block until a query comes, then its ids and vectors
        held, asking = state or [], table.slice(n)
        if n:
            held = [*held, table.slice(0, n)]
        best = np.empty(asking.num_rows)
        there = np.zeros(asking.num_rows, bool)
        if held and asking.num_rows:
            if isinstance(held, list):
                whole = pa.concat_tables(held)
                held = column(whole, id), matrix(whole[vector])
            (names, values), wanted = held, matrix(asking[vector])
            low, high = (np.searchsorted(names, column(asking, id), side) for side in ("left", "right"))
            there, step = high - low < len(names), max(1, PRODUCTS // len(names))
            for a in range(0, len(best), step):
                products = wanted[a : a + step] @ values.T
                for r in np.flatnonzero((high > low)[a : a + step]).tolist():
                    products[r, low[a + r] : high[a + r]] = -np.inf
                best[a : a + step] = products.max(axis=1)
        return pa.RecordBatch.from_arrays([asking[id].filter(pa.array(there)).combine_chunks(), pa.array(best[there], pa.float64())], [id, "sim"]), held

    sims = fold_groups(met, [*keys, "_block"], ["_asks", id], run, f"`{id}` {queries.schema[id].dataType.simpleString()}, sim double")
    others_there = asked.where((F.col("_low") != F.col(id)) | (F.col("_high") != F.col(id))).select(id, F.lit(None).cast("double").alias("sim"))
    return sims.unionByName(others_there).groupBy(id).agg(F.max("sim").alias("sim"))


def rescan(flags: DataFrame, frames: DataFrame, key: str, rate: float, span_s: float = 2.0, step_s: float = 0.4, clears: float = 0.60) -> DataFrame:
    """Flagged lines compared with what lies near their expected place: key, flag, at_s (of the best window), sim and cleared.

    ``flags``: key, flag, at_s, window_s, vector; ``frames``: key, i from 0 (``rate`` a second), vector. Windows as long as
    the flag's begin every ``step_s`` from ``span_s`` before its place to ``span_s`` after it, kept within the recording. A
    window's vector is the mean of its frames' brought to length 1, from prefix sums over the flag's stretch; the best is
    the first of those with the highest cosine, and from ``clears`` on the line is there. Flags without a window are left out.

    A flag meets only the frames of its stretch, over bins of time, so a recording is no single task.
    """
    length = frames.groupBy(key).agg(((F.max("i") + 1) / rate).alias("_end"))
    placed = flags.join(length, key).withColumn("_from", F.greatest(F.lit(0.0), F.least(F.col("at_s") - span_s, F.col("_end") - F.col("window_s"))))
    placed = placed.withColumn("_to", F.greatest("_from", F.least(F.col("_end") - F.col("window_s"), F.col("at_s") + span_s))).where(F.col("_from") + F.col("window_s") <= F.col("_end") + 1e-6)
    width = 8 * span_s
    near = placed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") + F.col("window_s")) / width))))
    binned = frames.select(key, F.col("i").cast("long").alias("_i"), F.col("vector").cast("array<double>").alias("_v"), F.floor(F.col("i") / rate / width).alias("_bin"))
    inside = (F.col("_i") / rate >= F.col("_from") - 1e-9) & (F.col("_i") / rate < F.col("_to") + F.col("window_s") + 1e-9)
    met = near.select(key, "flag", "window_s", "_from", "_to", "_end", F.col("vector").cast("array<double>").alias("_ref"), "_bin").join(binned, [key, "_bin"]).where(inside).drop("_bin")

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        i, low, high, window, end = (column(table, c) for c in ("_i", "_from", "_to", "window_s", "_end"))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            vectors = np.array(table["_v"].slice(a, b - a).to_pylist(), float)
            ref = np.array(table["_ref"][a].as_py(), float)
            begins = np.round(low[a] + np.arange(int((high[a] - low[a]) / step_s + 1e-9) + 1) * step_s, 2)
            begins = begins[begins + window[a] <= end[a] + 1e-6]
            if not len(begins):
                begins = low[a : a + 1]
            sums = np.vstack([np.zeros(vectors.shape[1]), np.cumsum(vectors, axis=0)])
            first = np.searchsorted(i[a:b], np.ceil(begins * rate - 1e-6))
            last = np.searchsorted(i[a:b], np.ceil((begins + window[a]) * rate - 1e-6))
            pooled = (sums[last] - sums[first]) / np.maximum(1, last - first)[:, None]
            sims = np.round(pooled @ ref / np.maximum(np.linalg.norm(pooled, axis=1), 1e-12), 9)
            best = int(sims.argmax())
            out.append((a, float(begins[best]), float(sims[best])))
        at = pa.array([o[0] for o in out], pa.int64())
        return pa.RecordBatch.from_arrays([*(table[c].take(at).combine_chunks() for c in (key, "flag")), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64())], [key, "flag", "at_s", "sim"])

    kinds = {c: flags.schema[c].dataType.simpleString() for c in (key, "flag")}
    best = map_groups(met, [key, "flag"], ["_i"], run, f"`{key}` {kinds[key]}, flag {kinds['flag']}, at_s double, sim double")
    return best.withColumn("cleared", F.col("sim") >= clears)

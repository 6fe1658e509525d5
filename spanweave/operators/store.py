"""Keyed stores and snapshots: latest per key, the newest n, differences, ranked choices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.operators.grouped import column, map_groups
from spanweave.operators.intervals import overlap_join, overlap_seconds
from spanweave.session import cut_lineage


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, ranked: a bounded store."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def upsert(store: DataFrame, changes: DataFrame, key: str, updated: str) -> DataFrame:
    """Store and changes with one row per key: the latest, of equals the change."""
    both = store.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], [F.col(updated).desc(), F.col("_new").desc()]).drop("_new")


def added(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Rows whose key the previous snapshot did not have. Renames keep their key and are no addition; deletions are not reported."""
    return now.join(before.select(key), key, "left_anti")


def cluster_draws(draws: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Union of several readings' findings: draw, start_s, end_s, tier (0 low to 2 high).

    In the order of draws and times a finding joins the first cluster whose representative it meets within the
    tolerance, else it opens one; a higher tier becomes the representative. Findings further apart than that from
    all others never meet, so a key is parted into such islands first. A finding alone in its island is its own cluster;
    tasks walk the other islands, many of a batch after each other, and an island is one task's work.
    """
    w = Window.partitionBy(*keys).orderBy("start_s", "end_s", "draw")
    reach = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start_s") - reach <= tolerance, 0).otherwise(1)
    parted = draws.select(*keys, "draw", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), F.col("tier").cast("int").alias("tier")).withColumn("_open", opens)
    parted = parted.withColumns({"_island": F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"), "_alone": (F.col("_open") == 1) & (F.coalesce(F.lead("_open").over(w), F.lit(1)) == 1)}).drop("_open")
    alone = parted.where("_alone").select(*keys, "start_s", "end_s", "tier", F.lit(1).cast("long").alias("members"))

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        low, high, tier = (column(table, c) for c in ("start_s", "end_s", "tier"))
        heads, members = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            for row, n in _walk_island(low[a:b].tolist(), high[a:b].tolist(), tier[a:b].tolist(), tolerance):
                heads.append(a + row)
                members.append(n)
        return table.select([*keys, "start_s", "end_s", "tier"]).take(pa.array(heads, pa.int64())).append_column("members", pa.array(members, pa.int64())).combine_chunks().to_batches()[0]

    schema = ", ".join(f"`{c}` {draws.schema[c].dataType.simpleString()}" for c in keys)
    met = map_groups(parted.where("not _alone").drop("_alone"), [*keys, "_island"], ["draw", "start_s", "end_s"], run, f"{schema}, start_s double, end_s double, tier int, members long")
    total = draws.groupBy(*keys).agg(F.count_distinct("draw").cast("int").alias("draws"))
    return alone.union(met).join(total, keys).select(*keys, "start_s", "end_s", "tier", F.least("members", "draws").cast("int").alias("seen"), "draws")


def _walk_island(low: list[float], high: list[float], tier: list[int], tolerance: float) -> list[tuple[int, int]]:
    """(row of the representative, members) of each cluster, in order of opening. Representatives are looked up by the time
    bins they touch, as wide as a finding on average, so a long island costs what lies around each finding."""
    width = max(sum(high) - sum(low), 0.0) / len(low) + tolerance or 1.0
    chief: list[int] = []
    members: list[int] = []
    at: dict[int, list[int]] = {}
    for row, (a, b) in enumerate(zip(low, high, strict=True)):
        near = {c for k in range(int((a - tolerance) // width), int((b + tolerance) // width) + 1) for c in at.get(k, ())}
        mine = min((c for c in near if low[chief[c]] <= b + tolerance and high[chief[c]] >= a - tolerance), default=None)
        if mine is None:
            mine = len(chief)
            chief.append(row)
            members.append(0)
        elif tier[row] > tier[chief[mine]]:
            old = chief[mine]
            for k in range(int(low[old] // width), int(high[old] // width) + 1):
                at[k].remove(mine)
            chief[mine] = row
        members[mine] += 1
        if chief[mine] == row:
            for k in range(int(a // width), int(b // width) + 1):
                at.setdefault(k, []).append(mine)
    return list(zip(chief, members, strict=True))


def merge_passes(passes: DataFrame, keys: list[str], bin_width: float) -> DataFrame:
    """Two transcripts of one recording: pass (a, or else b), start_s, end_s, reliable. Keeps a; adopts reliable lines of b that
    reliable lines of a cover less than half, and retires unreliable lines of a that an adopted one covers at least half.

    Neither step looks at its own results, so both are overlap joins.
    """
    rows = passes.select(*keys, "pass", "start_s", "end_s", "reliable").withColumn("_row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)  # the number must not change between the joins
    first, second = rows.where("pass = 'a'"), rows.where("pass <> 'a' and reliable")
    share = overlap_seconds(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s")) / F.greatest(F.lit(0.2), F.col("end_s") - F.col("start_s"))
    spans = lambda df: df.select(*keys, "start_s", "end_s")
    known = overlap_join(second, spans(first.where("reliable")), keys, bin_width).groupBy("_row").agg(F.sum(share).alias("known")).where("known >= 0.5")
    adopted = second.join(known.select("_row"), "_row", "left_anti")
    retired = overlap_join(first.where("not reliable"), spans(adopted), keys, bin_width).where(share >= 0.5).select("_row").distinct()
    return first.join(retired, "_row", "left_anti").union(adopted).drop("_row")


def sample_strata(df: DataFrame, strata: list[str], group: str, order: Column, n: int, parts: int = 64) -> DataFrame:
    """``n`` rows of each stratum, taken in turn from its groups.

    A stratum's groups are dealt to ``parts``, of which each can give ``n`` rows at most, so no task sees more of a
    stratum than its share or ``parts`` times ``n`` rows.
    """
    deep = df.withColumn("depth", F.row_number().over(Window.partitionBy(*strata, group).orderBy(order))).where(F.col("depth") <= n)  # deeper rows cannot be picked
    dealt = deep.withColumn("_part", F.pmod(F.xxhash64(group), F.lit(parts)))
    first = dealt.withColumn("_pick", F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("depth", group))).where(F.col("_pick") <= n).drop("_pick", "_part")
    return first.withColumn("pick", F.row_number().over(Window.partitionBy(*strata).orderBy("depth", group))).where(F.col("pick") <= n)

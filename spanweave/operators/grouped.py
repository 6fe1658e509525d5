"""Work on many small groups of rows at a time, without a Python call per group through Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Groups of a batch, as the table of their rows and where each begins.
Groups = Callable[[pa.Table, np.ndarray], pa.RecordBatch]


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin; nulls equal each other."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        a, b = table[k].slice(1), table[k].slice(0, max(0, n - 1))
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) if n > 1 else np.empty(0, bool)
        absent = table[k].is_null().to_numpy(zero_copy_only=False)
        new[1:] |= other.astype(bool) | (absent[1:] != absent[:-1])
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: list[str], order: list[str | Column], fn: Groups, schema: str) -> DataFrame:
    """Apply ``fn`` to whole groups of ``keys``, each sorted by ``order``, as many at a time as an Arrow batch holds.

    Groups are parted by a shuffle on the keys and sorted there; a group is held whole by the task that works on it,
    so it must be bounded: a block of frames, an island of findings.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            both = pa.concat_tables([held[0].slice(0, 1), table]) if held else table
            starts = starts_of(both, keys)
            # with a held row before, the batch's first group goes on unless it begins at row 1
            cut = int(starts[-1]) - bool(held)
            if len(starts) == 1 or cut < 0:
                held.append(table)
                continue
            whole = pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            yield fn(whole, starts_of(whole, keys))
            held = [table.slice(cut)]
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            yield fn(whole, starts_of(whole, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*columns).mapInArrow(run, schema)


def fold_groups(df: DataFrame, keys: list[str], order: list[str | Column], fn: Callable[[pa.Table, object], tuple[pa.RecordBatch, object]], schema: str) -> DataFrame:
    """Go through the rows of each group in order, a piece of it at a time: ``fn`` gets rows of one group and what it returned for the piece before (None at first).

    Nothing but that is held between pieces, so a group of any size streams through its task.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            goes_on = last is not None and len(starts_of(pa.concat_tables([last, table.slice(0, 1)]), keys)) == 1
            starts = starts_of(table, keys).tolist()
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], table.num_rows], strict=True)):
                out, state = fn(table.slice(a, b - a), state if k == 0 and goes_on else None)
                yield out
            last = table.slice(table.num_rows - 1)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*columns).mapInArrow(run, schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column as numpy values, nulls of numbers as NaN."""
    return table[name].to_numpy()

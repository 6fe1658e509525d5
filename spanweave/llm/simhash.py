"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 10).

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight positional
bytes. With the 2,048 pairs of position and byte in one order, the rarest first, two such fingerprints
share at least four of the six that come first in each: of the shared ones the first four have at most
two others before them. So the index posts a distinct fingerprint under the 15 sets of four of its six
rarest positional bytes, and whoever shares six bytes meets in some list. There the shared positional
bytes of each pair are tallied over all eight positions, pairs whose tally reaches six are retained, and
their differing bits are counted.

A list of more than ``SHORT_LIST`` fingerprints is not tallied pair by pair. Mappers post no more than that
and one of a list from a batch, and the members of long lists go to an index of their own, under the 28 sets
of six positional bytes: there a list is its pairs' tally, and, as it leaves two bytes open, holds at most
65,536 fingerprints, in which partners are found by looking up the 136 differences of one or two bits. Of
these only a spanning forest is kept, so the links of a group stay linear in its size.

Components of the links are found by alternating large and small stars; the smallest neighbour is joined back
on unique keys, so adaptive execution can split a hub's neighbourhood.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link
like others; a null doc_id takes part but never names a component that has other ids; repeated rows
each return their row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpoint, map_texts

SHINGLE, SEED, MAX_BITS = 3, 42, 2
BYTES = 8
#: Shared positional bytes of fingerprints at most MAX_BITS apart, at least; how many of the first ones a list is made of.
LEAST_SHARED, LISTED = BYTES - MAX_BITS, 4
SETS = np.array(list(combinations(range(MAX_BITS + LISTED), LISTED)))
#: Longest list whose pairs are tallied one by one.
SHORT_LIST = 32
OPEN_BYTES = list(combinations(range(BYTES), MAX_BITS))
#: The differences of one or two bits within two bytes.
NEAR = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], np.int64)
SIGN = np.iinfo(np.int64).min


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a slice at a time: eight bytes become 64
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp of every row, and the columns to carry."""

    def batch(ids: list, texts: list, *rest: list) -> dict:
        return {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts]} | dict(zip(carry, rest, strict=True))

    further = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col), *carry), batch, f"doc_id long, fp long{further}")


def positional(fp: np.ndarray) -> np.ndarray:
    """The numbers of each fingerprint's (position, byte) pairs, 256 times the position plus the byte."""
    place = np.arange(BYTES)
    return (fp[:, None] >> 8 * place & 255) + 256 * place


def byte_ranks(distinct: DataFrame) -> np.ndarray:
    """The place of every (position, byte) in the order by frequency, the rarest first; 2,048 counts pass the driver."""
    pairs = F.explode(F.array(*(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) + 256 * p for p in range(BYTES))))
    counts, rank = np.zeros(256 * BYTES, np.int64), np.empty(256 * BYTES, np.int64)
    for pair, n in distinct.select(pairs.alias("pair")).groupBy("pair").count().collect():
        counts[pair] = n
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return rank


def lists_of(fp: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The lists of each fingerprint: which positions, above bit 32, and their bytes."""
    pairs = positional(fp)
    first = np.argsort(rank[pairs], axis=1)[:, : MAX_BITS + LISTED]
    places = np.sort(first[:, SETS], axis=2)
    byte = np.take_along_axis(np.broadcast_to(pairs[:, None, :] & 255, (len(fp), len(SETS), BYTES)), places, axis=2)
    out = (1 << places).sum(axis=2)
    for k in range(LISTED):
        out = out << 8 | byte[:, :, k]
    return out


def _runs(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal numbers."""
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(number)])


def posts(batches: Iterator[pd.DataFrame], rank: np.ndarray) -> Iterator[pd.DataFrame]:
    """(list, fp); of lists that are long in the batch one more than SHORT_LIST, and their members also under negative numbers."""
    for pdf in batches:
        fp = pdf["fp"].to_numpy(np.int64)
        number, who = lists_of(fp, rank).ravel(), np.repeat(fp, len(SETS))
        order = np.argsort(number, kind="stable")
        number, who = number[order], who[order]
        starts, size = _runs(number)
        place = np.arange(len(number)) - np.repeat(starts, size)
        long = np.unique(who[np.repeat(size, size) > SHORT_LIST])
        few = place <= SHORT_LIST
        yield pd.DataFrame({"list": np.r_[number[few], long | SIGN], "fp": np.r_[who[few], long]})


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of short lists with the positional bytes they share, if these reach LEAST_SHARED; members of long lists as a with shared -1.

    Rows come sorted by list; a list may go on in the next batch, of which at most SHORT_LIST rows are held.
    """
    open_list, held, long_list = None, np.empty(0, np.int64), None
    for pdf in _with_end(batches):
        last = pdf is None
        number, fp = (np.empty(0, np.int64),) * 2 if last else (pdf[c].to_numpy(np.int64) for c in ("list", "fp"))
        if len(held):
            number, fp = np.r_[np.full(len(held), open_list), number], np.r_[held, fp]
        starts, size = _runs(number)
        long = (size > SHORT_LIST) | (number[starts] < 0) | (number[starts] == (SIGN if long_list is None else long_list))
        held = np.empty(0, np.int64)
        if not last and len(starts):
            open_list = int(number[-1])
            if long[-1]:
                long_list = open_list
            else:
                held, starts, size, long = fp[starts[-1] :], starts[:-1], size[:-1], long[:-1]
        pairs = [np.empty((0, 2), np.int64)]
        for s in np.unique(size[~long & (size > 1)]).tolist():
            rows = starts[~long & (size == s)][:, None] + np.arange(s)
            i, j = np.triu_indices(s, 1)
            pairs.append(np.c_[fp[rows[:, i]].ravel(), fp[rows[:, j]].ravel()])
        a, b = np.concatenate(pairs).T
        shared = ((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        met = shared >= LEAST_SHARED
        members = fp[: int(size.sum())][np.repeat(long, size)]
        yield pd.DataFrame({"a": np.r_[a[met], members], "b": np.r_[b[met], members], "shared": np.r_[shared[met], np.full(len(members), -1)].astype(np.int32)})


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def near_pairs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes (list << 16 | two bytes) whose lists are equal and whose bytes differ in one or two bits."""
    order = np.argsort(code)
    ordered = code[order]
    left, right = [], []
    for change in NEAR.tolist():
        other = code ^ change
        at = np.minimum(np.searchsorted(ordered, other), len(code) - 1)
        hit = np.flatnonzero((ordered[at] == other) & (code < other))
        left.append(hit)
        right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars (a, b) that span what is near in each list of six bytes (which, key); rows come sorted, the last list, at most 65,536 rows, is held."""
    held = None
    for pdf in _with_end(batches):
        rows = [x for x in (held, pdf) if x is not None and len(x)]
        if not rows:
            continue
        both = pd.concat(rows, ignore_index=True)
        which, key, fp = (both[c].to_numpy(np.int64) for c in ("which", "key", "fp"))
        starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])])
        stop = len(fp) if pdf is None else int(starts[-1])
        held = both.iloc[stop:]
        fp, lists = fp[:stop], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(fp)]))[:stop]
        if not len(fp):
            continue
        x, y = np.array(OPEN_BYTES)[which[:stop]].T
        a, b = near_pairs(lists << 16 | (fp >> 8 * x & 255) | (fp >> 8 * y & 255) << 8)
        label = np.arange(len(fp))
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = low[low]
            if (low == label).all():
                break
            label = low
        at = np.flatnonzero(label != np.arange(len(label)))
        yield pd.DataFrame({"a": fp[label[at]], "b": fp[at]})


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that span every component of the distinct fingerprints in column fp."""
    rank = byte_ranks(distinct)
    index = distinct.select("fp").mapInPandas(lambda b: posts(b, rank), "list long, fp long").repartition("list").sortWithinPartitions("list", "fp")
    tallied = checkpoint(index.mapInPandas(_tally, "a long, b long, shared int"))
    retained = tallied.where((F.col("shared") >= LEAST_SHARED) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    crowded = tallied.where("shared = -1").select(F.col("a").alias("fp")).distinct()
    six = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(signed((1 << 64) - 1 ^ 255 << 8 * x ^ 255 << 8 * y))).alias("key")) for i, (x, y) in enumerate(OPEN_BYTES))))
    lists = crowded.select("fp", six.alias("p")).select("p.which", "p.key", "fp").repartition("which", "key").sortWithinPartitions("which", "key", "fp")
    return retained.union(lists.mapInPandas(_forest, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of every node that has a link.

    Each round replaces the neighbours' links by links to the smallest of them. The smallest
    neighbour is an aggregate joined back, so that no neighbourhood is gathered in one task.
    """
    edges, before = checkpoint(edges.select("a", "b")), None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpoint(large)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and the columns to carry, one row per row of ``docs``."""
    each = checkpoint(fingerprints(docs, id_col, text_col, carry))
    distinct = checkpoint(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = checkpoint(rooted.join(named, "root").select("fp", "component_id"))
    return each.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carry)

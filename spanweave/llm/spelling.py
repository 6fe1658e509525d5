"""Spelling variants by forward and reversed sorted dictionaries (operator 11).

One edit leaves one half of a word intact. A dictionary sorted forward has the words that share a first half as one
range, the reversed dictionary those that share a last half. A block is such a range for one class of lengths: the
words of ``size`` and of ``size`` + 1 characters that share ``head`` first and ``tail`` last characters. Blocks of at
most ``SMALL`` words are scanned and each pair is verified. Larger ones are subdivided: the one edit lies in the middle
that the block leaves open, so one half of that middle is intact too, and the block's words go to one block that also
shares the left half and one that also shares the right half, in a further round. When at most one character is left
open, a block holds every pair it could and, at one or two letters a word, some 8,000 words at most.

A pair goes left wherever it shares the left half and right otherwise (``below`` bounds its common prefix), so it is
verified in exactly one block of its class, and a block can return counts and best partners of its words instead of
pairs. Blocks are keyed by hashes; verification compares the words themselves, so a collision only adds comparisons.

A form has at least ``ratio`` times the occurrences of its word, so chains of forms are short, and roots follow from a
few joins that double pointers.

Defined results: a null text has no words, a null doc_id is an empty one where occurrences are damaged; repeated rows
count each; equal counts give the form that is smallest in code-point order; empty tables and tables without frequent
words give empty results; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint, materialize, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Characters of a text that are split at a time, and characters of counted words that a task holds.
PIECE, HELD = 1 << 20, 1 << 23
#: Largest block that is scanned while it can be subdivided; pairs compared at a time; longest word compared in arrays.
SMALL, PAIRS, WIDE = 32, 1 << 17, 64


def pieces(text: str) -> Iterator[str]:
    """``text`` in parts of about PIECE characters that cut no run."""
    at = 0
    while at < len(text):
        cut = at + PIECE
        rest = RUN.match(text, cut) if cut < len(text) else None
        cut = rest.end() if rest else cut
        yield text[at:cut]
        at = cut


def runs(doc_id: int | None, text: str, damage: int | None) -> Counter:
    """Lower-cased runs of a piece of text with their counts; where ``damage`` divides a run's checksum in its document, one code point is deleted."""
    found = Counter(RUN.findall(text.encode().translate(LOWER).decode()))
    if damage:
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        sums = {run: zlib.crc32(run.encode(), start) for run in found}
        hit = [(run, h % len(run), found.pop(run)) for run, h in sums.items() if h % damage == 0]
        for run, at, n in hit:
            found[run[:at] + run[at + 1 :]] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words of ``min_length`` code points that occur ``min_count`` times; tasks add up occurrences before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = Counter(), 0
        for batch in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for piece in pieces(text or ""):
                    found = runs(doc_id, piece, damage)
                    held.update(found)
                    chars += sum(map(len, found))
                    if chars > HELD:
                        yield rows(held)
                        held, chars = Counter(), 0
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        kept = {w: n for w, n in held.items() if len(w) >= min_length}
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    each = bounded(docs.select(F.col(id_col).cast("long"), F.col(text_col))).mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _subdivide(rows: DataFrame) -> DataFrame:
    """Each row in the block that also shares the left half of the open middle and in that which also shares the right half."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")

    def child(head: Column, tail: Column, below: Column, bit: int) -> Column:
        return F.struct(head.alias("head"), tail.alias("tail"), below.alias("below"), (F.col("path") * 2 + bit).alias("path"))

    left = child(F.col("head") + half, F.col("tail"), F.col("below"), 0)
    right = child(F.col("head"), F.col("tail") + half, F.least("below", F.col("head") + half), 1)
    made = rows.select("word", "n", "size", F.explode(F.array(left, right)).alias("c")).select("word", "n", "size", "c.*")
    forward = F.substr("word", F.lit(1), F.col("head"))
    reversed_ = F.substr(F.reverse("word"), F.lit(1), F.col("tail"))
    return made.withColumn("key", F.xxhash64("size", "path", forward, reversed_))


def _lcp(a: str, b: str) -> int:
    """Length of the common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class _Block:
    """Rows of whole blocks as arrays, and which of their pairs are near."""

    def __init__(self, cols: dict[str, list]) -> None:
        self.words = cols["word"]
        self.n, self.size, self.path, self.head, self.below = (np.array(cols[c], np.int64) for c in ("n", "size", "path", "head", "below"))
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.wide = self.length > WIDE
        short = [w if len(w) <= WIDE else "" for w in self.words]
        width = max(1, max(map(len, short), default=1))
        self.forward, self.backward = (np.array(x, f"U{width}").view(np.uint32).reshape(len(x), width) for x in (short, [w[::-1] for w in short]))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each pair has one edit and belongs to its block."""
        size = self.size[i]
        ok = (size == self.size[j]) & (self.path[i] == self.path[j]) & (np.minimum(self.length[i], self.length[j]) == size)
        ok = np.flatnonzero(ok)
        i, j, size = i[ok], j[ok], size[ok]
        lcp, lcs = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        plain = ~(self.wide[i] | self.wide[j])
        a, b = i[plain], j[plain]
        lcp[plain] = (self.forward[a] != self.forward[b]).argmax(axis=1)
        lcs[plain] = (self.backward[a] != self.backward[b]).argmax(axis=1)
        for k in np.flatnonzero(~plain).tolist():
            v, w = self.words[i[k]], self.words[j[k]]
            lcp[k], lcs[k] = _lcp(v, w), _lcp(v[::-1], w[::-1])
        replaced = self.length[i] == self.length[j]
        hit = (lcp + lcs >= size - replaced) & (lcp >= self.head[i]) & (lcp < self.below[i])
        return ok[hit]


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within runs, at most about PAIRS at a time."""
    for s in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == s]
        i, j = np.triu_indices(s, 1)
        blocks = max(1, PAIRS // len(i))
        for k in range(0, len(at), blocks):
            for m in range(0, len(i), PAIRS):
                yield (at[k : k + blocks, None] + i[m : m + PAIRS]).ravel(), (at[k : k + blocks, None] + j[m : m + PAIRS]).ravel()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near (partners in its block), best_n and best of rows sorted by key; the last block of a batch is held, and blocks are small."""
    held: pa.Table | None = None
    for batch in _tail(batches):
        rows = [x for x in (held, None if batch is None else pa.Table.from_batches([batch])) if x is not None and x.num_rows]
        if not rows:
            continue
        table = pa.concat_tables(rows).combine_chunks()
        key = table["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        stop = len(key) if batch is None else int(starts[-1])
        held, whole = table.slice(stop), table.slice(0, stop)
        starts = starts[starts < stop]
        if not stop:
            continue
        block = _Block({c: whole[c].to_pylist() for c in ("word", "n", "size", "path", "head", "below")})
        who, other = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in _pairs(starts, np.diff(np.r_[starts, stop])):
            hit = block.near(i, j)
            who += [i[hit], j[hit]]
            other += [j[hit], i[hit]]
        who, other = np.concatenate(who), np.concatenate(other)
        rank = np.empty(stop, np.int64)
        rank[sorted(range(stop), key=block.words.__getitem__)] = np.arange(stop)
        order = np.lexsort((rank[other], -block.n[other], who))
        who, other = who[order], other[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(who)])
        words = np.array(block.words, object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[who[first]], pa.string()), pa.array(count, pa.int64()), pa.array(block.n[other[first]], pa.int64()), pa.array(words[other[first]], pa.string())],
            ["word", "near", "best_n", "best"],
        )


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from slices(batches)
    yield None


def neighbours(words: DataFrame, small: int = SMALL) -> DataFrame:
    """word, n_near, and best with best_n (the near word of largest n) of the words that have near words; ``words`` has word and n, each word once."""
    length = F.length("word")
    start = words.select("word", "n", F.explode(F.array(length - 1, length)).alias("size"))
    rows = start.select("*", *(F.lit(v).cast(t).alias(c) for c, v, t in (("head", 0, "int"), ("tail", 0, "int"), ("path", 1, "long"))), (F.col("size") + 2).alias("below"))
    found = None
    while True:
        posted = materialize(_subdivide(rows))
        sizes = materialize(posted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
        shared = posted.join(sizes, "key")
        large = (F.col("members") > small) & (F.col("size") - F.col("head") - F.col("tail") > 1)
        blocks = shared.where(~large).select("key", "word", "n", "size", "path", "head", "below").repartition("key").sortWithinPartitions("key", "word")
        part = bounded(blocks).mapInArrow(_scan, "word string, near long, best_n long, best string")
        found = part if found is None else found.union(part)
        if sizes.where(F.col("members") > small).isEmpty():
            break
        rows = materialize(shared.where(large).drop("key", "members"))
        if rows.isEmpty():
            break
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word and root of rows (word, form) whose chains have at most ``steps`` links: each round follows the pointers of the pointers."""
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    for _ in range(ceil(log2(max(steps, 1)))):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = checkpoint(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None, ratio: int = RATIO, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word of ``docs``."""
    words = materialize(word_counts(docs, id_col, text_col, damage, min_length, min_count))
    near = neighbours(words)
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    most = formed.agg(F.max("form_n")).first()[0]
    if most is None:
        return formed.select("word", "form", F.col("word").alias("root"), "n", "n_near", "form_n")
    rooted = roots(formed.where("form IS NOT NULL"), ceil(log(max(most / min_count, ratio), ratio)) + 1)
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

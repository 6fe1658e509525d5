"""Repeated passages by a compacted de Bruijn graph of token k-mers (operator 4).

Every run of ``WINDOW`` words that also starts in a document with a smaller doc_id is removed. These
k-mers are the graph's edges, each from the node of its first to that of its last ``WINDOW - 1`` words.

Runs of consecutive edges that share their minimizer, the ``MINIMIZER`` words in them with the least
hash, are cut from the documents as super-k-mers, known by their coordinates and a digest. Equal edges
have equal minimizers, so the graph falls into a bucket per minimizer, and buckets that one document
alone reaches hold no repeat. In a bucket with one distinct super-k-mer all inner nodes have one way in
and one way out: it is a path already. Others branch and are opened, each distinct super-k-mer once,
from the text at its coordinates, into edges, which an aggregate and a join tell apart.

Paths of different buckets meet at a node that does not branch where every occurrence of the one goes on
to the other and every occurrence of the other comes from it, by counts of occurrences and of arcs, and
where their first occurrences follow each other, too. Such arcs are contracted by joins that double the
distance of each path's pointer to its head, so a path of any length takes logarithmically many rounds.
An occurrence of a compacted path in a document with a larger doc_id than its first one is a repeat as a
whole. Spans that continue each other at both coordinates are merged, and each is removed only if the
words at its own coordinates and those at its source have one BLAKE2b digest, in which no rolling hash
takes part.

Super-k-mers are aggregated (least and largest document, agreement, count) before they are joined back
on unique keys, so no group of copies is gathered in one task and adaptive execution can split a hot key;
what is collected is bounded by one document. Texts move only to open super-k-mers, to read sources and
to be cut; a bitmap of fixed size spares most others the way, and costs nothing but that when it is full.

Defined results: a null text has no words; a null doc_id counts as larger than all others; rows with
one doc_id are one document and never each other's source; fewer than ``WINDOW`` words are kept;
repeated rows each return their row; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import bounded, checkpoint, materialize, slices, words

WINDOW, MINIMIZER = 50, 16
#: Bits of the map of documents whose texts must move: 2 MiB, whatever the corpus.
MAP_BITS = 1 << 24
LAST = (1 << 63) - 1
#: Odd multipliers of the two rolling hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretch of a word sequence, twice 64 bits."""

    def __init__(self, w: list[bytes]):
        hashes = np.fromiter(map(xxh64_intdigest, w, repeat(0)), np.uint64, len(w))
        self.back, self.sums = [], []
        for base, inverse in zip(BASES, INVERSES, strict=True):
            self.back.append(_powers(inverse, len(w) + 1))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(w)), dtype=np.uint64)]))

    def digest(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.sums[which][stop] - self.sums[which][start]) * self.back[which][start]
        x ^= (stop - start).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ x >> np.uint64(33)


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of its least one, the leftmost of equals."""
    at, span = np.arange(len(hashes)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step] if step else at, at[step:]
        at = np.where(hashes[right] < hashes[left], right, left)
        span += step
    return at


def super_kmers(w: list[bytes]) -> tuple[np.ndarray, ...]:
    """Minimizer hash, first window, number of windows and two digests of every super-k-mer of a document."""
    if len(w) < WINDOW:
        return (np.empty(0, np.int64),) * 5
    rolling = Rolling(w)
    k = np.arange(len(w) - MINIMIZER + 1)
    hashes = rolling.digest(0, k, k + MINIMIZER)
    at = least_places(hashes, WINDOW - MINIMIZER + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    many = np.diff(np.r_[first, len(at)])
    stop = first + many - 1 + WINDOW
    return hashes[at[first]].view(np.int64), first, many, *(rolling.digest(i, first, stop).view(np.int64) for i in (0, 1))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kmer", "d", "rid", "pos", "n", "b1", "b2"]
    for batch in slices(batches):
        d, rid = (batch.column(i).to_numpy() for i in (0, 1))
        found = [super_kmers(words(t)) for t in batch.column(2).to_pylist()]
        size = [len(x[0]) for x in found]
        kmer, pos, n, b1, b2 = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5
        columns = [kmer, np.repeat(d, size), np.repeat(rid, size), pos.astype(np.int32), n.astype(np.int32), b1, b2]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


#: A super-k-mer has at most WINDOW - MINIMIZER + 1 windows, so its number and a window's in it fit one long.
REF_BITS = 6


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the super-k-mers given for each text: two digests, document and number."""
    for batch in slices(batches):
        rows = []
        for d, text, given in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rolling = Rolling(words(text))
            pos, n, number = (np.array([e[k] for e in given], np.int64) for k in ("pos", "n", "number"))
            j = np.concatenate([np.arange(x) for x in n])
            start = np.repeat(pos, n) + j
            w1, w2 = (rolling.digest(i, start, start + WINDOW).view(np.int64) for i in (0, 1))
            rows.append((w1, w2, np.full(len(j), d, np.int64), np.repeat(number << REF_BITS, n) + j))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w1", "w2", "d", "ref"])


SPAN = "pos int, n int, sd long, srid long, spos int"


def merged_spans(spans: list[dict]) -> list[list[int]]:
    """Spans (pos, n, sd, srid, spos) of one document, those that continue each other here and at the source as one."""
    out: list[list[int]] = []
    for pos, n, *source, spos in sorted([s["pos"], s["n"], s["sd"], s["srid"], s["spos"]] for s in spans):
        last = out[-1] if out else None
        if last and pos == last[0] + last[1] and source == last[2:4] and spos == last[4] + last[1]:
            last[1] += n
        elif not last or pos > last[0]:  # repeated rows give their spans repeatedly
            out.append([pos, n, *source, spos])
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(d, rid, *s) for d, rid, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for s in merged_spans(spans)]
        columns = zip(*rows, strict=True) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["d", "rid", "pos", "n", "sd", "srid", "spos"])


def spelled(w: list[bytes], pos: int, n: int) -> bytes:
    """A digest of the words that ``n`` windows from ``pos`` on cover."""
    return hashlib.blake2b(b" ".join(w[pos : pos + n - 1 + WINDOW]), digest_size=16).digest()


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the spans that are asked of each text."""
    for batch in slices(batches):
        rows = []
        for d, rid, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            w = words(text)
            rows += [(d, rid, s["pos"], s["n"], spelled(w, s["pos"], s["n"])) for s in asked]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sd", "srid", "spos", "n", "said"])


def _kept(w: list[bytes], spans: list[dict] | None) -> tuple[int, str]:
    """Words removed, which are those of spans that read as their sources do, and the digest of those kept."""
    gone = np.zeros(len(w) + 1, np.int64)
    for s in spans or []:
        if spelled(w, s["pos"], s["n"]) == s["said"]:
            gone[s["pos"]] += 1
            gone[s["pos"] + s["n"] - 1 + WINDOW] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    left = [x for x, g in zip(w, gone.tolist(), strict=True) if not g] if gone.any() else w
    return int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest()


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        spans = columns[2] if len(columns) > 2 else repeat(None, len(columns[0]))
        n, removed, sha = [], [], []
        for text, s in zip(columns[1], spans, strict=True):
            w = words(text)
            n.append(len(w))
            gone, digest = _kept(w, s)
            removed.append(gone)
            sha.append(digest)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def document_map(keys: DataFrame) -> np.ndarray:
    """A bitmap over hashes of (d, rid), as 64-bit words; at most MAP_BITS bits pass the driver."""
    bit = F.pmod(F.xxhash64("d", "rid"), F.lit(MAP_BITS))
    found = keys.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def mapped(base: DataFrame, bits: np.ndarray, inside: bool, *columns: str) -> DataFrame:
    """Rows of ``base`` whose bit is set, or those whose bit is not."""
    held = base.sparkSession.sparkContext.broadcast(bits)  # MAP_BITS / 8 bytes

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy()
            there = (held.value[bit >> 6] >> (bit & 63) & 1) == 1
            yield batch.select(range(1, batch.num_columns)).filter(pa.array(there == inside))

    picked = base.select(F.pmod(F.xxhash64("d", "rid"), F.lit(MAP_BITS)).alias("bit"), *columns)
    return picked.mapInArrow(choose, picked.drop("bit").schema)


def contract(arcs: DataFrame) -> DataFrame:
    """node, head and windows between them for every node behind another on a path; ``arcs``: node, head (the one before), far (its windows).

    Each round replaces a pointer by its target's own, so the distance doubles; arcs go forward in one document and form no ring.
    """
    at = checkpoint(arcs.select("node", "head", "far", F.lit(True).alias("more")))
    while at.agg(F.bool_or("more")).first()[0]:
        onward = at.select(F.col("node").alias("head"), F.col("head").alias("beyond"), F.col("far").alias("further"))
        # pointers that have arrived find nothing beyond; a union of them would add its partitions in every round
        at = checkpoint(at.join(onward, "head", "left").select("node", F.coalesce("beyond", "head").alias("head"), (F.col("far") + F.coalesce("further", F.lit(0))).alias("far"), F.col("beyond").isNotNull().alias("more")))
    return at.select("node", "head", "far")


def path_spans(whole: DataFrame) -> DataFrame:
    """Repeats among super-k-mers that are alone in their buckets (kmer, d, rid, pos, n, many), as spans of compacted paths."""
    node = checkpoint(whole.groupBy("kmer").agg(F.min(F.struct("d", "rid", "pos")).alias("at"), F.max("n").alias("n")))
    following = F.lead(F.struct("kmer", "pos", "many")).over(Window.partitionBy("d", "rid").orderBy("pos"))
    met = whole.select("kmer", "d", "rid", "pos", "n", "many").withColumn("then", following).where((F.col("then.pos") == F.col("pos") + F.col("n")) & (F.col("then.many") == F.col("many")))
    single = met.groupBy("kmer", F.col("then.kmer").alias("node"), "many").agg(F.count(F.lit(1)).alias("both")).where("both = many")
    here = node.select(F.col("kmer"), F.col("at").alias("from"), F.col("n").alias("far"))
    there = node.select(F.col("kmer").alias("node"), F.col("at").alias("to"))
    goes_on = (F.col("from.d") == F.col("to.d")) & (F.col("from.rid") == F.col("to.rid")) & (F.col("to.pos") == F.col("from.pos") + F.col("far"))
    paths = contract(single.join(here, "kmer").join(there, "node").where(goes_on).select("node", F.col("kmer").alias("head"), "far"))
    length = paths.join(node.select(F.col("kmer").alias("node"), "n"), "node").groupBy(F.col("head").alias("kmer")).agg(F.max(F.col("far") + F.col("n")).alias("total"))
    heads = node.join(paths.select(F.col("node").alias("kmer")), "kmer", "left_anti").join(length, "kmer", "left").select("kmer", "at", F.coalesce("total", "n").alias("n"))
    return whole.select("kmer", "d", "rid", "pos").join(heads, "kmer").where("d > at.d").select("d", "rid", "pos", "n", F.col("at.d").alias("sd"), F.col("at.rid").alias("srid"), F.col("at.pos").alias("spos"))


def branch_spans(base: DataFrame, branching: DataFrame) -> DataFrame:
    """Repeats among super-k-mers of buckets that branch (kmer, b1, b2, d, rid, pos, n): whole ones as their first occurrence, the first one's windows one by one."""
    edge = ["kmer", "b1", "b2"]
    first = F.min(F.struct("d", "rid", "pos", "n")).alias("at")
    distinct = checkpoint(branching.groupBy(*edge).agg(first).select(*edge, "at.*", F.monotonically_increasing_id().alias("number")))
    wanted = checkpoint(distinct.groupBy("d", "rid").agg(F.collect_list(F.struct("pos", "n", "number")).alias("given")))
    texts = mapped(base, document_map(wanted), True, "d", "rid", "text")
    windows = materialize(texts.join(wanted, ["d", "rid"]).select("d", "text", "given").mapInArrow(_open, "w1 long, w2 long, d long, ref long"))
    least = checkpoint(windows.groupBy("w1", "w2").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.min_by("ref", "d").alias("source")).where("least < most").drop("most"))
    number, place = (lambda c: F.shiftright(c, REF_BITS)), (lambda c: F.col(c).bitwiseAND((1 << REF_BITS) - 1).cast("int"))
    hit = windows.join(least, ["w1", "w2"]).where("least < d").select(number("ref").alias("number"), place("ref").alias("j"), number("source").alias("owner"), place("source").alias("sj"))
    owners = distinct.select(F.col("number").alias("owner"), F.col("d").alias("sd"), F.col("rid").alias("srid"), F.col("pos").alias("sp"))
    found = hit.join(owners, "owner").groupBy("number").agg(F.collect_list(F.struct("j", F.lit(1).alias("n"), "sd", "srid", (F.col("sp") + F.col("sj")).alias("spos"))).alias("found"))
    judged = checkpoint(distinct.select(*edge, "number", F.struct("d", "rid", "pos").alias("first")).join(found, "number", "left").drop("number"))
    later = F.struct(F.lit(0).alias("j"), "n", F.col("first.d").alias("sd"), F.col("first.rid").alias("srid"), F.col("first.pos").alias("spos"))
    opened = branching.join(judged, edge).select("d", "rid", "pos", F.explode(F.when(F.col("d") > F.col("first.d"), F.array(later)).otherwise(F.col("found"))).alias("x"))
    return opened.select("d", "rid", (F.col("pos") + F.col("x.j")).alias("pos"), "x.n", "x.sd", "x.srid", "x.spos")


def repeated_spans(base: DataFrame) -> DataFrame:
    """d, rid and spans (pos, n, said: the digest of the source's words) of every document with repeated windows."""
    found = materialize(base.select("d", "rid", "text").mapInArrow(_find, "kmer long, d long, rid long, pos int, n int, b1 long, b2 long"))
    agree = (F.min("b1") == F.max("b1")) & (F.min("b2") == F.max("b2"))
    repeated = found.groupBy("kmer").agg(F.min("d").alias("least"), F.max("d").alias("most"), agree.alias("whole"), F.count(F.lit(1)).alias("many")).where("least < most")
    met = materialize(found.join(checkpoint(repeated.select("kmer", "whole", "many")), "kmer"))
    spans = path_spans(met.where("whole")).union(branch_spans(base, met.where("not whole")))
    grouped = spans.groupBy("d", "rid").agg(F.collect_list(F.struct("pos", "n", "sd", "srid", "spos")).alias("spans"))
    merged = materialize(grouped.mapInArrow(_merge, f"d long, rid long, {SPAN}"))
    asked = checkpoint(merged.select(F.col("sd").alias("d"), F.col("srid").alias("rid"), F.col("spos").alias("pos"), "n").distinct().groupBy("d", "rid").agg(F.collect_list(F.struct("pos", "n")).alias("asked")))
    sources = mapped(base, document_map(asked), True, "d", "rid", "text").join(asked, ["d", "rid"])
    said = sources.select("d", "rid", "text", "asked").mapInArrow(_spell, "sd long, srid long, spos int, n int, said binary")
    return checkpoint(merged.join(said, ["sd", "srid", "spos", "n"]).groupBy("d", "rid").agg(F.collect_list(F.struct("pos", "n", "said")).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, one row per row of ``docs``."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    base = bounded(docs).select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LAST)).alias("d"), F.xxhash64(text).alias("rid"), text.alias("text"))
    spans = repeated_spans(base)
    bits = document_map(spans)
    clean = mapped(base, bits, False, "doc_id", "text").mapInArrow(_cut, RESULT)
    hit = mapped(base, bits, True, "d", "rid", "doc_id", "text").join(spans, ["d", "rid"], "left")
    return clean.union(hit.select("doc_id", "text", "spans").mapInArrow(_cut, RESULT))

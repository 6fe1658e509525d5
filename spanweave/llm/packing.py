"""Best-fit packing by non-negative least squares over length patterns (operator 1).

Documents become token ids with an end id and are cut into pieces of at most ``SEQUENCE`` tokens. The
histogram of piece lengths has at most ``SEQUENCE`` bars whatever the corpus. Over it, patterns of one
to three lengths that fill a sequence exactly are enumerated, their repeat counts fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best-fit
decreasing, on counts too. The resulting layout says where the r-th piece of each length goes; pieces
get their rank by windows over (length, salt) plus the counts of lower salts, so no length, however
common, is gathered in one task. At most some 350,000 patterns exist for 2,048 tokens, so all are
enumerated, once per corpus.

Defined results: a null text is an empty one (the end id alone); the length of a piece is at least
one; repeated rows are packed once each; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, checkpoint, slices

SEQUENCE, END_ID = 2048, 0
#: Rows of pieces for each salt, once there are more salts than shuffle partitions.
SALT_ROWS = 20_000
#: Words met once, and met again, whose ids a worker remembers; it starts afresh beyond.
CACHED_WORDS = 300_000
#: Steps of the least-squares fit.
FIT_STEPS = 300
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Lower-case words of Latin letters, and where a symbol follows a letter: the vocabulary's own rule parts texts there.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
TAIL = re.compile("(?<=[a-zß-öø-ÿ])(?=[!-/:-@\\[-`{-~])")


#: The rule by which the vocabulary parts texts into words; what is below relies on it.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def refuse_other_vocabularies(path: str, spec: dict) -> None:
    """Raise unless the vocabulary is lower-cased BPE with an end-of-word mark, parted by ``WORD_RULE``."""
    model, normal, first = spec["model"], spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or not plain:
        raise ValueError(f"{path}: only BPE with the end-of-word mark </w> is supported")
    if [n["type"] for n in normal.get("normalizers", ())] != ["NFC", "Replace", "Lowercase"]:
        raise ValueError(f"{path}: only texts brought to NFC, white space to spaces and lower case are supported")
    if [p.get("type") for p in first] != ["Split", "ByteLevel"] or first[0]["pattern"] != {"Regex": WORD_RULE}:
        raise ValueError(f"{path}: only words parted by {WORD_RULE} are supported")


class WordEncoder:
    """Ids of texts for a vocabulary whose merges end at white space, as little-endian unsigned 32-bit bytes.

    Texts of Latin-1 without special tokens are lower-cased and parted between letter and symbol first, as
    the vocabulary would do itself, so that fewer distinct words remain. Each distinct word is encoded once
    and remembered from its second occurrence on; words of letters go many in one call, whose ids are
    parted at the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # lower-case letters need neither the normaliser nor the pattern
        light = json.loads(self.tokenizer.to_str())
        refuse_other_vocabularies(path, light)
        stages = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]
        self.plain = Tokenizer.from_str(json.dumps(light | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": stages}}))
        self.words: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        letters, other = [], []
        for w in new:
            (letters if PLAIN.fullmatch(w) else other).append(w)
        for at in range(0, len(letters), 2048):
            part = letters[at : at + 2048]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            raw = ids.tobytes()
            out.update(zip(part, (raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        encoded = self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else []
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, encoded, strict=True))
        return out

    def _resolve(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered; those met before are from now on."""
        again = missing & self.once.keys()
        out = {w: self.once.pop(w) for w in again}
        if len(self.words) + len(out) > CACHED_WORDS:
            self.words.clear()
        self.words.update(out)
        fresh = self._learn(list(missing - again))
        if len(self.once) + len(fresh) > CACHED_WORDS:
            self.once.clear()
        self.once.update(fresh)
        out.update(fresh)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            t = t.replace("\n", " ")
            if "<|" not in t and _latin(t):
                t = TAIL.sub(" ", t.lower())
            split.append(t.split(" "))
        found = [list(map(self.words.get, w)) for w in split]
        missing = {x for w, f in zip(split, found, strict=True) if None in f for x, y in zip(w, f, strict=True) if y is None}
        new = self._resolve(missing) if missing else {}
        return [b"".join(f if None not in f else [new[x] if y is None else y for x, y in zip(w, f, strict=True)]) for w, f in zip(split, found, strict=True)]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
    return WordEncoder(path)


def cut(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in slices(batches):
            rows: list[tuple] = []
            ids, texts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(ids), 64):
                for doc, raw in zip(ids[at : at + 64], encoder.encode([t or "" for t in texts[at : at + 64]]), strict=True):
                    raw += END_ID.to_bytes(4, "little")
                    for k, start in enumerate(range(0, len(raw), 4 * SEQUENCE)):
                        part = raw[start : start + 4 * SEQUENCE]
                        rows.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part)))
            doc, k, start, n, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


def patterns(counts: np.ndarray) -> np.ndarray:
    """Up to three lengths that are present and add up to a full sequence, zeros where fewer; counts[n]: pieces of length n."""
    full = len(counts) - 1
    there = np.flatnonzero(counts)
    two = np.array([(full - a, a, 0) for a in there if 2 * a <= full and counts[full - a]], np.int64).reshape(-1, 3)
    three = []
    for a in there.tolist():
        b = there[(there >= a) & (full - a - there >= there)]
        b = b[counts[full - a - b] > 0]
        three.append(np.c_[full - a - b, b, np.full(len(b), a)])
    one = np.array([(full, 0, 0)] if counts[full] else [], np.int64).reshape(-1, 3)
    return np.concatenate([one, two, *three]).astype(np.int64)


def fit(counts: np.ndarray, pats: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring pattern use close to the histogram: min |A x - counts|², by accelerated projected gradient."""
    n, parts = len(counts), [np.ascontiguousarray(pats[:, k]) for k in range(3)]

    def use(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(p, x, minlength=n) for p in parts)
        out[0] = 0  # no length at all
        return out

    back = lambda r: sum(r[p] for p in parts)
    goal = counts.astype(float)
    v = np.ones(len(pats))
    for _ in range(20):  # the largest eigenvalue of A'A gives the step
        v = back(use(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * float(v @ back(use(v))))
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(FIT_STEPS):
        new = np.maximum(0, y - step * back(use(y) - goal))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def layout(counts: np.ndarray) -> pd.DataFrame:
    """Runs (length, low, count, width, sequence, offset): the pieces of a length with ranks from low on go, width at a
    time, to sequences from ``sequence`` on at ``offset``, each further round behind the one before."""
    full = len(counts) - 1
    left, taken = counts.astype(np.int64).copy(), np.zeros(full + 1, np.int64)
    runs: list[tuple[int, ...]] = []
    sequences = 0

    def place(n: int, many: int, width: int, sequence: int, offset: int) -> None:
        runs.append((n, int(taken[n]), many, width, sequence, offset))
        taken[n] += many
        left[n] -= many

    if len(pats := patterns(counts)):
        repeats = np.floor(fit(counts, pats) + 1e-9).astype(np.int64)
        for p in np.argsort(-repeats, kind="stable"):
            if not repeats[p]:
                break
            parts = [int(n) for n in pats[p] if n]
            # rounding may ask for more than there is
            many = min(int(repeats[p]), *(int(left[n]) // parts.count(n) for n in parts))
            if many:
                offset = 0
                for n in parts:
                    place(n, many, many, sequences, offset)
                    offset += n
                sequences += many
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs of (first sequence, count)
    spare = np.zeros(full + 1, bool)
    for n in range(full, 0, -1):
        while left[n]:
            fits = np.flatnonzero(spare[n:])
            if len(fits):
                free = n + int(fits[0])
                first, many = room[free].pop()
                spare[free] = bool(room[free])
            else:
                free, first, many = full, sequences, int(left[n]) if 2 * n > full else max(1, -(-int(left[n]) // (full // n)))
                sequences += many
            if left[n] < many:
                room[free].append((first + int(left[n]), many - int(left[n])))
                spare[free], many = True, int(left[n])
            rounds = min(free // n, int(left[n]) // many)
            place(n, rounds * many, many, first, full - free)
            if rest := free - rounds * n:
                room[rest].append((first, many))
                spare[rest] = True
    return pd.DataFrame(runs, columns=["length", "low", "count", "width", "sequence", "offset"]).sort_values(["length", "low"], ignore_index=True)


def place_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` (with length, at most SEQUENCE) plus sequence_id and offset. Only the histogram and the layout pass the driver."""
    counts = np.zeros(SEQUENCE + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most SEQUENCE rows
        counts[length] = n
    runs = layout(counts)
    salts = max(int(counts.sum()) // SALT_ROWS, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    each = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    lower = each.select("length", "salt", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("lower"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(lower, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("lower")).drop("salt", "lower")
    key = runs["length"].to_numpy(np.int64) << 40 | runs["low"].to_numpy(np.int64)
    low, width, sequence, offset = (runs[c].to_numpy(np.int64) for c in ("low", "width", "sequence", "offset"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, r = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            run = np.searchsorted(key, n << 40 | r, side="right") - 1
            rounds, across = np.divmod(r - low[run], width[run]) if len(pdf) else (r, r)
            yield pdf.drop(columns="rank").assign(sequence_id=sequence[run] + across, offset=offset[run] + rounds * n)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "rank").mapInPandas(lay, schema)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece."""
    return place_pieces(checkpoint(cut(docs, vocabulary, id_col, text_col)))

"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 7).

The model's pieces, scores and byte pieces are read once per worker. A text is normalised as the
model says (dummy prefix, spaces as U+2581) and cut into words where no merge can cross: no piece
holds the mark after another character. Words are cut further into segments between two characters that
no piece has next to each other, so that texts without spaces come in short parts, too. The distinct
words of a batch lie in one flat array of symbols; each round finds every segment's best rank (highest
score), merges all pairs of that rank from the left, in all segments at once, and compacts the array,
until no pair is left.

That is the library's order of merges: it takes the best pair first, of equals the leftmost. Merging all
pairs of one rank at once differs from that only if a merge makes a pair of the same rank or a better
one; in a segment where that would happen the round takes the leftmost pair alone. Rounds are thus
bounded by the ranks that occur, not by the length of the longest word.

Defined results: a null text is an empty one, encoded as the end id alone and decoded to an empty
text; repeated rows each return their row; an empty table gives an empty result; further columns are
not read. The vocabulary must be BPE with byte pieces and the identity normaliser, without
user-defined pieces; others are refused.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACE = "▁"
#: Words, and characters in them, whose ids a worker remembers; it starts afresh beyond.
CACHED_WORDS, CACHED_CHARACTERS = 600_000, 16_000_000
#: Texts whose new words are merged together.
LEARNT_TEXTS = 256
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
SLOT_BITS = 20
FAR = np.iinfo(np.int64).max


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError(f"{path}: only BPE with the identity normaliser and a dummy prefix is supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.end_id = SentencePieceProcessor(model_file=path).eos_id()
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        if any(SPACE in piece.lstrip(SPACE) for _, piece, _ in normal):
            raise ValueError(f"{path}: a piece has a space inside")
        self.ids = {piece: i for i, piece, _ in normal}
        if any(c not in self.ids for piece in self.ids for c in piece):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.shown = ["" if p.type == kinds.CONTROL else model.trainer_spec.unk_surface if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ") for p in model.pieces]
        levels = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        #: Symbols are numbers: pieces have their ids, characters outside the pieces numbers above all ids.
        self.size = len(model.pieces)
        self.level = np.full(self.size, FAR)
        for i, _, s in normal:
            self.level[i] = levels[s]
        self._pairs()
        #: Ids as 32-bit integers, which take a third of the room of Python's.
        self.words: dict[str, bytes] = {}
        self.characters = 0

    def _pairs(self) -> None:
        """The sorted pairs of pieces that make a piece, and of characters next to each other in a piece, sorted for lookup."""
        self.neighbours = np.array(sorted({ord(x) << 21 | ord(y) for piece in self.ids for x, y in zip(piece, piece[1:], strict=False)} | {-1}), np.int64)
        made = [(a * self.size + b, i) for piece, i in self.ids.items() for k in range(1, len(piece)) if (a := self.ids.get(piece[:k])) is not None and (b := self.ids.get(piece[k:])) is not None]
        made.append((-2, -1))  # no pair, so that there is one
        keys, ids = np.array([k for k, _ in made], np.int64), np.array([i for _, i in made], np.int64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        #: Pairs by slot, and where each slot's begin; a slot has few.
        self.pair_keys, self.pair_ids = keys[order], ids[order]
        self.begins = np.searchsorted(slot[order], np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)
        self.most = int(np.diff(self.begins).max())

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 where there is none."""
        key = left * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -1
        at, out, last = self.begins[self._slot(key)], np.full(len(key), -1), len(self.pair_keys) - 1
        for k in range(self.most):
            here = np.minimum(at + k, last)
            np.copyto(out, self.pair_ids[here], where=self.pair_keys[here] == key)
        return out

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat symbols, each one's segment, and each segment's word."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        kinds, which = np.unique(points, return_inverse=True)
        known = np.array([self.ids.get(chr(c), self.size + c) for c in kinds.tolist()], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        pair = points[:-1] << 21 | points[1:]
        found = self.neighbours[np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)] == pair
        starts = np.r_[True, ~found | (word[1:] != word[:-1])][: len(points)]
        return known[which], np.cumsum(starts) - 1, word[starts]

    def _rank(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.level[piece], FAR)

    def _rounds(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge within the parts until no pair is left; parts without a pair leave the working arrays."""

        def made(at: np.ndarray, symbol: np.ndarray, to: np.ndarray) -> np.ndarray:
            """The piece of ``symbol`` in place ``at`` and what stands at ``to``, -1 where that is another part."""
            near = np.clip(to, 0, len(symbols) - 1)
            left, right = (symbol, symbols[near]) if (to > at).all() else (symbols[near], symbol)
            return np.where((near == to) & (part[near] == part[at]), self._made(left, right), -1)

        done: list[tuple[np.ndarray, np.ndarray]] = []
        every = np.arange(len(symbols))
        piece = made(every, symbols, every + 1)
        rank = self._rank(piece)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            best, size = np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbols)])
            if (over := best == FAR).any():
                live = ~np.repeat(over, size)
                done.append((symbols[~live], part[~live]))
                symbols, part, piece, rank, best, size = symbols[live], part[live], piece[live], rank[live], best[~over], size[~over]
                if not len(symbols):
                    break
            goal = np.repeat(best, size)
            hit = np.flatnonzero(rank == goal)
            # of pairs that overlap, every other one from the left
            k = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.r_[True, hit[1:] != hit[:-1] + 1], k, 0))
            hit = hit[(k - run) % 2 == 0]
            new = piece[hit]
            # the pairs that merges from left to right make: with what follows, and with what is then before
            after = self._rank(made(hit, new, hit + 2))
            joined = np.r_[False, hit[1:] == hit[:-1] + 2]
            before = self._rank(np.where(joined, self._made(np.r_[new[:1], new[:-1]], new), made(hit, new, hit - 1)))
            early = np.minimum(after, before) <= goal[hit]
            if early.any():
                alone = np.isin(part[hit], part[hit[early]])
                leftmost = np.r_[True, part[hit[1:]] != part[hit[:-1]]]
                hit, new = hit[~alone | leftmost], new[~alone | leftmost]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols[hit] = new
            symbols, part, piece, rank = symbols[keep], part[keep], piece[keep], rank[keep]
            at = hit - np.arange(len(hit))
            piece[at] = made(at, symbols[at], at + 1)
            rank[at] = self._rank(piece[at])
            at = at[at > 0]
            piece[at - 1] = made(at, symbols[at], at - 1)
            rank[at - 1] = self._rank(piece[at - 1])
        if not done:
            return symbols, part
        symbols, part = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return symbols[order], part[order]

    def _final(self, symbols: list[int]) -> bytes:
        """Characters that are no piece become the pieces of their bytes."""
        ids = chain.from_iterable((s,) if s < self.size else (self.bytes[b] for b in chr(s - self.size).encode()) for s in symbols)
        return np.fromiter(ids, np.int32).tobytes()

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        symbols, segment, owner = self._symbols(new)
        symbols, segment = self._rounds(symbols, segment)
        word = owner[segment]
        raw, ends = symbols.astype(np.int32).tobytes(), np.cumsum(np.bincount(word, minlength=len(new))).tolist()
        plain = np.bincount(word, symbols >= self.size, minlength=len(new)) == 0
        for w, i, j, p in zip(new, [0, *ends[:-1]], ends, plain.tolist(), strict=True):
            self.words[w] = raw[4 * i : 4 * j] if p else self._final(symbols[i:j].tolist())
            self.characters += len(w)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text and the end id."""
        split = []
        for t in texts:
            t = (SPACE + t).replace(" ", SPACE) if t else ""
            if SPACE * 2 in t:
                split.append(WORD.findall(t))
            else:
                split.append([SPACE + w for w in t.split(SPACE)[1:]])
        distinct = set(chain.from_iterable(split))
        missing = distinct.difference(self.words)
        if len(self.words) + len(missing) > CACHED_WORDS or self.characters > CACHED_CHARACTERS:
            self.words.clear()
            self.characters, missing = 0, distinct
        self._learn(list(missing))
        return [[*np.frombuffer(b"".join(map(self.words.__getitem__, w)), np.int32).tolist(), self.end_id] for w in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces as UTF-8, the dummy prefix taken off."""
        shown, out = self.shown, []
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(shown.__getitem__, ids))
        else:
            run = bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(shown[i])
            text = "".join([*out, _utf8(bytes(run))])
        return text[1:] if text[:1] == " " else text


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that starts no character becomes U+FFFD."""
    out = []
    while raw:
        try:
            return "".join([*out, raw.decode()])
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>, the end id last), one row per row of ``docs``."""

    def batch(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "ids": [x for at in range(0, len(texts), LEARNT_TEXTS) for x in codec(model).encode([t or "" for t in texts[at : at + LEARNT_TEXTS]])]}

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col)), batch, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids decode to an empty text."""

    def batch(doc: list, ids: list) -> dict:
        return {"doc_id": doc, "text": [codec(model).decode(x or []) for x in ids]}

    return map_texts(encoded.select("doc_id", "ids"), batch, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode, then decode, without moving the ids."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def batch(doc: list, texts: list) -> dict:
        n, ids_sha, text_sha = [], [], []
        for at in range(0, len(texts), LEARNT_TEXTS):
            for ids in codec(model).encode([t or "" for t in texts[at : at + LEARNT_TEXTS]]):
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(str, ids))))
                text_sha.append(sha(codec(model).decode(ids)))
        return {"doc_id": doc, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col)), batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

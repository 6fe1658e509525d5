import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    rng = random.Random(1)
    alphabet = ["a", "Zé", " ", "  ", "\n", "\t", "\x1c", "'s", "!!", "9", "ß&&&", "́", "İ", "你", "<|endoftext|>", "ª", "_", " "]
    texts = ["", " ", "Häuser*** und'll x'RE", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400))]
    raw = packing.WordEncoder(PATH).encode(texts)
    assert [np.frombuffer(r, "<u4").tolist() for r in raw] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_layouts_are_gapless_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    spread = [lambda n: rng.integers(1, 2049, n), lambda n: np.minimum(2048, rng.geometric(0.003, n)), lambda n: np.full(n, 1100), lambda n: rng.choice([700, 683, 2048, 1], n), lambda n: np.full(n, 1), lambda n: rng.integers(900, 1030, n)][seed]
    lengths = spread(5000)
    counts = np.bincount(lengths, minlength=2049)
    used, placed = defaultdict(list), np.zeros(2049, int)
    for n, low, count, width, sequence, offset in packing.layout(counts).itertuples(index=False):
        assert low == placed[n]
        placed[n] += count
        for r in range(count):
            used[sequence + r % width].append((offset + r // width * n, n))
    assert (placed == counts).all()
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    large, middle = int((lengths > 1024).sum()), int(((lengths > 682) & (lengths <= 1024)).sum())  # at most two of these fit
    bound = max(-(-int(lengths.sum()) // 2048), large, -(-(large + middle + int((lengths == 2048).sum())) // 2))
    assert len(used) <= bound * 1.02 + 1


def test_pack(spark, library):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["tok", "wörd", "x!"]) for _ in range(rng.choice([0, 5, 300, 2500])))) for i in range(60)] + [(60, None), (60, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for i, t in rows[:60]:
        ids = [*library.encode(t, add_special_tokens=False).ids, packing.END_ID]
        for r in sorted(pieces[i], key=lambda r: r.piece):
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * 2048 and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r.length for r in pieces[i]) == len(ids)
    assert len(pieces[60]) == 2
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048


def test_all_triples_are_patterns():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 61, 500), minlength=61)
    there = [n for n in range(1, 61) if counts[n]]
    want = {tuple(sorted((a, b, c))) for a in there for b in there for c in there if a + b + c == 60} | {(0, *sorted((a, b))) for a in there for b in there if a + b == 60} | ({(0, 0, 60)} if counts[60] else set())
    assert {tuple(sorted(p)) for p in packing.patterns(counts).tolist()} == want
    full = np.ones(2049, int)
    assert len(packing.patterns(full)) > 349_000


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.loads(Tokenizer.from_file(PATH).to_str())
    for change in ({"model": spec["model"] | {"end_of_word_suffix": "@"}}, {"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="supported"):
            packing.WordEncoder(str(tmp_path / "v.json"))

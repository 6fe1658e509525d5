"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from spanweave.llm import spelling

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage, min_length=6, min_count=5, ratio=5):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if c >= min_count and len(w) >= min_length}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs and max(n[v] for v in vs) >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items())


def made_up(seed, letters, count, length, docs=40):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*length))) for _ in range(count)}
    words |= {w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in list(words) for i in [rng.randrange(len(w))]}
    chosen = rng.choices(sorted(words), [rng.paretovariate(0.6) for _ in words], k=30 * len(words))
    return [(i, rng.choice([" ", ", ", "1", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in chosen[i::docs])) for i in range(docs)] + [(None, "abcdef " * 9), (7, None), (8, "")]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, spelling.spelling_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("letters,count,length", [("abé", 250, (5, 9)), ("abcdefgh", 300, (6, 12)), ("aÿ", 120, (8, 9)), ("xyz", 60, (60, 70))])
@pytest.mark.parametrize("damage", [None, 19])
def test_against_all_pairs(spark, letters, count, length, damage):
    rows = made_up(count, letters, count, length)
    assert found(spark, rows, damage=damage) == brute(rows, damage)


def test_skewed_blocks_are_subdivided(spark):
    rng = random.Random(4)
    words = {"interna" + "".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(500)}
    words |= {w[::-1] for w in words}
    rows = [(1, " ".join(w for w in sorted(words) for _ in range(rng.choice([5, 30, 200]))))]
    assert found(spark, rows) == brute(rows, None)


def test_chains_of_forms_end_at_their_root(spark):
    rows = [(1, " ".join([*["abcdef"] * 5, *["abcdeg"] * 25, *["abcdhg"] * 125, *["abcihg"] * 625, *["abcihj"] * 624, *["zzzzzz"] * 4]))]
    got = {w: (form, root) for w, form, root, *_ in found(spark, rows)}
    assert got["abcdef"] == ("abcdeg", "abcihg") and got["abcdeg"] == ("abcdhg", "abcihg") and got["abcihg"] == (None, "abcihg") and "zzzzzz" not in got
    assert found(spark, rows) == brute(rows, None)


def test_long_texts_are_split_between_runs(spark, monkeypatch):
    text = "abcdefg hijklmn," * 50 + "q" * 300
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert "".join(spelling.pieces(text)) == text
    total = Counter()
    for p in spelling.pieces(text):
        total.update(spelling.runs(3, p, 5))
    assert total == spelling.runs(3, text, 5)


def test_words_wider_than_arrays(spark):
    long = "ab" * 400
    rows = [(1, " ".join([*[long] * 30, *[long[:300] + "z" + long[301:]] * 5, *[long[:-1]] * 6, *["ba" + long] * 7]))]
    assert found(spark, rows) == brute(rows, None)


def test_empty_and_repeated_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, ""), (3, "short words only")]) == []
    rows = [(1, "wordone wordone worktwo")] * 3
    assert found(spark, rows) == brute(rows, None) == [("wordone", None, "wordone", 6, 0, None)]

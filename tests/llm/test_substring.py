import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from spanweave.llm import substring_dedup
from spanweave.llm.common import words


def brute(rows, window=substring_dedup.WINDOW):
    first, key = {}, lambda d: substring_dedup.LAST if d is None else d
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, key(d)), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(200)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(5)):
            a = rng.randrange(150)
            w += rng.choice(passages)[a : a + rng.randrange(1, 120)]
            if rng.random() < 0.3:
                w += ["x"] * rng.randrange(120)
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "q"
        rows.append((rng.choice([i, i, i // 2, None]), " ".join(w) if rng.random() > 0.05 else None))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r[2] for r in want) > 1000


def test_least_places_are_leftmost():
    h = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert substring_dedup.least_places(h, 3).tolist() == [1, 1, 4, 4, 4]
    for n in (1, 2, 7):
        x = np.random.default_rng(n).integers(0, 9, 40).astype(np.uint64)
        assert substring_dedup.least_places(x, n).tolist() == [i + int(np.argmin(x[i : i + n])) for i in range(40 - n + 1)]


def test_stretches_hash_by_content():
    r = substring_dedup.Rolling(b"a b c a b c a".split())
    d = lambda i, j: int(r.digest(0, np.array([i]), np.array([j]))[0])
    assert d(0, 3) == d(3, 6) and d(0, 3) != d(1, 4) and d(0, 2) != d(0, 3)


def test_document_map_keeps_and_leaves(spark):
    base = spark.range(100).select(F.col("id").alias("d"), (F.col("id") * 7).alias("rid"), F.col("id").alias("x"))
    bits = substring_dedup.document_map(base.where("d < 40"))
    inside = {r.x for r in substring_dedup.mapped(base, bits, True, "x").collect()}
    outside = {r.x for r in substring_dedup.mapped(base, bits, False, "x").collect()}
    assert set(range(40)) <= inside and inside | outside == set(range(100)) and not inside & outside


def test_paths_are_contracted_to_their_heads(spark):
    chain = [(f"a{i + 1}", f"a{i}", i % 3 + 1) for i in range(37)] + [("b1", "b0", 5)]
    got = {r.node: (r.head, r.far) for r in substring_dedup.contract(spark.createDataFrame(chain, "node string, head string, far int")).collect()}
    assert got == {f"a{i + 1}": ("a0", sum(k % 3 + 1 for k in range(i + 1))) for i in range(37)} | {"b1": ("b0", 5)}


def test_only_what_reads_as_its_source_goes():
    w = [str(i).encode() for i in range(120)]
    said = substring_dedup.spelled(w, 10, 3)
    gone = lambda pos: substring_dedup._kept(w, [{"pos": pos, "n": 3, "said": said}])[0]
    assert gone(10) == substring_dedup.WINDOW + 2 and gone(11) == 0


def test_merged_spans_go_on_at_both_ends():
    span = lambda pos, n, sd, spos: {"pos": pos, "n": n, "sd": sd, "srid": 0, "spos": spos}
    spans = [span(5, 2, 1, 9), span(0, 5, 1, 4), span(7, 1, 1, 30), span(8, 2, 2, 31), span(0, 5, 1, 4)]
    assert substring_dedup.merged_spans(spans) == [[0, 7, 1, 0, 4], [7, 1, 1, 0, 30], [8, 2, 2, 0, 31]]


def test_long_shared_passages_are_few_spans(spark):
    rng = random.Random(9)
    passage = [str(rng.randrange(10**6)) for _ in range(1500)]
    rows = [(i, " ".join([*(f"{i}_{k}" for k in range(20)), *passage])) for i in range(5)] + [(9, " ".join(passage[200:900]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).collect()), key=repr) == brute(rows)
    base = df.select("doc_id", F.col("doc_id").alias("d"), F.xxhash64("text").alias("rid"), "text")
    spans = {r.d: len(r.spans) for r in substring_dedup.repeated_spans(base).collect()}
    assert set(spans) == {1, 2, 3, 4, 9} and max(spans.values()) <= 4

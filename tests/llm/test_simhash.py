import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from spanweave.llm import simhash


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_fingerprints():
    rng = random.Random(2)
    for t in [None, "", " \t", "A b", "É a B c", *(" ".join(rng.choice(["Ab", "c", "é", "d e"]) for _ in range(rng.randrange(40))) for _ in range(50))]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(200)) for _ in range(12)]
    rows = []
    for i in range(250):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w) if rng.random() > 0.05 else None))
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], prints)
    assert {r.doc_id: r.component_id for r in out} == want
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{p:016x}" for (i, _), p in zip(rows, prints, strict=True)}
    assert len(set(want.values())) < 250


def scattered(rng):
    points = {0, (1 << 64) - 1}
    for _ in range(5):
        x = rng.getrandbits(64)
        for _ in range(60):
            points.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    return sorted(points)


@pytest.mark.parametrize("short", [2, simhash.SHORT_LIST, 1000])
def test_links_span_dense_and_sparse_groups(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    points = scattered(random.Random(4))
    df = spark.createDataFrame([(simhash.signed(p),) for p in points], "fp long")
    found = simhash.components(simhash.links(df)).collect()
    label = {p: p for p in points} | {r.node % 2**64: r.root % 2**64 for r in found}
    want = plain_components(points, points)
    assert len({(label[p], want[p]) for p in points}) == len(set(label.values())) == len(set(want.values()))


def index_rows(points, rank):
    posted = pd.concat(simhash.posts(iter([pd.DataFrame({"fp": points[:100]}), pd.DataFrame({"fp": points[100:]})]), rank))
    return posted.sort_values(["list", "fp"], ignore_index=True)


def parted(frame, sizes):
    at = 0
    for n in sizes:
        yield frame.iloc[at : at + n]
        at += n
    yield frame.iloc[at:]


@pytest.mark.parametrize("short", [2, 5, 1000])
def test_every_near_pair_is_retained_or_in_a_long_list(monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    rng = random.Random(5)
    points = np.array([simhash.signed(p) for p in scattered(rng)])
    rows = index_rows(points, np.array(rng.sample(range(2048), 2048)))
    near = {(a, b) for a, b in combinations(sorted(points.tolist()), 2) if ((a ^ b) & 2**64 - 1).bit_count() <= 2}
    outs = []
    for sizes in ([], [1] * 200, [rng.randrange(1, 40) for _ in range(60)]):
        out = pd.concat(simhash._tally(parted(rows, sizes)))
        pairs = {tuple(sorted(x)) for x in out[out["shared"] >= 0][["a", "b"]].to_numpy().tolist()}
        crowded = set(out.loc[out["shared"] == -1, "a"])
        assert all(p in pairs or (p[0] in crowded and p[1] in crowded) for p in near)
        outs.append((pairs, crowded))
    assert outs[0] == outs[1] == outs[2]
    if short == 1000:
        assert not outs[0][1]


def test_tallies_are_shared_positional_bytes():
    a, b = 0x0102030405060708, 0x01020304050607FF
    rows = index_rows(np.array([a, b]), np.arange(2048))
    out = pd.concat(simhash._tally(iter([rows])))
    assert set(out["shared"]) == {7} and len(out) == 5  # sets of four of the first six positions, without the one that differs


def test_lists_of_six_bytes_go_on_across_batches():
    rng = random.Random(6)
    fp = sorted({simhash.signed(0xABCD << 48 | rng.getrandbits(16)) for _ in range(300)})
    pdf = pd.DataFrame({"which": 0, "key": 5, "fp": fp})
    as_set = lambda frames: {tuple(x) for f in frames for x in f.to_numpy().tolist()}
    assert as_set(simhash._forest(iter([pdf]))) == as_set(simhash._forest(iter([pdf.iloc[:100], pdf.iloc[100:101], pdf.iloc[101:]]))) != set()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {901: 900} | ({0: 0} if 0 in got else {}) | ({900: 900} if 900 in got else {})
    assert np.all([v <= k for k, v in got.items()])

import random
import time
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.config import GATES, SEQUENCE, VAD, AlignConfig
from spanweave.operators import gates, intervals, islands, mapping, segments, sequence, store
from spanweave.operators import names as fuzzy
from spanweave.plans import alignment, reports

SPAN = "key int, id int, start_s double, end_s double"


def spans(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(3), i, float(a := rng.randrange(200)), float(a + rng.randrange(1, 60))) for i in range(n)]


def test_overlap_join_counts_each_pair_once(spark):
    a, b = spans(60, 1), spans(60, 2)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] < x[3] and x[2] < y[3])
    left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    for width in (5.0, 17.0, 1000.0):
        got = intervals.overlap_join(left, right.withColumnRenamed("id", "other"), ["key"], width)
        assert sorted((r.id, r.r_other) for r in got.collect()) == want


def test_unmatched_spans_are_not_covered(spark):
    got = spark.range(1).select(intervals.overlap_seconds(F.lit(0.0), F.lit(5.0), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("x")).first().x
    assert got == 0.0


def test_coalesced_spans_are_disjoint_and_cover_the_same(spark):
    rows = spans(80, 3)
    out = intervals.coalesce_spans(spark.createDataFrame(rows, SPAN), ["key"]).collect()
    for k in range(3):
        mine = sorted((r.start_s, r.end_s) for r in out if r.key == k)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:], strict=False))
        covered = lambda ss, t: any(a <= t < b for a, b in ss)
        assert all(covered(mine, t) == covered([(r[2], r[3]) for r in rows if r[0] == k], t) for t in np.arange(0, 270, 0.5))
    touching = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.0, 2.0)], SPAN)
    assert intervals.coalesce_spans(touching, ["key"]).count() == 1


def line_case(spark, lines, regions, cfg=AlignConfig(tolerance_s=1.0)):
    own = spark.createDataFrame([("ann", "A"), ("bob", "B")], "speaker string, channel string")
    ls = spark.createDataFrame([(1, i, s, float(a), float(b)) for i, (s, a, b) in enumerate(lines)], "key int, line int, speaker string, start_s double, end_s double")
    rs = spark.createDataFrame([(1, i, c, float(a), float(b)) for i, (c, a, b) in enumerate(regions)], "key int, region int, channel string, start_s double, end_s double")
    return alignment.align(ls, rs, own, 10.0, cfg)


def test_alignment_kinds(spark):
    out = line_case(spark, [("ann", 0, 4), ("ann", 10, 14), ("ann", 20, 24), ("ann", 30, 34), ("cat", 50, 54)], [("A", 0, 4), ("B", 10, 14), ("A", 20, 21), ("X", 30, 34), ("A", 60, 62), ("A", 70, 70.5)])
    found = {r.line: r for r in out["findings"].collect()}
    assert {k: r.type for k, r in found.items()} == {0: "OK", 1: "MISMATCH", 2: "MISALIGNED", 3: "MISSING"}
    assert found[1].delivered_by == "B" and found[2].subtype == "early" and found[2].drift_s == -1.5 and found[3].possibly_in == "X"
    assert sorted((r.channel, r.start_s) for r in out["extras"].collect()) == [("A", 60.0), ("B", 10.0)]


def test_offsets_are_corrected_and_warned_of(spark):
    out = line_case(spark, [("ann", 10 * i, 10 * i + 3) for i in range(5)], [("A", 10 * i + 2, 10 * i + 5) for i in range(5)])
    assert {r.type for r in out["findings"].collect()} == {"OK"}
    assert [(r.offset_s, r.direction) for r in out["sync"].collect()] == [(2.0, "late")]
    few = line_case(spark, [("ann", 0, 3), ("ann", 10, 13)], [("A", 2, 5), ("A", 12, 15)])
    assert {r.offset_s for r in few["findings"].collect()} == {0.0}


def blocks(spark, rows):
    df = spark.createDataFrame([(1, *r) for r in rows], "key int, line int, start_s double, end_s double, slot double")
    return islands.blocks(df, ["key"], GATES.block_gap_s, GATES.block_min, GATES.block_slot).collect()


def test_blocks_need_consecutive_lines(spark):
    sparse = blocks(spark, [(i, float(t), t + 1.0, 0.0) for i, t in zip((10, 12, 14, 16), (100, 109, 118, 127), strict=True)])
    assert all(r.block_id is None for r in sparse)
    dense = blocks(spark, [(10 + i, 100.0 + 3 * i, 101.0 + 3 * i, None) for i in range(4)])
    assert {(r.block_id, r.block_n) for r in dense} == {(1, 4)} and sum(r.block_first for r in dense) == 1
    assert all(r.block_id is None for r in blocks(spark, [(10 + i, 100.0 + 3 * i, 101.0 + 3 * i, 0.4) for i in range(4)]))


def test_reprises(spark):
    loose = spark.createDataFrame([(1, 600, "eu sei que diz entre nos"), (1, 601, "eu sei que não")], "key int, line int, text string")
    lyrics = spark.createDataFrame([(1, 5, ["eu", "sei", "que"]), (1, 6, ["eu", "sei", "que"])], "key int, block int, words array<string>")
    assert [(r.line, r.block) for r in gates.reprises(loose, lyrics, ["key"]).collect()] == [(601, 5)]


def test_reprise_neighbourhood(spark):
    tagged = spark.createDataFrame([(1, t) for t in (20.0, 40.0, 2400.0, 2420.0, 5000.0)], "key int, at_s double")
    assert sorted((r.start_s, r.end_s) for r in gates.reprise_neighbourhood(tagged, ["key"]).collect()) == [(5.0, 55.0), (2385.0, 2435.0)]


def test_names_and_greedy_pairs(spark):
    pairs = spark.createDataFrame([("Man", "man"), ("Sachike Amane", "Man"), ("Random Man", "man"), ("ShomaStomach", "shoma"), ("EP1_Bob", "bob"), ("Sachika", "Sachike"), ("", "x")], "channel string, label string")
    s = {(r.channel, r.label): r.name_score for r in fuzzy.score_names(pairs, "channel", "label", ("ep1",)).collect()}
    assert s["Man", "man"] == 1.0 and s["Random Man", "man"] == 0.85 and s["ShomaStomach", "shoma"] >= 0.75 and s["EP1_Bob", "bob"] == 1.0 and s["", "x"] == 0.0
    assert s["Sachike Amane", "Man"] < 0.55 < s["Sachika", "Sachike"]
    scored = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "y", 0.5)], "key int, l string, r string, s double")
    assert sorted((r.l, r.r) for r in fuzzy.assign_greedily(scored, ["key"], "l", "r", "s", 0.55).collect()) == [("a", "y"), ("b", "x")]


def test_overlap_join_of_spans_of_all_lengths(spark):
    """Seconds beside years, in one key: each pair once, and few rows a span."""
    rng = random.Random(6)
    made = lambda n, seed: [(rng.randrange(2), i, float(a := rng.choice([0, rng.randrange(4000), rng.randrange(10**7)])), a + rng.choice([0.0, 0.5, 7.0, 8.0, 16.0, 300.0, 40_000.0, 3.2e7])) for i in range(n)]
    a, b = made(150, 1), made(150, 2)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] < x[3] and x[2] < y[3])
    joined = intervals.overlap_join(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["key"], 8.0, any_length=True)
    assert sorted((r.id, r.r_id) for r in joined.collect()) == want and joined.columns == ["key", "id", "start_s", "end_s", "r_id", "r_start_s", "r_end_s"]
    empty = spark.createDataFrame([], SPAN)
    assert intervals.overlap_join(spark.createDataFrame(a, SPAN), empty, ["key"], 8.0, any_length=True).collect() == [] == intervals.overlap_join(empty, spark.createDataFrame(b, SPAN), ["key"], 8.0, any_length=True).collect()
    # a year among seconds: a bin a second would be 32 million rows
    year = spark.createDataFrame([(1, 0, 0.0, 3.2e7)], SPAN)
    seconds = spark.range(20_000).selectExpr("1 AS key", "int(id) AS id", "double(id) AS start_s", "id + 1.0D AS end_s")
    began = time.time()
    assert intervals.overlap_join(year, seconds, ["key"], 1.0, any_length=True).count() == 20_000 and time.time() - began < 30


def test_mapping_repair(spark):
    def run(named, scores, lines):
        who = sorted({s for s, *_ in scores})
        tracks = sorted({c for _, c, *_ in scores})
        sc = spark.createDataFrame([(1, s, c, float(p), float(r), 0.0, who.index(s), tracks.index(c)) for s, c, p, r in scores], "key long, speaker string, channel string, precision double, recall double, name_score double, speaker_ord int, channel_ord int")
        m, i = mapping.repair(spark.createDataFrame([(1, *x) for x in named], "key long, speaker string, channel string"), sc, spark.createDataFrame([(1, s, n, float(n)) for s, n in lines.items()], "key long, speaker string, lines long, line_s double"))
        return {r.speaker: r.channel for r in m.collect()}, sorted((r.kind, r.speaker, r.channel) for r in i.collect() if r.kind != "ambiguous_name")

    both = lambda a, b, c, d: [("ann", "A", a, 0.9), ("bob", "A", b, 0.9), ("ann", "B", c, 0.9), ("bob", "B", d, 0.9)]
    assert run([("ann", "A"), ("bob", "B")], both(0.1, 0.8, 0.8, 0.1), {"ann": 9, "bob": 9}) == ({"ann": "B", "bob": "A"}, [("swap_repaired", "ann", "B")])
    assert run([("ann", "A")], [("ann", "A", 0.1, 0.2), ("bob", "A", 0.7, 0.8)], {"ann": 2, "bob": 9}) == ({"bob": "A"}, [("reassigned", "bob", "A")])
    m, i = run([("ann", "A")], [("ann", "A", 0.9, 0.9), ("bob", "A", 0.0, 0.0), ("ann", "B", 0.0, 0.0), ("bob", "B", 0.6, 0.5)], {"ann": 9, "bob": 9})
    assert m == {"ann": "A", "bob": "B"} and ("rescued", "bob", "B") in i
    m, i = run([("ann", "walla")], [("ann", "walla", 0.2, 0.9)], {"ann": 2})
    assert m == {} and i == [("grouped", "ann", "walla")]
    m, i = run([("ann", "A")], [("ann", "A", 0.2, 0.5), ("bob", "A", 0.45, 0.1)], {"ann": 9, "bob": 9})
    assert ("name_mismatch", "ann", "A") in i and ("verified_absent", "bob", None) in i


def plain_repair(named, score, lines, speakers, channels, cfg):
    """Reassignment, swaps and rescues of one key, one entry after another; no track is a bundle."""
    mapping, by, events = dict(named), dict.fromkeys(named, "name"), []
    at = lambda who, where, k=0: score[who, where][k]
    for who, where in list(mapping.items()):
        owner = max(speakers, key=lambda x: (at(x, where), -speakers.index(x)))
        if owner == who or owner in mapping or at(owner, where) < cfg.strong_precision or at(owner, where, 1) < cfg.rescue_recall:
            continue
        if at(owner, where) - at(who, where) >= cfg.margin and lines[owner] >= lines[who]:
            del mapping[who], by[who]
            mapping[owner], by[owner] = where, "content"
            events.append(("reassigned", owner, where))
    order = list(mapping)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = mapping[a], mapping[b]
            if at(a, y) >= cfg.flag_precision and at(a, y) - at(b, y) >= cfg.margin and at(b, x) >= cfg.flag_precision and at(b, x) - at(a, x) >= cfg.margin:
                mapping[a], mapping[b], by[a], by[b] = y, x, "content", "content"
                events.append(("swap_repaired", a, y))
    taken = set(mapping.values())
    best = lambda who: max(((at(who, c, 1), -channels.index(c)) for c in channels if c not in taken and at(who, c, 1) > 0), default=(0, 0))
    for who in sorted((x for x in speakers if x not in mapping), key=lambda x: -best(x)[0]):
        recall, k = best(who)
        where = channels[-k]
        if recall >= cfg.rescue_recall and at(who, where) >= cfg.rescue_precision:
            if at(who, where) >= cfg.strong_precision:
                mapping[who], by[who] = where, "content"
                taken.add(where)
                events.append(("rescued", who, where))
            else:
                events.append(("possible_match", who, where))
    return {(s, c, by[s]) for s, c in mapping.items()}, events


def test_mapping_repair_in_sequence(spark):
    """Random scores, so that claims and swaps follow from one another."""
    rng = random.Random(11)
    cfg = mapping.MAPPING
    keys, rows, names, people = {}, [], [], []
    for key in range(150):
        speakers, channels = [f"s{k}" for k in range(rng.randrange(2, 7))], [f"T{k}" for k in range(rng.randrange(2, 7))]
        score = {(s, c): (round(rng.choice([0.0, rng.random(), rng.random()]), 3), round(rng.choice([0.0, rng.random()]), 3)) for s in speakers for c in channels}
        lines = {s: rng.choice([3, 5, 8]) for s in speakers}
        held = dict(zip(rng.sample(speakers, k=rng.randrange(1, len(speakers) + 1)), rng.sample(channels, k=len(channels)), strict=False))
        held = {s: held[s] for s in speakers if s in held}
        keys[key] = plain_repair(held, score, lines, speakers, channels, cfg)
        rows += [(key, s, c, *score[s, c], 0.0, speakers.index(s), channels.index(c)) for s, c in score]
        names += [(key, s, c) for s, c in held.items()]
        people += [(key, s, n, 99.0) for s, n in lines.items()]
    found, issues = mapping.repair(spark.createDataFrame(names, "key long, speaker string, channel string"), spark.createDataFrame(rows, "key long, speaker string, channel string, precision double, recall double, name_score double, speaker_ord int, channel_ord int"), spark.createDataFrame(people, "key long, speaker string, lines long, line_s double"))
    got, said = {k: set() for k in keys}, {k: [] for k in keys}
    for r in found.collect():
        got[r.key].add((r.speaker, r.channel, r.mapped_by))
    for r in issues.where("kind in ('reassigned', 'swap_repaired', 'rescued', 'possible_match')").collect():
        said[r.key].append((r.kind, r.speaker, r.channel))
    for k, (want, events) in keys.items():
        assert got[k] == want and sorted(said[k]) == sorted(events), k
    kinds = [e[0] for _, events in keys.values() for e in events]
    # some keys need several rounds of either
    assert max(sum(e[0] == kind for e in events) for _, events in keys.values() for kind in ("reassigned", "swap_repaired")) > 1 and {"reassigned", "swap_repaired", "rescued", "possible_match"} == set(kinds)


def test_mapping_repair_passes_one_by_one(spark):
    """Each pass fires on a case of its own, and not where its bounds are missed."""

    def run(named, scores, lines):
        who, tracks = sorted({s for s, *_ in scores}), sorted({c for _, c, *_ in scores})
        sc = spark.createDataFrame([(1, s, c, float(p), float(r), float(n), who.index(s), tracks.index(c)) for s, c, p, r, n in scores], "key long, speaker string, channel string, precision double, recall double, name_score double, speaker_ord int, channel_ord int")
        m, i = mapping.repair(spark.createDataFrame([(1, *x) for x in named], "key long, speaker string, channel string"), sc, spark.createDataFrame([(1, s, n, float(n)) for s, n in lines.items()], "key long, speaker string, lines long, line_s double"))
        return {r.speaker: r.channel for r in m.collect()}, {(r.kind, r.speaker, r.channel) for r in i.collect()}

    nine = {"ann": 9, "bob": 9, "cat": 9}
    # 1 a bundle is dropped, unless someone's voice fills it
    assert run([("ann", "crowd_1")], [("ann", "crowd_1", 0.4, 0.2, 1)], nine)[0] == {}
    assert run([("ann", "crowd_1")], [("ann", "crowd_1", 0.6, 0.2, 1)], nine)[0] == {"ann": "crowd_1"}
    # 2 reassigned only with enough lines and margin
    taken = [("ann", "A", 0.4, 0.2, 1), ("bob", "A", 0.6, 0.5, 0)]
    assert run([("ann", "A")], taken, nine)[0] == {"bob": "A"}
    assert ("reassigned", "bob", "A") not in run([("ann", "A")], taken, nine | {"bob": 3})[1]
    assert ("reassigned", "bob", "A") not in run([("ann", "A")], [("ann", "A", 0.5, 0.2, 1), ("bob", "A", 0.6, 0.5, 0)], nine)[1]
    # 3 no swap if only one side beats the other
    m, i = run([("ann", "A"), ("bob", "B")], [("ann", "A", 0.1, 0.9, 1), ("bob", "A", 0.8, 0.9, 0), ("ann", "B", 0.1, 0.9, 0), ("bob", "B", 0.8, 0.9, 1)], nine)
    assert m == {"ann": "A", "bob": "B"} and ("name_mismatch", "ann", "A") in i
    # 4 possible matches stay unmapped and leave the track free; the better recall goes first
    m, i = run([("ann", "A")], [("ann", "A", 0.9, 0.9, 1), ("bob", "A", 0, 0, 0), ("cat", "A", 0, 0, 0), ("ann", "X", 0, 0, 0), ("bob", "X", 0.3, 0.4, 0), ("cat", "X", 0.55, 0.35, 0)], nine)
    assert m == {"ann": "A", "cat": "X"} and {("possible_match", "bob", "X"), ("rescued", "cat", "X")} <= i
    # 5 a small part in a bundle, but not a large one
    part = [("ann", "A", 0.9, 0.9, 1), ("bob", "A", 0, 0, 0), ("ann", "walla", 0.1, 0.1, 0), ("bob", "walla", 0.2, 0.9, 0)]
    assert ("grouped", "bob", "walla") in run([("ann", "A")], part, {"ann": 9, "bob": 3})[1]
    assert ("grouped", "bob", "walla") not in run([("ann", "A")], part, {"ann": 9, "bob": 7})[1]
    # 7 second tracks by name, or by a weaker name and the voice, unless another voice is in them
    twin = lambda name, p, r, other: run([("ann", "A")], [("ann", "A", 0.9, 0.9, 1), ("bob", "A", 0, 0, 0), ("ann", "A2", p, r, name), ("bob", "A2", other, 0.1, 0)], nine)[1]
    assert ("twin_merged", "ann", "A2") in twin(0.8, 0.1, 0.1, 0.1) and ("twin_merged", "ann", "A2") in twin(0.5, 0.6, 0.2, 0.1)
    assert ("twin_merged", "ann", "A2") not in twin(0.5, 0.3, 0.2, 0.1) and ("twin_merged", "ann", "A2") not in twin(0.8, 0.1, 0.1, 0.4)
    # 8 names of several people in a file's name
    assert ("ambiguous_name", None, "anna_bobby") in run([], [("anna", "anna_bobby", 0, 0, 0), ("bobby", "anna_bobby", 0, 0, 0)], {"anna": 9, "bobby": 9})[1]
    # 9 nobody's voice anywhere
    assert ("verified_absent", "bob", None) in run([("ann", "A")], [("ann", "A", 0.9, 0.9, 1), ("bob", "A", 0.1, 0.1, 0)], nine)[1]


def plain_regions(p, step, cfg=VAD):
    """One frame after the other."""
    off, runs, start, quiet = max(0.15, min(cfg.off, cfg.on - 0.15)), [], None, None
    for k, x in enumerate([*p, None]):
        if x is None:
            runs += [(start, k)] if start is not None else []
        elif x >= cfg.on:
            start, quiet = (k if start is None else start), None
        elif x < off and start is not None:
            quiet = k if quiet is None else quiet
            if (k - quiet) * step >= cfg.min_silence_s - 1e-9:
                runs.append((start, quiet))
                start = quiet = None
    out = []
    for a, b in runs:
        if (b - a) * step >= cfg.min_speech_s - 1e-9:
            a, b = max(0.0, a * step - cfg.pad_s), min(len(p) * step, b * step + cfg.pad_s)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return [(round(a, 3), round(b, 3)) for a, b in out]


def test_speech_regions(spark):
    rng = random.Random(2)
    tracks = [[rng.choice([0.0, 0.1, 0.2, 0.4, 0.45, 0.6, 0.9]) if rng.random() < 0.5 else last for last in [rng.choice([0.0, 0.9])] for _ in range(rng.randrange(1, 200))] for _ in range(40)]
    tracks += [[0.9], [0.9] * 4, [0.0] * 20, [0.0] * 5 + [0.9] * 10 + [0.4] * 10 + [0.1] * 3 + [0.9] * 2 + [0.1] * 10 + [0.9]]
    for t in tracks[:20]:  # long stretches
        for _ in range(6):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(20)] = [rng.choice([0.0, 0.3, 0.4, 0.9])] * len(t[k : k + rng.randrange(1, 20)])
    rows = [(n, i, float(p), 0.032) for n, t in enumerate(tracks) for i, p in enumerate(t)]
    found = segments.detect_speech(spark.createDataFrame(rows, "track int, i int, prob double, step_s double"), ["track"]).collect()
    for n, t in enumerate(tracks):
        assert sorted((r.start_s, r.end_s) for r in found if r.track == n) == plain_regions(t, 0.032), n


def plain_best(sim, starts, others, gap, least, cfg):
    """The best score over all monotone paths, by recursion."""
    n, m = len(starts), len(others)
    ok = lambda i, j: sim[i, j] if sim[i, j] >= least and abs(starts[i] - others[j]) <= cfg.band_s else -np.inf

    @lru_cache(None)
    def best(i, j):
        if i == n or j == m:
            return -gap * (n - i + m - j)
        two = max(ok(i, j), ok(i, j + 1)) - cfg.merge_cost + best(i + 1, j + 2) if j + 1 < m else -np.inf
        return max(ok(i, j) + best(i + 1, j + 1), two, best(i + 1, j) - gap, best(i, j + 1) - gap)

    return best(0, 0)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 7), st.integers(0, 7), st.integers(0, 100_000), st.booleans())
def test_best_path_is_optimal(n, m, seed, ordered):
    rng = np.random.default_rng(seed)
    sim = rng.integers(0, 11, (n, m)) / 10
    starts, others = rng.integers(0, 90, n).astype(float), rng.integers(0, 90, m).astype(float)
    if ordered:
        starts, others = np.sort(starts), np.sort(others)
    gap, least = 0.35, 0.5
    path = sequence.best_path([(i, j, sim[i, j]) for i in range(n) for j in range(m)], starts, others, gap, least)
    pairs = [(i, j) for k, i, j, _ in path if k == "pair"]
    assert all(sim[i, j] >= least and abs(starts[i] - others[j]) <= 25 for i, j in pairs)
    assert sorted(i for k, i, _, _ in path if k == "missing") == sorted(set(range(n)) - {i for i, _ in pairs})
    extra = [j for k, _, j, _ in path if k == "extra"]
    assert len(set(extra)) == len(extra) and not set(extra) & {j for _, j in pairs}
    by_line = {}
    for i, j in sorted(pairs):
        by_line.setdefault(i, []).append(j)
    flat = [j for i in sorted(by_line) for j in by_line[i]]
    assert flat == sorted(flat) and all(len(js) <= 2 and js[-1] - js[0] == len(js) - 1 for js in by_line.values())
    # others that are neither paired nor extra were taken by a merge beside a pair
    taken = set(range(m)) - set(extra) - {j for _, j in pairs}
    merged = sum(len(js) == 2 for js in by_line.values()) + len(taken)
    got = sum(max(sim[i, j] for j in js) for i, js in by_line.items()) - 0.05 * merged - gap * (len(extra) + n - len(by_line))
    assert np.isclose(got, plain_best(sim, tuple(starts), tuple(others), gap, least, SEQUENCE))


def test_stores(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 5.0, "b")], "k int, t double, v string")
    new = spark.createDataFrame([(1, 2.0, "c"), (2, 5.0, "d"), (3, 0.0, "e")], "k int, t double, v string")
    assert {r.k: r.v for r in store.upsert(old, new, "k", "t").collect()} == {1: "c", 2: "d", 3: "e"}
    assert [r.k for r in store.added(old, new, "k").collect()] == [3]


def test_draws_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.choice("abc"), float(a := rng.randrange(300)), float(a + rng.randrange(1, 6)), rng.randrange(3)) for _ in range(200)]
    want = []
    for key in range(4):
        mine = sorted(r[1:] for r in rows if r[0] == key)
        seen = []
        for draw, a, b, t in mine:
            hit = next((c for c in seen if c[0] <= b + 2.5 and a <= c[1] + 2.5), None)
            if hit is None:
                seen.append([a, b, t, 1])
            else:
                hit[3] += 1
                if t > hit[2]:
                    hit[:3] = [a, b, t]
        n = len({r[0] for r in mine})
        want += [(key, a, b, t, min(k, n), n) for a, b, t, k in seen]
    df = spark.createDataFrame(rows, "key int, draw string, start_s double, end_s double, tier int")
    assert sorted(map(tuple, store.cluster_draws(df, ["key"], 2.5).collect())) == sorted(want)


def test_passes(spark):
    passes = spark.createDataFrame([(1, "a", 0.0, 2.0, True), (1, "a", 5.0, 6.0, False), (1, "b", 0.0, 2.0, True), (1, "b", 5.0, 6.5, True), (1, "b", 9.0, 10.0, False), (2, "a", 0.0, 4.0, True), (2, "b", 2.0, 6.0, True), (2, "b", 2.1, 6.0, True), (2, "a", 4.0, 9.0, False), (2, "a", 4.0, 7.0, False)], "key int, pass string, start_s double, end_s double, reliable boolean")
    got = sorted((r.key, r["pass"], r.start_s, r.end_s) for r in store.merge_passes(passes, ["key"], 4.0).collect())
    assert got == [(1, "a", 0.0, 2.0), (1, "b", 5.0, 6.5), (2, "a", 0.0, 4.0), (2, "a", 4.0, 9.0), (2, "b", 2.1, 6.0)]


def test_root_causes(spark):
    chars = [("hi", "x", 4, "t"), ("te", "x", 4, "t"), ("hi", "y", 10, None), ("te", "y", 10, "t"), ("hi", "z", 10, "t"), ("te", "z", 10, "t"), ("hi", "w", 10, "t"), ("te", "w", 10, "t")]
    df = spark.createDataFrame([(*c, None) for c in chars], "lang string, character string, lines long, channel string, grouped_in string")
    missing = spark.createDataFrame([("hi", "x")] * 3 + [("te", "x")] * 4 + [("hi", "z")] + [("te", "z")] + [("te", "w")], "lang string, character string")
    causes = reports.root_causes(reports.language_stats(df, missing), df.select("lang").distinct())
    assert {r.character: r.cause for r in causes.collect()} == {"x": "script", "y": "delivery", "z": "hard-lines", "w": "dub"}


def test_upper_half(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [1] * 4, "v": [1.0, 2.0, 3.0, 10.0]}))
    assert segments.upper_half(df, ["k"], "v").first().upper_median == 3.0


def test_joined_timelines_map_back(spark):
    from spanweave.operators import timeline

    placed = timeline.concatenated(spark.createDataFrame([(1, 10.0, 12.0), (1, 30.0, 33.0), (1, 60.0, 65.0)], "key int, start_s double, end_s double"), ["key"])
    assert [round(r.at_s, 3) for r in placed.orderBy("start_s").collect()] == [0.0, 2.9, 6.8]
    points = spark.createDataFrame([(1, 0.2), (1, 2.0), (1, 3.0), (1, 6.0), (1, 6.5), (1, 11.0)], "key int, at double")
    got = [round(r.original_s, 1) for r in timeline.map_back(points, placed, ["key"]).orderBy("at").collect()]
    assert got == [10.0, 11.8, 29.9, 32.9, 33.2, 64.0]


def plain_drift(a, b, window, hop, most, apart):
    """Shift by shift, from the rule: centred windows against centred segments of equal length."""
    out = []
    for at in range(0, len(a) - window + 1, hop):
        x = a[at : at + window]
        if x.std() < 0.05:
            continue
        scores = {}
        for shift in range(-most, most + 1):
            y = b[at + shift : at + shift + window] if at + shift >= 0 else b[:0]
            spread = np.linalg.norm(y - y.mean()) if len(y) == window else 0
            scores[shift] = round(float((x - x.mean()) @ (y - y.mean()) / (np.linalg.norm(x - x.mean()) * spread)), 9) if spread >= 1e-6 else -1.0
        top = max(scores, key=lambda s: (scores[s], -s))
        lead = scores[top] - max((r for s, r in scores.items() if abs(s - top) >= apart), default=0.0)
        if scores[top] >= 0.55 and lead >= 0.1:
            out.append((at, top, round(scores[top], 6), round(lead, 6)))
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_drift_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    noise = lambda n: rng.random(n)
    x, y, z = noise(300), noise(45), noise(260)
    tracks = {1: (x, np.r_[noise(40), x]), 2: (y, y[7:]), 3: (np.full(60, 0.4), noise(60)), 4: (z, np.r_[z[50:90], np.zeros(100), z[100:]]), 5: (noise(10), noise(90)), 6: (np.tile([0.0, 1.0, 0.3], 60), np.tile([0.0, 1.0, 0.3], 60))}
    rows = [(k, i, float(a[i]) if i < len(a) else None, float(b[i]) if i < len(b) else None) for k, (a, b) in tracks.items() for i in range(max(len(a), len(b)))]
    from spanweave.operators import timeline

    got = timeline.drift(spark.createDataFrame(rows, "key int, i int, a double, b double"), "key", 25, 10, 60, 4, block=block).collect()
    want = [(k, *w) for k, (a, b) in tracks.items() for w in plain_drift(a, b, 25, 10, 60, 4)]
    assert sorted((r.key, r.at, r["shift"], round(r.peak, 6), round(r.margin, 6)) for r in got) == want
    # a shift longer than the window is found wherever the segment lies within the dub
    assert {s for k, _, s, *_ in want if k == 1} == {40} and len([w for w in want if w[0] == 1]) == 28 and {s for k, _, s, *_ in want if k == 2} == {-7}


def test_timeline_helpers(spark):
    from spanweave.operators import timeline

    points = spark.createDataFrame([(1, 1, 10.0), (1, 2, 100.0), (1, 3, 170.0), (2, 1, 5.0)], "key int, id int, at_s double")
    windows = spark.createDataFrame([(1, 40.0, 1.5), (1, 115.0, -2.0)], "key int, center_s double, drift_s double")
    assert {(r.key, r.id): r.drift_s for r in timeline.drift_at(points, windows, ["key"], ["id"], 9.0).collect()} == {(1, 1): 1.5, (1, 2): -2.0, (1, 3): -2.0, (2, 1): 9.0}
    placed = timeline.concatenated(spark.createDataFrame([(1, float(i), float(i) + 0.1) for i in range(0, 50, 2)] + [(1, 100.0, 200.0)], "key int, start_s double, end_s double"), ["key"])
    chunks = timeline.chunked(placed, ["key"], 10.0).orderBy("at_s").collect()
    want, begin, n = [], None, -1
    for r in placed.orderBy("at_s").collect():
        if begin is None or r.at_s + r.to_s - r.from_s - begin > 10.0:
            begin, n = r.at_s, n + 1
        want.append(n)
    assert [r.chunk for r in chunks] == want and max(want) >= 2
    progress = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 3), (1, 4, 9), (1, 5, 9), (1, 6, 10)], "key int, t int, pct int")
    assert [r.t for r in timeline.monotone(progress, ["key"], ["t"], "pct").orderBy("t").collect()] == [1, 4, 6]
    samples = [(1, t, float(v)) for t, v in [(0.0, 0), (1.0, 10), (2.5, 4), (4.0, 4)]]
    got = {r.at_s: r.value for r in timeline.resampled(spark.createDataFrame(samples, "key int, at_s double, value double"), ["key"], 0.5).collect()}
    assert got == {t: float(np.interp(t, [0, 1, 2.5, 4], [0, 10, 4, 4])) for t in np.arange(0, 4.01, 0.5)}


def test_levels_of_speech(spark):
    lines = spark.createDataFrame([(1, 1, 1.0, 2.0), (1, 2, 8.0, 9.0)], "key int, line int, start_s double, end_s double")
    regions = spark.createDataFrame([(1, 1.2, 1.6), (1, 1.5, 1.8), (1, 5.0, 6.0)], "key int, start_s double, end_s double")
    frames = spark.createDataFrame([(1, k / 10, (k + 1) / 10, (k % 7 + 1) / 10, (k % 5 + 1) / 10) for k in range(100)], "key int, start_s double, end_s double, rms double, peak double")
    got = segments.levels_in_speech(lines, regions, frames, ["key"], ["line"], 5.0).collect()
    touched = [k for k in range(100) if k / 10 < 1.8 and (k + 1) / 10 > 1.2]
    power = (sum(((k % 7 + 1) / 10) ** 2 for k in touched) / len(touched)) ** 0.5
    assert [(r.line, r.level_db, r.peak_db) for r in got] == [(1, round(20 * np.log10(power), 1), round(20 * np.log10(max((k % 5 + 1) / 10 for k in touched)), 1))]
    level = segments.reference_level(frames, regions, ["key"], 5.0).first().reference_db
    inside = [(k % 7 + 1) / 10 for a, b in ((1.2, 1.6), (1.5, 1.8), (5.0, 6.0)) for k in range(100) if k / 10 >= a and (k + 1) / 10 <= b]
    assert level == round(20 * np.log10(float(np.median(inside))), 1)


def test_sung_lines(spark):
    frames = [(1, k / 10, (k + 1) / 10, 0.1, 0.2 if k < 100 else 0.01) for k in range(300)]
    df = spark.createDataFrame(frames, "key int, start_s double, end_s double, voice double, music double")
    lines = spark.createDataFrame([(1, 1, 4.0, 6.0), (1, 2, 20.0, 21.0), (1, 3, 90.0, 91.0)], "key int, line int, start_s double, end_s double")
    got = {r.line: (r.sung, r.sung_margin_db) for r in segments.sung(lines, df, ["key"], ["line"], 5.0).collect()}
    assert got == {1: (True, 6.0), 2: (False, -20.0), 3: (None, None)}


def test_inventories(spark):
    from spanweave.sources import files

    rows = [(1, "ep1 - Ann.wav", "a"), (1, "ep1 - Bob.wav", "b"), (1, "notes.txt", "c"), (2, "Solo.wav", "d")]
    got = files.tracks(spark.createDataFrame(rows, "key int, name string, path string"), ["key"]).collect()
    assert sorted((r.key, r.channel, r.channel_ord) for r in got) == [(1, "Ann", 1), (1, "Bob", 2), (2, "Solo", 1)]
    kinds = spark.createDataFrame([("a.srt", ""), ("x.mp4", ""), ("final_mix.wav", ""), ("Ann.wav", ""), ("Ann.wav", "Original"), ("z.pdf", "")], "n string, f string").select(files.classify(F.col("n"), F.col("f")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["script", "other", "original", "original", "original", "script"]
    registry = spark.createDataFrame([("A", 1, "alpha", ["first one"]), ("B", 2, "alphabet", [])], "entry string, ord int, key string, aliases array<string>")
    asked = spark.createDataFrame([("Alphabet",), ("First One",), ("alphab",), ("zz",)], "request string")
    assert {r.request: r.entry for r in files.resolve(asked, registry).collect()} == {"Alphabet": "B", "First One": "A", "alphab": "A"}
    v = spark.range(1).select(files.voice_ids(F.lit("Ann Hindi abcdefghij0123456789\nBob ABCDEFGHIJ0123456789zz")).alias("v")).first().v
    assert [(x.name, x.id) for x in v] == [("Ann Hindi", "abcdefghij0123456789"), ("Bob", "ABCDEFGHIJ0123456789zz")]


def test_remap_prunes_issues(spark):
    named = spark.createDataFrame([(1, "ann", "A", "name"), (1, "ann", "A2", "content"), (1, "bob", "B", "name"), (2, "ann", "A", "name")], "key long, speaker string, channel string, mapped_by string")
    issues = spark.createDataFrame([("rescued", 1, "ann", "A", None), ("grouped", 1, "cat", "B", None), ("twin_merged", 1, "bob", "B", None), ("name_mismatch", 1, "bob", "C", "ann"), ("rescued", 2, "ann", "A", None)], "kind string, key long, speaker string, channel string, other string")
    m, i = alignment.remap(named, issues, spark.createDataFrame([(1, "ann", "B")], "key long, speaker string, channel string"))
    assert sorted(map(tuple, m.collect())) == [(1, "ann", "B", "manual"), (2, "ann", "A", "name")]
    assert sorted((r.kind, r.key) for r in i.collect()) == [("grouped", 1), ("rescued", 2)]


def test_chunks_one_window_after_another(spark):
    """In batches of seven rows, so that recordings and chunks run over them."""
    from spanweave.operators import timeline

    rng = random.Random(9)
    rows, want = [], []
    for key in (None, *range(6)):
        at, begin, n = 0.0, None, -1
        for _ in range(rng.choice([1, 3, 60])):
            length = rng.choice([0.5, 3.0, 7.25, 25.0])
            if begin is None or at + length - begin > 20.0:
                begin, n = at, n + 1
            rows.append((key, 100.0 + at, 100.0 + at + length, at))
            want.append((key, at, n))
            at += length + 0.5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = timeline.chunked(spark.createDataFrame(rows, "key int, from_s double, to_s double, at_s double"), ["key"], 20.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.key, r.at_s, r.chunk) for r in got), key=repr) == sorted(want, key=repr)

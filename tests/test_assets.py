"""Deliveries, stored results, songs and re-scans against plain versions."""

import itertools
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.config import GATES
from spanweave.operators import gates, grouped, vectors
from spanweave.plans import reports
from spanweave.sources import assets, files


def plain_kind(name, folder):
    """From the rule: the extension as os.path splits it, then where the file is."""
    ext, at = os.path.splitext(name.lower())[1], (folder or "").lower()
    if ext in (".docx", ".doc", ".pdf", ".txt", ".srt", ".xlsx", ".csv"):
        return "script"
    if ext not in (".wav", ".flac", ".ogg", ".aif", ".aiff", ".mp3", ".m4a"):
        return "other"
    listed = ["track", "for ai", "voiceover", "vo", "dub", "stems", "speaker"]
    spoken = "malayalam tamil telugu kannada bengali marathi hindi punjabi mal tam tel kan ben mar hin".split()
    return "track" if any(w in at for w in listed) or any(re.search(rf"\b{w}\b", at) for w in spoken) else "original"


def test_files_are_classified_by_folder(spark):
    rng = random.Random(5)
    names = ["EP42_x.wav", "Ann_PREMIX.wav", "M&E.FLAC", "a.docx", "b.txt", "c.srt", "d.mp4", ".wav", "noext", "x..ogg", "y.wav.bak", "z.tsv", "..wav", "v.xlsx", ".a.mp3"]
    folders = [None, "", "misc", "tamil tracks", "MAL", "normal", "for ai", "Mar 3", "marble", "EP 4 VO", "a-hin-b", "hin_2", "Stems", "novo"]
    rows = [(n, f) for n, f in itertools.product(names, folders)] + [("".join(rng.choice(".aw v") for _ in range(6)) + ".wav", rng.choice(folders)) for _ in range(60)]
    df = spark.createDataFrame(rows, "n string, f string")
    got = [r[0] for r in df.select(files.classify(F.col("n"), F.col("f"))).collect()]
    assert got == [plain_kind(*r) for r in rows]
    assert plain_kind("EP42_x.wav", "misc") == "original" and plain_kind("Ann_PREMIX.wav", "tamil tracks") == "track"


def test_originals_fall_through_their_roles(spark):
    listed = [("m", 1, "S_#4_ST_MIX_long.wav"), ("m", 2, "S_#4_ST_MIX.wav"), ("m", 3, "S_#4_mix.wav"), ("p1", 4, "EP 5 stuff.wav"), ("p2", 5, "EP 5 PREMIX.wav"), ("p2", 6, "EP 5 a PREMIX.wav"), ("v", 7, "EP 6 a.mp4"), ("v", 8, "EP 6 b.MOV"), ("v", 9, "EP 4.mkv"), ("m", 10, "EP 7.wav")]
    roots = [("s", "mix", "m", 0), ("s", "premix", "p1", 1), ("s", "premix", "p2", 2), ("s", "video", "v", 3)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = assets.originals(df(listed, "folder string, id int, name string"), df(roots, "series string, role string, folder string, ord int"), df([("s", e) for e in (4, 5, 6, 7, 8)], "series string, episode int")).collect()
    assert {(r.episode, r.id) for r in got if r.default} == {(4, 2), (5, 5), (6, 8)}
    assert sorted(r.id for r in got if not r.default) == [1, 3, 4, 6, 7, 9, 10]


def test_mixes_and_speaker_sets(spark):
    folders = [("own", "o4", "EP 4"), ("own", "o4b", "EPI 4 again"), ("all", "a4", "Episode 4"), ("own2", "x5", "EP 5")]
    listed = [("o4", 1, "x_PREMIX.wav", 90), ("o4b", 2, "x_ST_MIX.wav", 90), ("a4", 3, "HINDI_MIX_R1.wav", 100), ("a4", 4, "HINDI_MIX_R2.wav", 95), ("a4", 5, "Tamil_MIX.wav", 40), ("x5", 6, "dialogue.wav", 10), ("x5", 7, "final mix.WAV", 10), ("x5", 8, "a.flac", 10)]
    roots = [("s", "Tamil", "own", 0, True), ("s", "Tamil", "all", 1, False), ("s", "Hindi", "all", 0, False), ("s", "Hindi", "own2", 1, True)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = df(folders, "parent string, id string, name string"), df(listed, "folder string, id int, name string, size long"), df(roots, "series string, lang string, folder string, ord int, own boolean"), df([("s", lang, e) for lang in ("Tamil", "Hindi") for e in (4, 5)], "series string, lang string, episode int")
    # the first folder of a root that names the episode counts, and a root without a mix gives way to the next
    assert {(r.lang, r.episode): (r.id, r.stage) for r in assets.dub_mixes(*args).collect()} == {("Tamil", 4): (1, "premix"), ("Hindi", 4): (4, "stmix"), ("Hindi", 5): (7, "stmix")}
    assert {(r.lang, r.episode): r.id for r in assets.dub_mixes(*args, stages=("dialogue", "mix")).collect()} == {("Tamil", 4): 5, ("Hindi", 4): 4, ("Hindi", 5): 6}
    sets = {(r.lang, r.episode): (r.id, r.tracks, r.short, r.uniform) for r in assets.speaker_sets(*args).collect()}
    assert sets == {("Tamil", 4): ("a4", 3, 1, False), ("Hindi", 4): ("a4", 3, 1, False), ("Hindi", 5): ("x5", 3, 0, True)}


def test_broken_results_cost_a_row_of_the_log(spark, tmp_path):
    whole = {"lang": "hi", "missing": 3, "characters": [{"id": "a"}]}
    for name, text in {"hi": json.dumps(whole, indent=1), "te": json.dumps({"lang": "te", "more": 1}), "cut": json.dumps(whole)[:-5], "list": "[1]", "empty": "", "blank": " \n", "kind": '{"lang": "x", "missing": "many"}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    schema = T.StructType.fromDDL("lang string, missing long, characters array<struct<id:string>>")
    rows, skipped = files.read_results(spark, [str(tmp_path)], schema)
    assert sorted((r.lang, r.missing, len(r.characters or [])) for r in rows.drop("path").collect()) == [("hi", 3, 1), ("te", None, 0)]
    log = {os.path.basename(r.path): (r.reason, r.bytes) for r in skipped.collect()}
    assert {k: v[0] for k, v in log.items()} == {"cut.json": "broken", "list.json": "no object", "blank.json": "empty", "kind.json": "broken"} and log["blank.json"][1] == 2
    assert files.latest_results(rows, ["lang"], "missing").count() == 2


def test_markers_are_read_and_refused(spark, tmp_path):
    def given(text):
        (tmp_path / "m.csv").write_text(text, encoding="utf-8")
        return files.read_markers(spark, str(tmp_path / "m.csv"))

    rows = given("﻿No.,In,Color,Name,Comment\n1,00:00:00:01,red, Ann ,x\n2,00:00:01:00,red,Bob,\n").orderBy("no").collect()
    assert [(r.no, r.name, r.comment, r.position) for r in rows] == [(1, "Ann", "x", 1920), (2, "Bob", "", 48000)]
    assert given("No.,In,Color,Name,Comment\n").collect() == []
    for text, said in {"In,Name\n": "no column", "In,Name,Comment\n00:00:01:00, ,x\n": "blank name", "In,Name,Comment\n00:00:02:00,a,\n00:00:01:00,b,\n": "time order", "In,Name,Comment\n00:60:00:00,a,\n": "."}.items():
        with pytest.raises(Exception, match=said):
            given(text).collect()


def test_reports_are_asked_and_written(spark, tmp_path):
    rows = [("hi", "MISSING", "Ann", 5.0, 1), ("hi", "EXTRA", "Bob", 1.0, 2), ("te", "MISSING", "Joanna", 0.5, 3), ("te", "MISSING", None, 0.1, 4), ("hi", "MISSING", "annie", 2.0, 5)]
    f = spark.createDataFrame(rows, "lang string, type string, character string, start_s double, line int")
    ask = lambda **o: [r.line for r in reports.find(f, **o).collect()]
    assert ask() == [2, 5, 1, 4, 3] and ask(limit=2) == [2, 5] and ask(language="HI") == [2, 5, 1]
    assert ask(kind=" missing ") == [5, 1, 4, 3] and ask(character=" ANN") == [5, 1, 3] and ask(language="te", kind="extra") == []
    heard = spark.createDataFrame([("EXTRA", 0.0, 1.4), ("EXTRA", 0.0, 1.5), ("EXTRA", None, 9.0), ("MISSING", None, None)], "type string, audio_start_s double, audio_end_s double")
    assert [(r.type, r.audio_end_s) for r in reports.on_screen(heard).collect()] == [("EXTRA", 1.5), ("MISSING", None)]
    reports.write_report(f, str(tmp_path / "r"))
    assert sorted(r.line for r in spark.read.json(str(tmp_path / "r")).collect()) == [1, 2, 3, 4, 5]
    markers = spark.createDataFrame([(2, "00:00:02:00", "b"), (1, "00:00:01:00", 'a, "x"')], "no int, at string, name string")
    reports.write_markers(markers, str(tmp_path / "m"))
    assert [(r.no, r.name) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "m")).collect()] == [("1", 'a, "x"'), ("2", "b")]


def plain_songs(missing, bank):
    """One line after another, from the rule."""
    words = lambda t: set(re.findall("[0-9a-zA-ZÀ-ɏऀ-ൿ]{2,}", t.lower()))
    blocked = sorted((m for m in missing if m["block"] is not None), key=lambda m: (m["at"], m["line"]))
    lyrics = [(m["block"], words(m["text"])) for m in blocked] + ([(None, bank)] if bank else [])
    lyrics = [x for x in lyrics if len(x[1]) >= 3]
    tags = {}
    for m in missing:
        w = words(m["text"])
        if m["block"] is not None or len(m["text"].split()) < 3 or len(m["text"].strip()) < 10 or len(w) < 3:
            continue
        hit = next((b for b, bw in lyrics if len(w & bw) >= 3 and len(w & bw) >= 0.75 * len(w)), "none")
        if hit != "none":
            tags[m["line"]] = ("bank" if hit is None else "block", hit)
    anchors = sorted(m["at"] for m in missing if m["line"] in tags or any(len(words(m["text"]) & bw) >= 2 for _, bw in lyrics))
    spans, run = [], []
    for t in [*anchors, float("inf")]:
        if run and t - run[-1] > GATES.cluster_gap_s:
            if len(run) >= 2:
                spans.append((run[0] - GATES.cluster_edge_s, run[-1] + GATES.cluster_edge_s))
            run = []
        run.append(t)
    for m in missing:
        if m["block"] is None and m["line"] not in tags and any(a <= m["at"] <= b for a, b in spans):
            tags[m["line"]] = ("between", None)
    return tags


@pytest.mark.parametrize("seed", range(3))
def test_song_tags_one_line_after_another(spark, seed):
    rng = random.Random(seed)
    bank = {"eu", "sei", "que", "diz"} if seed else set()
    vocabulary = ["eu", "sei", "que", "diz", "amor", "noite", "ver", "lua", *(f"word{k}" for k in range(40))]
    missing = [{"line": k, "at": float(rng.randrange(3000)), "text": " ".join(rng.choice(vocabulary[: rng.choice([8, 48])]) for _ in range(rng.randrange(1, 7))), "block": rng.choice([None, None, None, 1, 2])} for k in range(70)]
    df = spark.createDataFrame([("k", m["line"], m["at"], m["text"], m["block"]) for m in missing], "key string, line int, at_s double, text string, block int")
    words = spark.createDataFrame([("k", w) for w in bank], "key string, word string") if bank else None
    got = {r.line: (r.source, r.block) for r in gates.song_tags(df, ["key"], bank=words).collect()}
    want = plain_songs(missing, bank)
    assert got == want and {"block", "between"} <= {s for s, _ in want.values()}


def test_rescan_finds_what_lost_its_window(spark):
    rng = np.random.default_rng(3)
    frames = rng.normal(size=(300, 16))
    rate, w = 10.0, 1.5
    unit = lambda v: v / np.linalg.norm(v)
    pooled = lambda at: unit(frames[int(np.ceil(at * rate - 1e-6)) : int(np.ceil((at + w) * rate - 1e-6))].mean(axis=0))
    half = unit(pooled(12.0) + 1.3 * unit(rng.normal(size=16)))
    flags = [(1, 10.0, w, pooled(11.2)), (2, 10.0, w, pooled(14.0)), (3, 0.3, w, pooled(0.0)), (4, 29.9, w, pooled(28.5)), (5, 12.4, w, half), (6, 5.0, 31.0, pooled(5.0))]
    f = spark.createDataFrame([("k", i, at, n, v.tolist()) for i, at, n, v in flags], "key string, flag int, at_s double, window_s double, vector array<double>")
    df = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(frames)], "key string, i int, vector array<double>")
    got = {r.flag: r for r in vectors.rescan(f, df, "key", rate).collect()}
    for i, at, n, v in flags[:5]:
        low = max(0.0, min(at - 2, 30 - n))
        high = max(low, min(30 - n, at + 2))
        grid = [round(low + k * 0.4, 2) for k in range(int((high - low) / 0.4 + 1e-9) + 1)]
        best = max(grid, key=lambda s: (round(float(pooled(s) @ v), 9), -s))
        assert got[i].at_s == pytest.approx(best) and got[i].sim == pytest.approx(float(pooled(best) @ v))
    assert {i for i, r in got.items() if r.cleared} == {1, 3, 4, 5} and 0.6 <= got[5].sim < 0.75 and set(got) == {1, 2, 3, 4, 5}


def test_groups_run_over_batches(spark):
    rows = [(k % 37 if k % 5 else None, k, float(k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, i long, x double").repartition(3)
    import pyarrow as pa

    def total(table, starts):
        x = grouped.column(table, "x")
        return pa.RecordBatch.from_arrays([table["key"].take(pa.array(starts)).combine_chunks(), pa.array(np.add.reduceat(x, starts))], ["key", "x"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(((r.key, r.x) for r in grouped.map_groups(df, ["key"], ["i"], total, "key long, x double").collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, _, x in rows:
        want[k] = want.get(k, 0.0) + x
    assert got == sorted(want.items(), key=repr)

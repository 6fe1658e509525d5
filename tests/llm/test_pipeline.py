"""The pipeline's stages against brute force on the smallest tables."""

from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spanweave.llm import quality, secrets, simhash, stages
from spanweave.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs, read_table(spark, SF, "labels")).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}

    once = corpus_pipeline.exact_dedup(spark, kept, SF).cache()
    last = {}
    for r in kept.collect():
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert once.columns == columns and {r.doc_id for r in once.collect()} == set(last.values())

    apart = corpus_pipeline.simhash_dedup(spark, once, SF).cache()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in once.collect()}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] > root[b]:
                    root[a], changed = root[b], True
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == set(root.values())

    clean = corpus_pipeline.secret_scan(spark, apart, SF).cache()
    texts = {r.doc_id: r.text for r in apart.collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == set(texts)
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        if not secrets.base_spans(texts[r.doc_id]) and not secrets.free_runs(texts[r.doc_id], []):
            assert r.text == texts[r.doc_id]
        assert not [s for s in secrets.base_spans(r.text) if s[0] in (1, 2)]

    packed = defaultdict(list)
    pieces = corpus_pipeline.best_fit_packing(spark, clean, SF).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    for r in pieces:
        packed[r.sequence_id].append((r.offset, r.length))
    for parts in packed.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=True):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    return df.select("*", *(F.lit(7).alias(c) for c in ("kept", "fp", "component_id", "keep_id", "stratum", "spans", "plain", "quality", "key", "again", "KEY_", "_stage_key", "_stage_again", "digest"))) if extra else df


GOOD = " ".join(f"word{i} is here" for i in range(40))
ROWS = [(1, None), (2, ""), (3, GOOD), (3, GOOD), (3, "short"), (4, GOOD + " password = abcdefgh12345678 end"), (None, GOOD + " x"), (None, GOOD + " x"), (None, "bad"), (5, "long " * 30_000), (6, GOOD + " x")]


def stage_rows(spark, name, rows):
    df = table(spark, rows)
    labels = spark.createDataFrame([(3, 1), (4, 1), (None, 0)], "doc_id long, quality int")
    run = {"quality": lambda: stages.accepted(df, labels), "exact": lambda: stages.distinct_texts(df), "near": lambda: stages.representatives(df), "secrets": lambda: stages.redacted(df)}[name]
    out = run()
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


@pytest.mark.parametrize("name", ["quality", "exact", "near", "secrets"])
def test_edges_of_stages(spark, name):
    assert stage_rows(spark, name, []) == []
    got = stage_rows(spark, name, ROWS)
    if name == "quality":
        assert got == sorted([x for x in ROWS if x[1] and x[1].startswith(GOOD)], key=repr)
    elif name == "exact":
        last = {}
        for d, t in ROWS:
            last[t or ""] = max(-1 if d is None else d, last.get(t or "", -1))
        assert sorted((-1 if d is None else d, t or "") for d, t in got) == sorted((d, t) for t, d in last.items())
        assert len(got) == len(last)
    elif name == "near":
        assert len(got) == len(set(got)) and (3, GOOD) in got and (3, "short") in got
    else:
        assert len(got) == len(ROWS) and any(t and t.endswith("password = [assign] end") for _, t in got)


def test_colliding_hashes_lose_no_document(spark, monkeypatch):
    """Texts whose chunk identifiers and doc_ids all collide are still two documents."""
    rows = [(7, GOOD + f" {i}") for i in range(20)] * 2
    exact = stages.exact_dedup.exact_dedup
    monkeypatch.setattr(stages.exact_dedup, "exact_dedup", lambda docs: exact(docs, identify=lambda c: F.lit(1).cast("long")))
    assert stage_rows(spark, "exact", rows) == sorted(set(rows), key=repr)


def test_secret_stage_without_n_chars(spark):
    df = table(spark, ROWS, extra=False).drop("n_chars")
    assert stages.redacted(df).columns == df.columns and stages.redacted(df).count() == len(ROWS)

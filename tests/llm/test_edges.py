"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanweave.llm import exact_dedup, filter_audit, html_text, packing, quality, secrets, sentencepiece_codec, sharding, simhash, spelling, substring_dedup, url_filter, warc

LONG = "word " * 30_000 + "x" * 50_000
ROWS = [(1, None), (2, ""), (3, LONG), (4, "a b c d"), (4, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, None), (6, " \n\t "), (7, "é 你好 😀 ▁ <s>")]
CLASHING = "text_sha256 kept fp d rid length rank spans ids recipe keep_id stratum salt sequence_id offset digest page payload kmer pos n word head tail key near best bucket position rank slot part first A B cell good toxic".split()


def docs(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING))


def pages(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, u) for r, u in zip(rows, [None, "", "no scheme", "http://a.COM", "http://A.com/x", "https://x.net/fr/1?a=1&b#c", "http://", "http://x.example.com/en/", "http://é.org/ü", "ftp://a.net/es/"], strict=False)], "page_id long, html string, url string")
    return df.select("*", *(F.lit(7).alias(c) for c in [*CLASHING, "host", "path", "ruled", "suffix", "section", "first"]))


def labels(spark):
    return spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")


PIECE, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
RUNS = {
    "packing": lambda s, d: packing.pack(d, BPE),
    "substring": lambda s, d: substring_dedup.remove_repeats(d),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "sentencepiece": lambda s, d: sentencepiece_codec.round_trip(d, PIECE),
    "secrets": lambda s, d: secrets.digests(secrets.find_secrets(d)),
    "quality": lambda s, d: quality.quality_rules(d, labels(s)),
    "simhash": lambda s, d: simhash.simhash_components(d),
}
PAGE_RUNS = {
    "urls": lambda p: url_filter.judge_urls(p),
    "html": lambda p: html_text.extract(p),
    "warc": lambda p: warc.round_trip(p),
}


@pytest.mark.parametrize("name", RUNS)
def test_documents(spark, name):
    rows = RUNS[name](spark, docs(spark)).collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {i for i, _ in ROWS}
        assert sum(r.piece == 0 for r in rows) == len(ROWS)
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    assert RUNS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", PAGE_RUNS)
def test_pages(spark, name):
    rows = PAGE_RUNS[name](pages(spark)).collect()
    assert sorted(str(r.page_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    assert PAGE_RUNS[name](pages(spark, [])).collect() == []


def test_words_shards_and_audits(spark):
    """The three operators whose rows are no documents, or that need a source."""
    rows = docs(spark)
    assert [(r.word, r.n, r.n_near, r.form) for r in spelling.spelling_variants(rows, damage=199).collect()] == []
    frequent = docs(spark, [(i, "Wordone WORDONE wordtwo, wordon\u00e9 " * 3) for i in (1, 1, None)])
    assert sorted((r.word, r.n) for r in spelling.spelling_variants(frequent, damage=None).collect()) == [("wordone", 18), ("wordon\u00e9", 9), ("wordtwo", 9)]
    placed = sharding.assign(rows.withColumn("source", F.lit(None).cast("string")), shards=3).collect()
    assert sorted(str(r.doc_id) for r in placed) == sorted(str(i) for i, _ in ROWS) and sorted((r.shard, r.slot) for r in placed) == [(k, s) for k, n in ((0, 4), (1, 3), (2, 3)) for s in range(n)]
    said = spark.createDataFrame([(4, 1, None), (4, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    audit = filter_audit.filter_audit(rows, said, part_col="lang").where("filter_order = 'EABCD'").orderBy("step").collect()
    # documents 2 and 5 repeat 1 and 4; of the rest one has 50 words
    assert [(r.part, r.removed, r.kept) for r in audit][:2] == [("", 2, 8), ("", 7, 1)] and {r.good_lost for r in audit} == {0, 2}
    assert sharding.assign(docs(spark, []).withColumn("source", F.lit("s"))).collect() == [] and spelling.spelling_variants(docs(spark, [])).collect() == []

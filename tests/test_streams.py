"""Listings and watched runs, batch by batch and over restarts."""

import json
import shutil

import pytest

from spanweave.sources.listing import PagedListing, pages
from spanweave.streaming import stores, watch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page(base, folder, marker, entries, after=None):
    (base / folder).mkdir(parents=True, exist_ok=True)
    (base / folder / f"{marker}.json").write_text(json.dumps({"entries": [{"id": i, "type": t, "name": n, "size": 5} for i, t, n in entries]} | ({"next_marker": after} if after else {})))


def store(base):
    page(base, "a", "start", [("1", "file", "x.wav"), ("s", "folder", "sub")], "m1")
    page(base, "a", "m1", [("2", "file", "y.wav")], "m2")
    page(base, "a", "m2", [("3", "file", "z.docx")])
    page(base, "s", "start", [("4", "file", "deep.wav")])
    page(base, "b", "start", [("5", "file", "b.wav")])


def test_pages_are_followed_and_folders_reported(spark, tmp_path):
    store(tmp_path)
    spark.dataSource.register(PagedListing)
    ask = lambda **o: spark.read.format("paged_listing").options(base=str(tmp_path), **o).load()
    rows = ask(folders="a,b,nowhere").collect()
    assert sorted((r.folder, r.id) for r in rows if r.error is None) == [("a", "1"), ("a", "2"), ("a", "3"), ("a", "s"), ("b", "5")]
    assert [(r.folder, r.id, r.name) for r in rows if r.error] == [("nowhere", "nowhere", None)] and "FileNotFoundError" in [r.error for r in rows if r.error][0]
    assert ask(folders="a,b").rdd.getNumPartitions() == 2
    assert {(r.id, r.path, r.depth) for r in ask(folders="a", depth=1).collect()} >= {("4", "/sub/deep.wav", 1), ("1", "/x.wav", 0)}
    page(tmp_path, "b", "start", [("5", "file", "b.wav")], "start")
    with pytest.raises(ValueError, match="comes again"):
        list(pages(str(tmp_path), "b"))
    (tmp_path / "s" / "start.json").write_text("{broken")
    shut = [r for r in ask(folders="a", depth=1).collect() if r.error]
    assert [(r.id, r.path, r.depth) for r in shut] == [("s", "/sub", 1)]


def test_stream_gives_what_is_new(spark, tmp_path):
    base = tmp_path / "base"
    store(base)
    spark.dataSource.register(PagedListing)

    def poll(n):
        listing = spark.readStream.format("paged_listing").options(base=str(base), folders="a,b", snapshots=str(tmp_path / "snap")).load()
        q = listing.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.folder, r.id, r.error is not None) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = poll(0)
    assert first == [("a", "1", False), ("a", "2", False), ("a", "3", False), ("a", "s", False), ("b", "5", False)]
    page(base, "a", "m2", [("3", "file", "renamed.docx"), ("6", "file", "new.wav")])
    shutil.move(base / "b", base / "away")
    second = poll(1)
    assert second == sorted([*first, ("a", "6", False), ("b", "b", True)])
    # what comes back was known
    shutil.move(base / "away", base / "b")
    assert poll(2) == second


def test_runs_are_announced_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = "run string, at timestamp, settled boolean, text string"

    def feed(k, *rows):
        made = spark.createDataFrame([(r, s, d, t) for r, s, d, t in rows], "run string, s long, settled boolean, text string")
        made.selectExpr("run", "timestamp_seconds(1700000000 + s) AS at", "settled", "text").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # every call is a restart from the checkpoint
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = watch.announcements(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return sorted((r.run, r.kind, int(r.s) - 1700000000, r.text) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("*", "unix_timestamp(at) AS s").collect())

    try:
        assert feed(0, ("a", 0, False, "began"), ("b", 5, False, "began")) == []
        a = ("a", "settled", 60, "done")
        assert feed(1, ("a", 60, True, "done"), ("a", 61, True, "again"), ("b", 70, False, "half")) == [a]
        assert feed(2, ("a", 90, True, "third")) == [a]
        # b never settles: 5,400 s after it was first seen the watermark passes its timer; a was forgotten 3,600 s after its end
        b = ("b", "stale", 5405, "half")
        assert feed(3, ("tick", 5500, False, "x")) == [a, b]
        assert feed(4, ("a", 5600, True, "new run"), ("b", 5601, True, "late")) == sorted([a, b, ("a", "settled", 5600, "new run")])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_drop_what_is_late(spark, tmp_path):
    def feed(*seconds):
        spark.createDataFrame([(s,) for s in seconds], "s long").selectExpr("timestamp_seconds(s) AS at", "'k' AS k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counted = stores.windowed_counts(stores.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "at", ["k"], "10 seconds", "5 seconds")
        q = counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)

    feed(1, 2, 12)
    feed(40)
    feed(3, 60)  # 3 comes after its window was closed
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("unix_timestamp(start) AS s", "n").collect()
    assert sorted((r.s, r.n) for r in got) == [(0, 2), (10, 1), (40, 1)]

"""Shards against a sort of all rows, and their mixture."""

import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from spanweave.llm import sharding


def made_up(n=700):
    rng = random.Random(3)
    return [(rng.choice([None, i]), rng.choice([None, "", "é😀", "x" * rng.randint(0, 99)]), rng.choice(["hot", "hot", "hot", "b", "c", None, f"own{i}"])) for i in range(n)]


def brute(rows, shards, seed):
    def digest(text):
        return hashlib.md5(text.encode()).hexdigest()

    keyed = [(s or "", digest(f"{seed}:{'' if i is None else i}:{hashlib.sha256((t or '').encode()).hexdigest()}"), -1 if i is None else i, t or "") for i, t, s in rows]
    sizes, seen, spread = Counter(k[0] for k in keyed), Counter(), []
    for s, k, i, t in sorted(keyed):
        spread.append(((seen[s] + int(digest(f"{seed}:{s}")[:13], 16) / 2**52) / sizes[s], s, k, i, t))
        seen[s] += 1
    out, slots = [], Counter()
    for p, (_, _, _, i, t) in enumerate(sorted(spread)):
        shard = p * shards // len(rows)
        out.append((i, len(t.encode()) + 16, zlib.crc32(t.encode()), shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_against_one_sort(spark):
    rows = made_up()
    for shards, buckets in ((40, 1 << 14), (7, 16), (1000, 64)):
        got = sharding.assign(frame(spark, rows), shards=shards, seed=5, buckets=buckets)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got.collect()) == brute(rows, shards, 5)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, str(i), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(6000)]
    got = sharding.assign(frame(spark, rows), shards=20).groupBy("shard", "source").count().collect()
    share = Counter(s for _, _, s in rows)
    counts = {(r["shard"], r["source"]): r["count"] for r in got}
    assert all(abs(counts.get((k, s), 0) - n / 20) <= 2 for k in range(20) for s, n in share.items())


def test_seed_shuffles_and_offsets(spark):
    rows = [(i, "t", f"only{i}") for i in range(400)]
    a, b = ({r.doc_id: r.shard for r in sharding.assign(frame(spark, rows), shards=4, seed=s).collect()} for s in (1, 2))
    assert Counter(a.values()) == Counter(b.values()) == {k: 100 for k in range(4)} and a != b


def test_written_shards_hold_all_columns_in_slot_order(spark, tmp_path):
    df = frame(spark, made_up()).withColumn("shard", F.lit("x")).withColumn("row", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("a.b", F.lit(3))
    sharding.write_shards(df, str(tmp_path / "out"), shards=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {"doc_id", "text", "source", "row", "bucket", "a.b", "slot", "shard"} and back.count() == 700
    for k in range(6):
        rows = [r for f in sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.slot)] is not None and [r.slot for r in rows] == sorted(r.slot for r in rows)
    placed = Counter((r.shard, r.slot, r.text or "") for r in back.collect())
    wanted = sharding.assign(df, shards=6, carry=("text",)).collect()
    assert placed == Counter((r.shard, r.slot, r.text or "") for r in wanted)


def test_empty_small_and_native(spark):
    assert sharding.assign(frame(spark, [])).collect() == []
    one = sharding.assign(frame(spark, [(None, None, None)]))
    assert [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in one.collect()] == [(None, 16, 0, 0, 0)]
    same = sharding.assign(frame(spark, [(1, "a", "s")] * 90), shards=4)
    assert Counter(r.shard for r in same.collect()) == {0: 23, 1: 22, 2: 23, 3: 22}
    plan = one._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

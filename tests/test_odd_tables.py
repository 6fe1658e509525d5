"""Queries against their SQL over small tables that hold what the supplied ones lack."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from spanweave.operators import vectors

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def both(spark, folder, name, **tables):
    """The rows of a query and those of its SQL over tables given as (rows, schema), columns by name, sorted."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    found = con.execute(SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)


def test_episode_numbers_in_paths(spark, tmp_path):
    urls = {
        "http://a.com/en/197533?page=2": None, "http://a.com/en/9999": 9999, "http://a.com/de/00012/x": 12, "http://a.com/de/000012345": None, "http://a.com/fr/0000": 0,
        "http://a.com/x/en/5#12": 5, "http://a.com/en/12345/de/7": 7, "http://a.com/en/about#3": None, "http://a.com/en/ep-12": None, "/xx/8": 8, "HTTP://A.COM/EN/44": 44,
        "a/\u0130i/7": 7, "http://a.com/en/12\u00e9": 12, "http://a.com/en/\uff11\uff12": None, "http://a.com/en/6\r\nx": 6, "": None, None: None,
    }
    got, want = both(spark, tmp_path, "episode_number", pages=(list(enumerate(urls)), "page_id long, url string"))
    assert got == want and {r[0]: r[1] for r in got} == dict(enumerate(urls.values()))


EVENT = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"


def events(*rows):
    """Events as (user, type, value, seconds), numbered in order."""
    return [(n, user, kind, value, s if s is None else datetime(2024, 1, 1) + timedelta(seconds=s)) for n, (user, kind, value, s) in enumerate(rows)], EVENT


def test_frames_that_begin_together(spark, tmp_path):
    told = events((1, "purchase", 1.0, 500), (1, "view", 0.9, 500), (1, "click", 200.0, 500), (1, "error", 200.0, 500), (2, "purchase", 0.5, 0), (2, "view", 498.3, 10), (3, "purchase", 2.0, 0))
    got, want = both(spark, tmp_path, "levels_in_speech", events=told)
    assert list(map(repr, got)) == list(map(repr, want)) and len(got) == 2


def test_windows_that_start_together(spark, tmp_path):
    """The SQL leaves the order of such windows open, so these rows are held to the order that the operator states."""
    told, schema = events((1, "click", 1.0, 100), (1, "click", 0.5, 100), (1, "click", 0.5, 100), (1, "click", 0.1, 90), (1, "click", 0.1, 5_000))
    spark.createDataFrame(told[::-1], schema).coalesce(1).write.parquet(f"{tmp_path}/1/events.parquet")
    spark.createDataFrame(told, schema).coalesce(1).write.parquet(f"{tmp_path}/2/events.parquet")
    for k in (1, 2):
        rows = QUERIES["concat_timeline"](spark, f"{tmp_path}/{k}").collect()
        assert {r.id: r.at_s for r in rows} == {3: 0.0, 1: 70.0, 2: 380.0, 0: 690.0, 4: 1300.0}
        assert all(r.to_s - r.from_s == told[r.id][3] * 600 + 5 for r in rows)


def test_windows_without_a_start(spark, tmp_path):
    told = events((1, "click", 1.0, 100), (1, "click", 0.5, None), (1, "click", 0.5, 50), (1, "click", None, 70))
    got, want = both(spark, tmp_path, "concat_timeline", events=told)
    assert got == want and len(got) == 4


def most_rows(df):
    """The rows of the longest output of a step of a plan that has run."""
    name = lambda node: node.getClass().getSimpleName()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        inner = node.executedPlan() if name(node) == "AdaptiveSparkPlanExec" else node.plan() if name(node).endswith("QueryStageExec") else None
        children = node.children()
        todo += [inner] if inner else [children.apply(i) for i in range(children.size())]
    return most


CUSTOMER, SUPPLIER = "c_custkey long, c_nationkey int", "s_suppkey long, s_nationkey int"


def test_voices_of_many_alike(spark, tmp_path):
    """Keys whose names and channels are the same: no step makes the 120,000 pairs of rows."""
    told = dict(customer=([(10_100 * i + 3, 1) for i in range(400)], CUSTOMER), supplier=([(30_300 * j + 6, 1) for j in range(300)], SUPPLIER))
    got, want = both(spark, tmp_path, "voice_match", **told)
    assert got == want and len(got) == 400
    df = QUERIES["voice_match"](spark, str(tmp_path))
    df.collect()
    assert 400 <= most_rows(df) <= 800


def test_voices_of_odd_keys(spark, tmp_path):
    customers = [(i * 37 % 1009, i % 7 or None) for i in range(300)] + [(None, 1), (5, 2), (5, 3), (5, 3)]
    suppliers = [(j * 53 % 811, j % 5 or None) for j in range(200)] + [(None, 1), (9, 4), (9, 4), (10**12 + 1, 6)]
    got, want = both(spark, tmp_path, "voice_match", customer=(customers, CUSTOMER), supplier=(suppliers, SUPPLIER))
    assert got == want and len(got) > 100


def test_voices_of_keys_below_zero(spark, tmp_path):
    customers, suppliers = [(i * 37 % 1009 - 500, i % 7) for i in range(300)], [(j * 53 % 811 - 400, j % 7) for j in range(60)]
    got, want = both(spark, tmp_path, "voice_match", customer=(customers, CUSTOMER), supplier=(suppliers, SUPPLIER))
    assert got == want and min(got)[0] < 0 and min(r[1] for r in got) < 0


EMBEDDING = "vec_id long, embedding array<float>, label int"


def test_best_of_many_vectors(spark, tmp_path):
    """One label holds all: no step makes the pairs of 100 queries with 2,000 vectors, however few a block holds."""
    rng = np.random.default_rng(1)
    told = [(i, rng.normal(size=8).round(3).tolist(), 1) for i in range(2_000)]
    got, want = both(spark, tmp_path, "cosine_best", embeddings=(told, EMBEDDING))
    assert got == want and len(got) == 100
    df = QUERIES["cosine_best"](spark, str(tmp_path))
    df.collect()
    assert 2_000 <= most_rows(df) <= 2_200
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    for block in ((7, 7), (150, 400), (1, 1_999)):
        best = vectors.best_inner(e.where("vec_id % 20 = 0"), e, ["label"], "vec_id", "embedding", block)
        assert sorted((r.vec_id, round(r.sim, 4)) for r in best.collect()) == sorted(got)


def test_best_of_odd_vectors(spark, tmp_path):
    """Ids given twice, equal vectors, labels and vectors that are null, lone ones, and labels whose vectors have another length."""
    told = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [0.0, 2.0], 1), (20, None, 1), (40, [1.0, 1.0], 2), (40, [3.0, 1.0], 2), (60, [1.0, 2.0, 3.0], 3), (80, [1.0, 2.0, 3.0], 3)]
    told += [(100, [1.0], 4), (101, None, 4), (120, [1.0], None), (121, [1.0], None), (None, [9.0, 9.0], 1), (140, [1.0], 5), (0, [-5.0], 6), (7, [float("inf")], 6), (160, [-1.0], 7), (161, [2.0], 7), (180, [float("nan")], 8), (181, [2.0], 8)]
    told += [(201, [1.0, 2.0], 9), (202, [1.0], 9), (203, [None], 9)]  # nobody asks for these, so they may be of any length
    got, want = both(spark, tmp_path, "cosine_best", embeddings=(told, EMBEDDING))
    assert list(map(repr, got)) == list(map(repr, want))
    assert {r[0] for r in got} == {0, 20, 60, 80, 100, 160, 180} and dict(got)[20] is None and dict(got)[100] is None


@pytest.mark.parametrize("odd", [[1.0, 2.0], [1.0, None, 2.0]])
def test_vectors_that_cannot_be_compared(spark, tmp_path, odd):
    told = [(0, [1.0, 0.0, 2.0], 1), (1, odd, 1)]
    spark.createDataFrame(told, EMBEDDING).write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="must have one length"):
        QUERIES["cosine_best"](spark, str(tmp_path)).collect()

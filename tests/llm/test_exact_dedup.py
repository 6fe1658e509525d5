import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from spanweave.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def made_up():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab. \n😀") for _ in range(rng.choice([0, 3, 900, 5000, 9000]))) for _ in range(25)]
    return [(i, rng.choice([*texts, None])) for i in range(200)]


def test_against_brute_force(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect())) == brute(rows)


def test_colliding_identifiers_are_told_apart(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda c: F.pmod(F.length(c), F.lit(3)).cast("long")
    assert sorted(map(tuple, exact_dedup.exact_dedup(df, identify=weak).collect())) == brute(rows)


def test_chunks_join_to_the_text_and_move_with_it(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["one", "two", "three", "four", "five", "six", "end."]) for _ in range(20_000))
    df = spark.createDataFrame([(text,), ("shifted by this. " + text,)], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    a, b = df.collect()
    assert "".join(a.c) == a.t and "".join(b.c) == b.t
    assert max(map(len, a.c)) <= exact_dedup.MAX_CHUNK
    assert len(set(a.c) & set(b.c)) > len(a.c) / 2


def test_plan_has_no_python(spark):
    plan = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""The audit against filters applied one after another."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from spanweave.llm import filter_audit


def fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and i > least[t]
        out.append({f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), e), strict=True) if x})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    failed, out = fails(rows), {}
    parts = {s or "" for _, _, s in rows}
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(rows)))
        gone = []
        for k, f in enumerate(order, 1):
            hit = [r for r in left if f in failed[r]]
            left = [r for r in left if f not in failed[r]]
            for p in parts:
                mine = lambda rs, p=p: [r for r in rs if (rows[r][2] or "") == p]
                out[p, order, k] = [len(mine(left)), len(mine(hit)), sum(f in failed[r] for r in mine(gone)), sum(failed[r] == {f} for r in mine(range(len(rows)))), sum(rows[r][0] in good for r in mine(hit)), sum(rows[r][0] in toxic for r in mine(hit))]
            gone += hit
    shapley = Counter()
    for (p, order, k), v in out.items():
        shapley[p, order[k - 1]] += v[1]
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def made_up(seed, n=150):
    rng = random.Random(seed)
    texts = [rng.choice([" ", "\n", " ", "\x0b"]).join(rng.choice(["Alpha", "beta", "GAMMA", "d", "été", "a#b", *map(str, range(80))][: rng.choice([5, 60, 86])]) for _ in range(rng.choice([0, 1, 49, 50, 51, 90]))) for _ in range(60)]
    return [(rng.choice([i, i, i, None, 3]), rng.choice([*texts, None]), rng.choice(["a", "b", None, ""])) for i in range(n)]


def test_against_filters_one_after_another(spark):
    rows = made_up(8)
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(120), 3, 3, 999]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("part", "digest", "first", "good", "A", "n", "subset", "quality"):
        df = df.withColumn(c, F.lit(1))
    got = filter_audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    labels = [x for x in labels if x[0] is not None]
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got) == 3 * 600
    assert found == brute(rows, labels)


def test_more_filters_and_empty_tables(spark):
    rows = [("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, False, False) for i in range(30)]
    flagged = spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    got = filter_audit.audit(flagged, "XYZ").collect()
    kept = defaultdict(set)
    for r in got:
        kept[r.step].add(r.kept)
    assert len(got) == 18 and kept[3] == {sum(not (x or y or z) for _, x, y, z, *_ in rows)}
    empty = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(*empty).collect() == []


def test_plan_is_a_cube_without_python(spark):
    flagged = spark.createDataFrame([("p", True, False, False, False)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    plan = filter_audit.survivors(flagged, "XY")._jdf.queryExecution().toString()
    assert "Expand" in plan and "Python" not in plan

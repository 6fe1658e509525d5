import math
import random
from collections import Counter

from pyspark.sql import functions as F

from spanweave.llm import url_filter


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, str(max(fits, key=lambda r: len(str(r)))) if fits else None


def urls(n=3000):
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    return ["http" + pick("", "s") + pick("://", "://", "://", ":/") + pick("", "www.", "m.", "W.") + pick("example.com", "a.example.com", "EXAMPLE.net", "com", "xcom", "b.example.org", "net", "") + pick("", "/", "/en/", "/en", "/fr/", "/es/x", "/de/1") + pick("", "12", "a//b") + pick("", "?a=1&b=2", "#x", "?u=http://z.net/fr/") for _ in range(n)] + [None, ""]


def test_rules(spark):
    rows = list(enumerate(urls()))
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == len(rows)
    verdict = {str(r): r.verdict for r in url_filter.RULES}
    for r in out:
        assert (r.host, r.path, r.rule) == brute(rows[r.page_id][1])
        assert r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_held_out_accuracy(spark):
    """Labels of unseen urls of known sections are found again by the trees."""
    rng = random.Random(5)
    rules = (url_filter.Rule("allow", "good.org", "/"), url_filter.Rule("block", "bad.org", "/"))
    train = [(i, f"https://x{rng.randrange(99)}.{'good' if i % 2 else 'bad'}.org/{'a' if i % 2 else 'q'}/{rng.randrange(9999)}") for i in range(2000)]
    asked = [(5000 + i, f"https://x{rng.randrange(99)}.{'fine' if i % 2 else 'foul'}.com/{'a' if i % 2 else 'free-pills-2024-07/buy/now'}/{rng.randrange(9999)}") for i in range(200)]
    train = [(i, u if i % 2 else u + "/free-pills-2024-07/buy/now") for i, u in train]
    out = url_filter.judge_urls(spark.createDataFrame(train + asked, "page_id long, url string"), rules).where("page_id >= 5000").collect()
    right = sum((r.verdict == "allow") == (r.page_id % 2 == 1) for r in out)
    assert right >= 0.9 * len(out)


def test_suffixes_without_labels_are_blocked_by_strong_evidence_alone(spark):
    """The verdict of labelled urls follows the suffix and the words say nothing, so an unseen suffix is let through."""
    rng = random.Random(6)
    site = lambda s: f"https://x{rng.randrange(99)}.{s}/a/{rng.randrange(9999)}"
    rules = (url_filter.Rule("allow", "abd.org", "/"), url_filter.Rule("block", "bda.org", "/"))
    rows = list(enumerate([site("abd.org") for _ in range(600)] + [site("bda.org") for _ in range(600)] + [site("dab.org") for _ in range(100)]))
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = url_filter.judge_urls(df, rules).where("page_id >= 1200").collect()
    assert sum(r.verdict == "allow" for r in out) >= 95
    found = {r.suffix: (r.n, r.balanced_accuracy) for r in url_filter.held_out(df, rules).collect()}
    assert found == {"abd.org": (600, None), "bda.org": (600, None)}


def test_accuracy_on_suffixes_held_out(spark):
    rng = random.Random(7)
    rows, rules = [], []
    for s in range(4):
        rules += [url_filter.Rule("allow", f"s{s}.org", "/"), url_filter.Rule("block", f"s{s}.org", "/free-pills-2024-07/buy/now/")]
        rows += [f"https://x{rng.randrange(99)}.s{s}.org/{'a' if i % 2 else 'free-pills-2024-07/buy/now'}/{rng.randrange(9999)}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    assert all(r.balanced_accuracy >= 0.95 for r in url_filter.held_out(df, tuple(rules)).collect())


def test_features(spark):
    u = "https://a-b.c9.example.com/x/yy/z.html?k=1&l=2#f"
    df = url_filter.lexical(url_filter.parts(spark.createDataFrame([(1, u), (2, None)], "page_id long, url string")))
    r = df.where("page_id = 1").first()
    n = Counter(u)
    assert math.isclose(r.entropy, -sum(c / len(u) * math.log2(c / len(u)) for c in n.values()))
    assert (r.length, r.depth, r.params, r.labels, r.hyphens, r.suffix, r.section) == (len(u), 3, 2, 4, 1, "example.com", "example.com/x/")
    assert df.where("page_id = 2").first().entropy == 0


def test_one_class_needs_no_trees(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (2, "http://x.net/fr/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()} == {1: "block", 2: "block"}
    assert {r.verdict for r in url_filter.judge_urls(df.where(F.col("page_id") == 1)).collect()} == {"allow"}


def test_parents_and_folds_say_what_unseen_suffixes_are(spark):
    """Sites of one top-level domain are blocked, those of another are not; their urls read alike."""
    rng = random.Random(8)
    rules, rows = [], []
    for s in range(24):
        site = f"s{s}.{'bad' if s % 2 else 'good'}"
        rules.append(url_filter.Rule("block" if s % 2 else "allow", site, "/"))
        rows += [f"https://x{rng.randrange(99)}.{site}/a/{rng.randrange(9999)}" for _ in range(60)]
    asked = [f"https://x{rng.randrange(99)}.new{i % 7}.{'bad' if i % 2 else 'good'}/a/{rng.randrange(9999)}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")
    out = url_filter.judge_urls(df, tuple(rules)).where(F.col("page_id") >= len(rows)).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in out) >= 95
    full = url_filter.parent_statistics(url_filter.prepared(df, tuple(rules), "page_id", "url"), "top")
    own = {r.suffix: (r.top_sites, r.top_blocked) for r in full.where("suffix like 's%'").select("suffix", "top_sites", "top_blocked").distinct().collect()}
    # eleven others of the same domain, never the site itself
    assert all(sites == 11 and (blocked > 0.9) == name.endswith("bad") for name, (sites, blocked) in own.items()) and len(own) == 24


def test_every_labelled_url_trains_the_trees(spark):
    """The few blocked urls come after 10,000 others by hash; a sample of those would know no blocked one."""
    rules = (url_filter.Rule("allow", "good", "/"), url_filter.Rule("block", "bad", "/"))
    site = lambda top: F.concat(F.lit("https://s"), F.col("id") % 16, F.lit(f".{top}/"))
    words = F.concat(F.lit("free-pills-2024-07/buy/now/"), F.col("id"))
    good = spark.range(24000).select(F.concat(site("good"), F.col("id")).alias("url"))
    bad = spark.range(4000).select(F.concat(site("bad"), words).alias("url")).where(F.xxhash64("url") > 8 * 10**18)
    asked = spark.range(100).select(F.when(F.col("id") % 2 == 1, F.concat(F.lit("https://new.org/"), words)).otherwise(F.concat(F.lit("https://new.org/"), F.col("id"))).alias("url"))
    rows = list(enumerate(r.url for r in good.union(bad).union(asked).collect()))
    assert 24100 + 100 < len(rows) < 24100 + 1000
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("host = 'new.org'").collect()
    assert len(out) == 100 and all((r.verdict == "block") == ("pills" in r.path) for r in out)


def test_suffix_statistics_count_every_labelled_url(spark):
    """A url that is asked sees all labels of its suffix, a labelled one those of the other half."""
    rng = random.Random(9)
    rows = [f"https://x.{rng.choice('abc')}.{rng.choice(('com', 'net'))}/{rng.choice(('es', 'fr', 'de'))}/{rng.randrange(300)}" for _ in range(600)]
    df = url_filter.prepared(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), url_filter.RULES, "page_id", "url")
    found = url_filter.suffix_statistics(df, "suffix").select("suffix", "labelled", "half", "label", "suffix_pages", "suffix_seen", "suffix_blocked").collect()
    assert len(found) == 600 and {r.half for r in found if r.labelled} == {0, 1} and not all(r.labelled for r in found)
    for r in found:
        told = [x.label for x in found if x.suffix == r.suffix and x.labelled and not (r.labelled and x.half == r.half)]
        assert r.suffix_seen == len(told) and math.isclose(r.suffix_blocked, (sum(told) + 5) / (len(told) + 10))
        assert math.isclose(r.suffix_pages, math.log1p(sum(x.suffix == r.suffix for x in found)))


def test_candidate_splits_come_from_every_row(spark):
    """Six of some 40,000 different rows are blocked, each with a rare value that no other has; trees that place their splits by 10,000 sampled rows do not know all six values."""
    features = ["length", "depth", *(f"f{i}" for i in range(6))]
    rare = [(30 * k + 5, 170 - 25 * k, *(int(i == k) for i in range(6))) for k in range(6)]
    rows = spark.range(40000).select((F.col("id") % 200).alias("length"), F.floor(F.col("id") / 200).alias("depth"), *(F.lit(0).cast("long").alias(f) for f in features[2:]))
    asked = spark.createDataFrame(rare + [(*r[:2], *[0] * 6) for r in rare], ", ".join(f"{f} long" for f in features))
    blocked = F.greatest(*features[2:]) == 1
    train = rows.union(asked.where(blocked)).withColumn("label", blocked.cast("double"))
    out = url_filter.scored(asked.withColumn("blocked", blocked), url_filter.fitted(train, features, even=True), features, "score", 0.0).collect()
    assert len(out) == 12 and all((r.score > 0.5) == r.blocked for r in out)


def test_sections_without_labels_follow_their_suffix(spark):
    """All labels of bad.org are blocked; the number of pages of its other sections, near that of sections allowed elsewhere, is no reason to allow them."""
    rng = random.Random(10)
    rules = (url_filter.Rule("allow", "good.org", "/"), url_filter.Rule("block", "good.org", "/q/"), url_filter.Rule("block", "bad.org", "/es/"), url_filter.Rule("block", "bad.org", "/fr/"))
    sizes = {"good.org/q": 500, "good.org/a": 120, "good.org/b": 130, "good.org/c": 250, "bad.org/es": 60, "bad.org/fr": 100, "bad.org/x": 125, "bad.org/y": 400}
    rows = [f"https://x{rng.randrange(99)}.{s}/{rng.randrange(99999)}" for s, n in sizes.items() for _ in range(n)]
    out = url_filter.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).where("rule is null").collect()
    assert len(out) == 525 and sum(r.verdict == "block" for r in out) >= 0.95 * len(out)

"""URL filter: rules first, gradient-boosted trees on lexical features for the rest (operator 2).

A rule is a host and a path; it fits the host and its subdomains where the url's path starts with the
rule's, and the longest fitting rule decides. The urls that a rule decides are also the labelled
urls. All of them give the suffix statistics (how many pages a host suffix and a section of it have and
the share blocked) and all train the trees: a labelled url sees the shares of the other of two halves, by
hash of the url, so that its own label is not among its features; other urls see those of both halves.
Trees for suffixes with labelled urls see length, depth, digit ratio, entropy,
parameter counts and the suffix statistics. Those for other suffixes see, beside what the url says, how
often other sites are blocked under the same top-level domain and in the same first directory. For a site
with labels these shares leave its own out, as they would if it had none; they are shrunk towards the overall
share by what sites differ (moments of the beta-binomial), and neutral below ``LEAST_SITES`` other sites. From
which score on such urls are blocked is chosen on two folds of suffixes, each judged by trees that were fitted on
the other: the score of the best balanced accuracy. Where the folds cannot say, it is ``BLOCK_UNSEEN``: what the
words of a url say is weak evidence against a site of which nothing is known. ``held_out`` says how weak.

Counts, shares, trees and thresholds come from all rows. Trees see features on a grid (``LEVELS``), and labelled
urls that are alike there are one row of training with their number as weight. Spark takes candidate splits
from a sample of max(maxBins squared, 10,000) rows; ``maxBins`` is set so that this is every row.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; where
the labelled urls are all of one verdict the trees are not needed and that verdict is given, and
without any labelled url ``allow``; repeated rows each return their row; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Steps of the grid of features from a value to where it and one are doubled: counts below some 360 stay apart, shares to about 0.005.
LEVELS = 256
#: Rows of training that a task holds, and Spark's own number of bins.
TASK_ROWS, LEAST_BINS = 100_000, 32
#: Score above which a url of a suffix without labels is blocked where folds of suffixes do not choose it, and the steps in which they do.
BLOCK_UNSEEN, STEPS = 0.75, 20
#: Other sites with labels from which on a top-level domain or first directory says anything, and the bounds of the prior's weight.
LEAST_SITES, WEIGHTS = 3, (1.0, 1000.0)
#: Pages' worth of prior in a smoothed share.
PRIOR = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

LEXICAL = ["length", "host_length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens"]
PARENTS = ["top", "directory"]
UNSEEN = [*LEXICAL, *(f"{p}_{c}" for p in PARENTS for c in ("blocked", "sites"))]
#: What is seen of a section without labels, in training and when judging.
UNKNOWN_SECTION = {"section_pages": math.log1p(1.0), "section_blocked": 0.5}
FEATURES = [*LEXICAL, "suffix_pages", "suffix_blocked", "section_pages", "section_blocked"]


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host and path of every row."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def fitting_rule(rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits host and path, or null; of equal lengths the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(str(r))):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def lexical(judged: DataFrame) -> DataFrame:
    """Features that the url alone gives, and its host suffix and section (suffix and first directory)."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    suffix = F.array_join(F.slice(F.split(host, r"\."), F.greatest(-F.size(F.split(host, r"\.")), F.lit(-2)), 2), ".")
    return judged.withColumns(
        {
            "length": F.length(url),
            "host_length": F.length(host),
            "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": entropy(url),
            "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
            "labels": F.size(F.split(host, r"\.")),
            "hyphens": F.regexp_count(url, F.lit("-")),
            "suffix": suffix,
            "top": F.element_at(F.split(host, r"\."), -1),
            "directory": F.regexp_extract(path, r"\A/[^/]*/?", 0),
            "section": F.concat(suffix, F.regexp_extract(path, r"\A/[^/]*/?", 0)),
        }
    )


def suffix_statistics(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with {key}_pages, the log of the pages of their value of ``key``, {key}_seen, the labelled urls of it, and {key}_blocked, the smoothed share blocked among those; for a labelled url the last two are those of the other half."""
    of = lambda h: F.col("labelled") & (F.col("half") == h)
    seen = [F.count_if(of(h)).alias(f"n{h}") for h in range(2)]
    blocked = [F.count_if(of(h) & (F.col("ruled.verdict") == "block")).alias(f"b{h}") for h in range(2)]
    whole = checkpoint(rows.groupBy(key).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias(f"{key}_pages"), *seen, *blocked))
    told = lambda c: F.when(of(0), F.col(f"{c}1")).when(of(1), F.col(f"{c}0")).otherwise(F.col(f"{c}0") + F.col(f"{c}1"))
    share = (told("b") + 0.5 * PRIOR) / (told("n") + PRIOR)
    return rows.join(whole, key).withColumns({f"{key}_seen": told("n"), f"{key}_blocked": share}).drop("n0", "n1", "b0", "b1")


def parent_statistics(rows: DataFrame, parent: str) -> DataFrame:
    """``rows`` with {parent}_sites, the other suffixes with labels under the same value, and {parent}_blocked, their shrunk share blocked."""
    blocked, seen = F.count_if(F.col("ruled.verdict") == "block").alias("b"), F.count(F.lit(1)).alias("n")
    own = checkpoint(rows.where("labelled").groupBy(parent, "suffix").agg(blocked, seen))
    share = F.col("b") / F.col("n")
    whole = own.agg(F.sum("b") / F.sum("n"), F.var_pop(share)).first()
    mean, spread = whole[0] if whole[0] is not None else 0.5, whole[1] or 0.0
    weight = min(max(mean * (1 - mean) / spread - 1, WEIGHTS[0]), WEIGHTS[1]) if spread else WEIGHTS[1]
    total = own.groupBy(parent).agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("all_sites"))
    joined = rows.join(own, [parent, "suffix"], "left").join(total, parent, "left")
    left = lambda c, mine: F.coalesce(c, F.lit(0)) - F.coalesce(mine, F.lit(0))
    sites = left("all_sites", F.when(F.col("n") > 0, 1))
    shrunk = (left("all_b", "b") + mean * weight) / (left("all_n", "n") + weight)
    return joined.withColumns({f"{parent}_sites": sites.cast("double"), f"{parent}_blocked": F.when(sites >= LEAST_SITES, shrunk).otherwise(mean)}).drop("b", "n", "all_b", "all_n", "all_sites")


def unseen_threshold(known: DataFrame) -> float:
    """The score above which urls of unseen suffixes are blocked: of ``STEPS`` the one of the best balanced accuracy, the highest of equals, on folds of suffixes judged by trees of the other fold."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), "suffix"), F.lit(2))
    counts: dict[tuple[float, int], int] = {}
    for k in range(2):
        model = fitted(known.where(fold != k), UNSEEN, even=False)
        if model is None:
            continue
        steps = F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1)).alias("step")
        for label, step, n in scored(known.where(fold == k), model, UNSEEN, "score", 0.0).groupBy("label", steps).count().collect():  # two rows a step
            counts[label, step] = counts.get((label, step), 0) + n
    total = [sum(n for (y, _), n in counts.items() if y == label) for label in (0.0, 1.0)]
    if not all(total):
        return BLOCK_UNSEEN
    below = lambda label, step: sum(n for (y, s), n in counts.items() if y == label and s < step) / total[int(label)]
    best = max(range(1, STEPS), key=lambda step: (below(0.0, step) + 1 - below(1.0, step), step))
    return best / STEPS


def masked(known: DataFrame) -> DataFrame:
    """Training rows also as they would look in a section without labels, so that the trees learn what to say there."""
    return known.union(known.withColumns({c: F.lit(v) for c, v in UNKNOWN_SECTION.items()}))


def levels(features: list[str]) -> Column:
    """The features, none of them negative, on a grid that grows with the value; the trees' splits ask for no more."""
    return F.array(*(F.round(F.log2(F.col(c) + 1) * LEVELS) for c in features))


def fitted(train: DataFrame, features: list[str], even: bool) -> GBTClassificationModel | None:
    """Trees for the probability of block from all rows with label (0 or 1), both verdicts weighing the same if ``even``; None with one verdict alone."""
    cells = checkpoint(train.groupBy("label", levels(features).alias("levels")).agg(F.count(F.lit(1)).alias("n")))
    found = cells.groupBy("label").agg(F.count(F.lit(1)), F.sum("n")).collect()  # two rows
    if len(found) < 2:
        return None
    size, counts = sum(r[1] for r in found), {r[0]: r[2] for r in found}
    weight = F.col("n") * (F.when(F.col("label") == 1, 1 / counts[1.0]).otherwise(1 / counts[0.0]) * (sum(counts.values()) / 2) if even else F.lit(1.0))
    bins = max(LEAST_BINS, math.isqrt(size) + 1)  # squared more than size: no sample of rows for the candidate splits
    trees = GBTClassifier(maxIter=20, maxDepth=4, maxBins=bins, stepSize=0.3, seed=7, weightCol="weight")
    ordered = cells.coalesce(math.ceil(size / TASK_ROWS)).sortWithinPartitions("label", "levels")  # sums in one order, so that ties fall alike
    return trees.fit(ordered.select("label", weight.alias("weight"), array_to_vector("levels").alias("features")))


def scored(rows: DataFrame, model: GBTClassificationModel | None, features: list[str], name: str, otherwise: float) -> DataFrame:
    """``rows`` with the model's probability of block as ``name``, or ``otherwise`` where there is no model."""
    if model is None:
        return rows.withColumn(name, F.lit(otherwise))
    return model.transform(rows.withColumn("features", array_to_vector(levels(features)))).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def prepared(pages: DataFrame, rules: tuple[Rule, ...], id_col: str, url_col: str) -> DataFrame:
    """Every row with its rule, lexical features, whether it is labelled, and the half of the urls it is in."""
    judged = parts(pages, id_col, url_col).withColumn("ruled", fitting_rule(rules))
    half = F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2))
    return lexical(judged).withColumn("labelled", F.col("ruled").isNotNull()).withColumn("half", half).withColumn("label", (F.col("ruled.verdict") == "block").cast("double"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block; null where they were not asked)."""
    rows = checkpoint(prepared(pages, rules, id_col, url_col))
    columns = ["page_id", "host", "path", F.col("ruled.rule").alias("rule")]
    classes = [r[0] for r in rows.where("labelled").select("ruled.verdict").distinct().collect()]  # at most two rows
    if len(classes) < 2:
        return rows.select(*columns, F.coalesce("ruled.verdict", F.lit(classes[0] if classes else "allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    full = suffix_statistics(suffix_statistics(rows, "section"), "suffix")
    full = full.withColumn("section_pages", F.when(F.col("section_seen") > 0, F.col("section_pages")).otherwise(UNKNOWN_SECTION["section_pages"]))
    for parent in PARENTS:
        full = parent_statistics(full, parent)
    known = checkpoint(full.where("labelled").select("label", "suffix", "suffix_seen", *FEATURES, *UNSEEN[len(LEXICAL) :]))
    asked = scored(full, fitted(masked(known.where("suffix_seen > 0")), FEATURES, even=True), FEATURES, "site_score", 0.0)
    asked = scored(asked, fitted(known, UNSEEN, even=False), UNSEEN, "word_score", 0.0)
    site = F.col("suffix_seen") > 0
    score = F.when(site, F.col("site_score")).otherwise(F.col("word_score"))
    blocks = score >= F.when(site, 0.5).otherwise(unseen_threshold(known))
    verdict = F.coalesce("ruled.verdict", F.when(blocks, "block").otherwise("allow"))
    return asked.select(*columns, verdict.alias("verdict"), F.when(F.col("ruled").isNull(), score).alias("score"))


def held_out(pages: DataFrame, rules: tuple[Rule, ...] = RULES, by: str = "suffix", most: int = 20, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each of the ``most`` values of ``by`` (suffix or directory) with most labels: the value, n, and the balanced accuracy on it (null with one verdict alone) of trees for unseen suffixes that were fitted without it."""
    rows = checkpoint(prepared(pages, rules, id_col, url_col))
    for parent in PARENTS:
        rows = parent_statistics(rows, parent)
    rows = checkpoint(rows.where("labelled").select("suffix", "directory", "label", *UNSEEN))
    out = []
    for (name,) in rows.groupBy(by).count().orderBy(F.col("count").desc(), by).limit(most).select(by).collect():
        train = rows.where(F.col(by) != name)
        tested = scored(rows.where(F.col(by) == name), fitted(train, UNSEEN, even=False), UNSEEN, "score", 0.0)
        limit = unseen_threshold(train)
        right = lambda y, limit=limit: F.avg(F.when(F.col("label") == y, ((F.col("score") >= limit) == (F.lit(y) == 1)).cast("double")))
        out.append((name, *tested.agg(F.count(F.lit(1)), (right(0.0) + right(1.0)) / 2).first()))
    return pages.sparkSession.createDataFrame(out, f"{by} string, n long, balanced_accuracy double")

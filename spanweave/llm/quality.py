"""Quality rules with risk-controlled thresholds (operator 9).

Every document gets counts that depend on its whole text. Two fixed base rules reject outright. The
method adds upper cutoffs, at most one per rule and stratum (language): labelled documents of good
quality are the holdout, and a set of cutoffs is admissible when the exact (Clopper-Pearson) upper bound
of its false rejection rate stays within ``max_false_rejection``, for all its rules together.

Cutoffs are searched along chains fixed beforehand, from loose to strict, that end at the first failure;
such a fixed sequence needs no division of the error by its length. Of the five plans of a stratum, four
are chains of joint cutoffs, one beginning with each rule: it goes down the grid in one rule, then in the
next, and each step counts the documents that any rule so far rejects. The fifth, ``apart``, gives each rule
a chain of its own and an equal share of the rate. The plans have equal shares of the error (``SHARES``), which is
divided by the strata that have labels of good quality, so the bounds of all plans hold at once and one may
be chosen freely: that which rejects most labelled documents of bad quality, of equal ones ``apart`` before
the others and these in the order of RULES; plans without cutoffs come last. Where no plan has one, only the
base rules reject. The bound needs independent labels, so copies of a text count once in a stratum.

Defined results: a null text is an empty one (no words, base rule fails it); a null language is a
stratum of its own; null labels do not count, repeated ones and those of equal texts once with the lowest quality given;
labels without a document are ignored; an empty table gives an empty result; further columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import checkpoint, map_texts, words

SEPARATORS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Risk:
    """Production parameters of the threshold search."""

    max_false_rejection: float = 0.02
    error: float = 0.05
    grid: int = 32


#: Rule -> (numerator, greatest useful value); the value is numerator / n_words, rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols", 4.0),
    "dup_lines": ("n_dup_lines", 0.5),
    "repeats": ("n_repeat_words", 0.5),
    "word_length": ("word_chars", 40.0),
}
#: Plan -> its share of the error: rules apart, or the rule that a chain of joint cutoffs begins with.
SHARES = dict.fromkeys(("apart", *RULES), 1 / (1 + len(RULES)))
COUNTS = "digest binary, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(w: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    grams = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    hit = np.zeros(len(w), bool)
    at = np.fromiter((i for i, g in enumerate(grams) if g in twice), np.int64)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    return (
        len(w),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(w),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts of every document, one row each; ids are integers or binary keys."""

    def batch(ids: list, texts: list, strata: list) -> dict:
        n, chars, symbols, dup, rep = zip(*map(count_text, texts), strict=True) if texts else ([],) * 5
        return {"doc_id": ids, "digest": [hashlib.sha256((t or "").encode()).digest() for t in texts], "stratum": strata, "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep}

    key = docs.schema[id_col].dataType if docs.schema[id_col].dataType == BinaryType() else LongType()
    picked = docs.select(F.col(id_col).cast(key), F.col(text_col), F.coalesce(F.col(stratum_col), F.lit("\0null")))
    counts = map_texts(picked, batch, f"doc_id {key.simpleString()}, {COUNTS}")
    n = F.col("n_words")
    return counts.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P[X <= k] for X ~ Bin(n, p), summed in logarithms."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(n, n - k, -1)) - np.log(np.arange(1, k + 1)))])
    logs = logs + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def exact_upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the rate at which at most k of n would be seen with probability ``error``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > error else (low, mid)
    return high


def admits(k: int, n: int, rate: float, error: float) -> bool:
    """Whether the exact upper bound of k of n is within ``rate``; one CDF instead of a bisection."""
    return n > 0 and k < n and binomial_cdf(k, n, rate) <= error


def chain(first: str) -> list[str]:
    """The rules in the order of the chain that begins with ``first``."""
    return [first, *(r for r in RULES if r != first)]


def over(cutoff: Callable[[str], Column]) -> Column:
    """Whether a value lies above its cutoff; a null cutoff rejects nothing."""
    return reduce(or_, (F.coalesce(F.col(c) / F.col("n_words") > cutoff(rule), F.lit(False)) for rule, (c, _) in RULES.items()))


def walk(left: np.ndarray, steps: int, rate: float, error: float) -> int:
    """Steps of a chain until the first that fails; ``left`` counts documents by the step that rejects them, the last those that none does."""
    lost, n = np.cumsum(left), int(left.sum())
    return next((k for k in range(steps) if not admits(int(lost[k]), n, rate, error)), steps)


def cutoffs(counts: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum: a nullable cutoff per rule. Reads every labelled document."""
    quality = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast(counts.schema["doc_id"].dataType).alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = counts.where(~F.col("base_failed")).join(quality, "doc_id")
    # equal texts have equal counts
    known = known.groupBy("stratum", "digest", "n_words", *(c for c, _ in RULES.values())).agg(F.min("quality").alias("quality"))
    grid, names = risk.grid, list(RULES)
    # a value in step s lies in ((s - 1) * width, s * width]: a cutoff of s * width keeps it; the last step is open above
    step = {r: F.least(F.lit(grid), F.ceil(F.col(c) / F.col("n_words") / F.lit(top / grid))).cast("int") for r, (c, top) in RULES.items()}
    # chains try the cutoffs of steps grid - 1 to 0 of each rule, so step s of a chain's k-th rule is rejected k * grid + grid - s steps down
    alone = [F.struct(F.lit(r).alias("path"), (grid - step[r]).alias("at")) for r in names]
    joint = [F.struct(F.lit(f"joint {first}").alias("path"), F.coalesce(*(F.when(step[r] > 0, k * grid + grid - step[r]) for k, r in enumerate(chain(first))), F.lit(len(names) * grid)).alias("at")) for first in names]
    histogram = known.where("quality = 1").select("stratum", F.explode(F.array(*alone, *joint)).alias("x")).groupBy("stratum", "x.path", "x.at").agg(F.count(F.lit(1)).alias("n"))
    histogram = checkpoint(histogram)
    strata = histogram.select("stratum").distinct().count()
    schema = "stratum string, plan string, place int, " + ", ".join(f"{r} double" for r in RULES)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        error = risk.error / strata
        left = {p: np.bincount(part["at"], part["n"], len(names) * grid + 1).astype(np.int64) for p, part in pdf.groupby("path")}
        edge = lambda rule, taken: (grid - taken) * RULES[rule][1] / grid if taken > 0 else None
        rows = []
        for place, (plan, share) in enumerate(SHARES.items()):
            if plan == "apart":
                down = {r: walk(left[r], grid, risk.max_false_rejection / len(RULES), error * share / len(RULES)) for r in names}
            else:
                taken = walk(left[f"joint {plan}"], len(names) * grid, risk.max_false_rejection, error * share)
                down = {r: min(grid, taken - k * grid) for k, r in enumerate(chain(plan))}
            rows.append({"stratum": pdf["stratum"].iloc[0], "plan": plan, "place": place} | {r: edge(r, down[r]) for r in names})
        return pd.DataFrame(rows).astype(dict.fromkeys(names, float))

    plans = checkpoint(histogram.groupBy("stratum").applyInPandas(choose, schema))
    bad = known.where("quality <> 1").join(plans, "stratum").where(over(F.col)).groupBy("stratum", "plan").agg(F.count(F.lit(1)).alias("caught"))
    rank = F.struct(F.coalesce("caught", F.lit(0)), F.coalesce(*RULES).isNotNull(), -F.col("place"))
    best = plans.join(bad, ["stratum", "plan"], "left").groupBy("stratum").agg(F.max_by(F.struct(*RULES), rank).alias("x"))
    return best.select("stratum", "x.*")


def judge(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Verdicts: kept unless a base rule fails or a value lies above its stratum's cutoff."""
    return counts.join(chosen, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over(F.col))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), **columns: str) -> DataFrame:
    """doc_id, stratum, the counts, base_failed, the stratum's cutoffs and kept, one row per document."""
    counts = checkpoint(measure(docs, **columns))
    return judge(counts, checkpoint(cutoffs(counts, labels, risk)))

"""Filter interaction audit by CUBE over failure flags (operator 13), in DataFrame functions only.

Each document gets one flag a filter, true where it fails. Documents are counted by part and flags, at most 2^k rows a
part, and these counts go through a CUBE over the flags and part. A grouping-set row whose selected flags are all false
counts the survivors of that subset of filters. A step of a filter order turns the survivors of the filters before it
into those of the filters up to it, so each step is one join of a pair of subsets; removals, redundancy and Shapley
sums are differences of the two.

Defined results: a null text is an empty one, a null part the empty string; a text is a repeat if any row of a smaller
doc_id has it, so a null doc_id neither repeats nor is repeated and rows of one doc_id do not repeat each other; of
several labels of a document any that says so counts; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
FILTERS, MEASURES = "ABCDE", ("n", "good", "toxic")
#: Fixed limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, r"[#$%&*|]"


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, the flags A to E, good and toxic of every row of ``docs``; texts are read once and never moved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), *(c.alias(k) for k, c in text_flags(text).items()))
    each = checkpoint(each)
    first = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    repeat = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")
    judged = each.join(first, "digest", "left").select("doc_id", "part", *"ABCD", repeat)
    return judged.join(said, "doc_id", "left").select("part", *FILTERS, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def survivors(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, subset (its filters in order) and, of the documents of the part that pass all of them, n, good and toxic; subsets without survivors have no row."""
    counted = (F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    cells = flagged.groupBy("part", *filters).agg(*counted)
    cube = cells.cube("part", *filters).agg(*(F.sum(c).alias(c) for c in MEASURES), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"any_{f}") for f in filters))
    passed, subset = F.col("all_parts") == 0, []
    for f in filters:
        selected = F.col(f"any_{f}") == 0
        passed &= ~selected | ~F.col(f)
        subset.append(F.when(selected, f).otherwise(""))
    return cube.where(passed).select("part", F.concat(*subset).alias("subset"), *MEASURES)


def steps(filters: str = FILTERS) -> list[tuple[str, int, str, str, str]]:
    """filter_order, step, its filter, and the subsets before and after it, of every order."""
    return [("".join(order), k + 1, f, "".join(sorted(order[:k])), "".join(sorted(order[: k + 1]))) for order in permutations(filters) for k, f in enumerate(order)]


def audit(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of every step of every order; ``filters`` names flag columns in order."""
    found = checkpoint(survivors(flagged, filters))
    subsets = F.explode(F.array(*(F.lit("".join(f for k, f in enumerate(filters) if m >> k & 1)) for m in range(1 << len(filters)))))
    # each part has survivors of the empty subset
    grid = found.where("subset = ''").select("part", subsets.alias("subset")).join(found, ["part", "subset"], "left")
    grid = checkpoint(grid.select("part", "subset", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES)))
    before, after = (grid.select("part", F.col("subset").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in MEASURES)) for s in ("before", "after"))
    # five steps of each of 120 orders, whatever the data
    order = F.broadcast(flagged.sparkSession.createDataFrame(steps(filters), "filter_order string, step int, filter string, before string, after string"))
    pairs = before.join(order, "before").join(after, ["part", "after"])
    lost = {a: F.col(f"{c}_before") - F.col(f"{c}_after") for a, c in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))}
    each = pairs.select("part", "filter_order", "step", "filter", F.col("n_after").alias("kept"), *(c.alias(a) for a, c in lost.items()))
    own = Window.partitionBy("part", "filter")
    # the first step of an order removes all that fail its filter, the last one those that fail nothing else
    fails, alone = (F.max(F.when(F.col("step") == k, F.col("removed"))).over(own) for k in (1, len(filters)))
    return each.select("part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of filters A to E over ``docs``; ``labels`` has doc_id, quality and toxic."""
    return audit(failures(docs, labels, id_col, text_col, part_col))

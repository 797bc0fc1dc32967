"""Interaction of quality filters by the subset-zeta transform.

1. A text is read once and becomes the bit mask of the filters that it fails; copies are
   told by a 256-bit hash, so no text is shuffled.
2. Masks are counted for each part.  The zeta transform sums them over all subsets of
   bits, one pass a filter: how many documents survive each set of filters.
3. A step of an order is a difference between two neighbouring sets: those before the
   step and those with its filter.  Labelled documents are counted and summed alike, and a
   filter's sum over all orders is a weighted sum of its differences.

The work grows with documents up to the counts, and after them with parts only.

Defined results: null text is empty; a null part is the empty string; a null doc_id comes
after all others and has no labels; rows that agree in doc_id and text are documents each,
and none of them is the other's copy; a document with several labels has what any of them
says; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"  # the last one tells copies; at most 8, as all orders are listed


def failures(text: str = "text", words: str = "words") -> list[Column]:
    """What a text fails by itself: few words, few different words, many capitals, odd signs."""
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), F.col(text).rlike(r"[#$%&*|]")]


def masks(ws: Workspace, docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and mask of failed filters, and those of them with a label."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    told = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    own = failures()
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(own)), F.lit(0))
    told = told.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("code"))
    # Repeated rows become one with a count; the table is narrow and read twice.
    rows = ws.cut(told.groupBy("code", "mask", "part", "doc_id").agg(F.count("*").alias("n")), "masks")
    any_of = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    labelled = rows.where("doc_id is not null").join(known, "doc_id", "left")
    nameless = ws.again(rows).where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    every = labelled.unionByName(nameless).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Of each text the rows of the smallest doc_id are no copies; a text leaves one row a part and label.
    place = F.struct(F.col("doc_id").isNull(), "doc_id")
    texts = every.groupBy("code", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(place).alias("first"), F.min_by("n", place).alias("at_first"))
    kept = F.when(F.col("first") == F.min("first").over(Window.partitionBy("code")), F.col("at_first")).otherwise(0)
    texts = texts.withColumn("kept", kept)
    both = F.explode(F.array(F.struct("mask", F.col("kept").alias("n")), F.struct((F.col("mask") + (1 << len(own))).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    split = texts.select("part", "good", "toxic", both.alias("m")).select("part", "good", "toxic", "m.*")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def survivors(counts: Column, filters: int) -> Column:
    """From counts by mask (an array of 2**filters): how many survive each set of filters, by the set's mask."""
    whole = 1 << filters
    every = F.sequence(F.lit(0), F.lit(whole - 1))
    bits = F.array(*[F.lit(1 << k) for k in range(filters)])
    one_bit = lambda f, bit: F.transform(every, lambda i: F.get(f, i) + F.when(i.bitwiseAND(bit) > 0, F.get(f, i - bit)).otherwise(F.lit(0).cast("long")))
    below = F.aggregate(bits, counts, one_bit)  # of each set all documents that fail nothing outside it
    return F.transform(every, lambda s: F.get(below, F.lit(whole - 1) - s))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part of ``docs`` (doc_id, text and ``part``), order of the filters and step.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    """
    k = len(FILTERS)
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    ws = Workspace(docs.sparkSession, "filter_audit")
    counted = masks(ws, docs, labels, part)
    by_mask = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))  # at most 2**k entries
    zero = F.lit(0).cast("long")
    listed = lambda c: F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i)[c], zero))
    # A row a part, written so that what follows refers to sums and not to their expressions.
    left = ws.cut(by_mask.select("part", *[survivors(listed(c), k).alias(c) for c in ("n", "good", "toxic")]), "survivors")
    # A filter comes behind a set of s others in s! (k - 1 - s)! of the orders.
    weights = F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)).cast("long") for s in range(k)], zero)
    lost = lambda s, bit: F.when(s.bitwiseAND(bit) == 0, F.get(weights, F.bit_count(s)) * (F.get("n", s) - F.get("n", s.bitwiseOR(bit)))).otherwise(zero)
    shapley = F.transform(F.array(*[F.lit(1 << j) for j in range(k)]), lambda bit: F.aggregate(every, zero, lambda total, s: total + lost(s, bit)))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    rows = ws.cut(left.withColumn("shapley", shapley), "shapley").withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    number = lambda letter: F.instr(F.lit(FILTERS), letter) - 1
    letters = F.transform(F.sequence(F.lit(1), F.col("step")), lambda i: F.substring("filter_order", i, F.lit(1)))
    after = F.aggregate(letters, F.lit(0), lambda s, letter: s + F.pow(F.lit(2), number(letter)).cast("int"))
    rows = rows.withColumn("at", number(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumns({"after": after, "bit": F.pow(F.lit(2), F.col("at")).cast("int")})
    rows = rows.withColumn("before", F.col("after") - F.col("bit"))
    gone = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    whole = (1 << k) - 1
    failing = F.get("n", F.lit(0)) - F.get("n", F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"),
        (F.get("n", F.lit(whole) - F.col("bit")) - F.get("n", F.lit(whole))).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shapley", F.col("at")).alias("shapley"),
    )

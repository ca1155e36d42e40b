"""Audit of how filters interact: failure masks, a histogram of them for each part, and every order of the filters from its cells."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, word_array

#: Letters of the filters, in the order of their bits.
LETTERS = "ABCDE"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text (null: empty) and its words.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 2 % of the code points are A-Z; D: any of #$%&*|.
    """
    t = F.coalesce(text, F.lit(""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, failures=text_failures, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask): bit i of the mask tells that the row fails the filter LETTERS[i].

    failures gives conditions of a text by letter; the filter `copies` fails a row if a smaller id has the same text, whatever the other filters say. The
    smallest id of a text comes from an aggregation by the text's SHA-256, pre-aggregated in each task; rows then meet it by their own
    id, which is one row a text, so a text with very many copies makes no hot key. Each text is read once; what is kept of it is a row of some 80 bytes.

    A null text is empty; a null part is ''. A row without an id has no smaller and is no smaller one: it never fails as a copy. Rows with
    one id and text fail alike.
    """
    bits = {x: 1 << i for i, x in enumerate(LETTERS)}
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("t"), word_array(F.col(text_col)).alias("w"))
    mask = sum((F.when(c, bits[x]).otherwise(0) for x, c in failures(F.col("t"), F.col("w")).items()), F.lit(0))
    rows = cut(own.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.coalesce("t", F.lit("")).cast("binary"), 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["id", "digest"], "left").select("id", "part", (F.col("mask") + F.when(copy, bits[copies]).otherwise(0)).alias("mask"))


def mask_histogram(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, cells): for each part its cells (mask, n, good, toxic), 32 at most, with the rows that labels call good (quality 1) and toxic.

    Labels are optional; of several labels of one id 1 counts, a null is no label.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    one = lambda c: F.count_if(F.coalesce(F.col(c) == 1, F.lit(False)))
    cells = masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def order_audit(histogram: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, from the cells of a part: no document is looked at again.

    A step removes the cells that have its bit and none of an earlier step's. shapley sums what the filter removes over all orders: a cell with b bits
    goes to each of them in an equal share of the orders, 5! / b.
    """
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(LETTERS))), ",")
    rows = histogram.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    seen = F.aggregate(F.sequence(F.lit(1), F.lit(len(LETTERS))), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), _bit(F.substring("filter_order", i, F.lit(1)))).otherwise(0))
    rows = rows.select("part", "cells", "filter_order", "step", _bit(F.substring("filter_order", F.col("step"), F.lit(1))).alias("own"), seen.alias("before"))
    has, gone = (lambda c: c["mask"].bitwiseAND(F.col("own")) != 0), (lambda c: c["mask"].bitwiseAND(F.col("before")) != 0)
    total = lambda name, value, keep: F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(keep(c), value(c)).otherwise(0)).alias(name)
    n = lambda c: c["n"]
    share = lambda c: c["n"] * F.floor(F.lit(factorial(len(LETTERS))) / F.bit_count(c["mask"]))
    return rows.select(
        "part", "filter_order", "step",
        total("kept", n, lambda c: ~has(c) & ~gone(c)),
        total("removed", n, lambda c: has(c) & ~gone(c)),
        total("redundant", n, lambda c: has(c) & gone(c)),
        total("unique_fails", n, lambda c: c["mask"] == F.col("own")),
        total("good_lost", lambda c: c["good"], lambda c: has(c) & ~gone(c)),
        total("toxic_lost", lambda c: c["toxic"], lambda c: has(c) & ~gone(c)),
        F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(has(c), share(c)).otherwise(0)).alias("shapley"),
    )


def _bit(letter: Column) -> Column:
    return F.pow(F.lit(2.0), F.instr(F.lit(LETTERS), letter) - 1).cast("int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the five filters over docs.

    An empty table has no part and gives no row. See failure_masks for nulls, copies and repeated rows.
    """
    return order_audit(mask_histogram(failure_masks(docs), labels))

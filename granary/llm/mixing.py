"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, uniform, word_count

#: A source's order of documents is cut into so many parts, twice, before rows are put in line.
_PARTS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target): the total shared by weight, at most `most` times a source's size each.

    sizes: one row (source, source_size) for each source, so the windows here see sources, not documents.
    Sources are ordered by code point, null last, and get the weights in turn, repeating. What a source
    at its limit cannot take is shared among the others by weight until none is above: with l the level that
    solves sum(min(most * size, l * weight)) = total, the sources below size * most / weight = l are at their limit.
    A source without words has target 0; the sum of targets is the total of sizes.
    """
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    x = sizes.withColumn("w", F.element_at(in_turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    x = x.withColumn("ratio", F.col("cap") / F.col("w"))
    # of sources that fill up at the same level the order does not matter
    fill = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the level is the first whose source does not fill up
    x = x.withColumn("solved", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("solved") * F.col("w"), F.col("cap")))
    return x.withColumn("target", target).drop("w", "cap", "total", "ratio", "level", "solved")


def pareto_key(odds: Column, share: Column) -> Column:
    """Rank variable of Pareto sampling: odds of a uniform number over odds of inclusion."""
    return (odds / (1 - odds)) / (share / (1 - share))


def _parted(q: Column) -> tuple[Column, Column]:
    """Cell of a rank variable: equal shares of the range of q / (1 + q), and shares of these."""
    place = q / (1 + q) * _PARTS
    part = F.least(F.floor(place), F.lit(_PARTS - 1))
    return part, F.least(F.floor((place - part) * _PARTS), F.lit(_PARTS - 1))


def _ends(drawn: DataFrame) -> DataFrame:
    """(source_key, end_part, end_fine, end_q, end_row): where the order sample of each source ends.

    drawn has source_key, row_key, size, budget, q. In each source the documents with the smallest q are taken while that brings
    the words nearer to budget. The running sum is taken in three steps, by cells of q twice and then by rows, so
    a source of any size is spread over tasks: only sums of cells, and the rows of one small
    cell of a source, are put in line.
    """
    part, fine = _parted(F.col("q"))
    celled = drawn.withColumn("part", part).withColumn("fine", fine)
    sums = celled.groupBy("source_key", "part", "fine").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    coarse = sums.groupBy("source_key", "part").agg(F.sum("words").alias("words"), F.first("budget").alias("budget"))

    def crossing(cells: DataFrame, keys: list[str], by: str, start: Column) -> DataFrame:
        """The one cell of each key in which the running sum passes the budget."""
        line = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        before = start + F.coalesce(F.sum("words").over(line), F.lit(0))
        return cells.withColumn("before", before).where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))

    at = crossing(coarse, ["source_key"], "part", F.lit(0)).select("source_key", "part", F.col("before").alias("start"))
    cells = sums.join(at, ["source_key", "part"])
    at = cut(crossing(cells, ["source_key", "part"], "fine", F.col("start")).select("source_key", "part", "fine", "before"))
    rows = celled.join(at, ["source_key", "part", "fine"])
    line = Window.partitionBy("source_key").orderBy("q", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("row_before", F.col("before") + F.coalesce(F.sum("size").over(line), F.lit(0)))
    last = rows.where(F.col("row_before") + F.col("size") / 2 <= F.col("budget")).groupBy("source_key").agg(F.max(F.struct("q", "row_key")).alias("last"))
    return at.join(last, "source_key", "left").select("source_key", F.col("part").alias("end_part"), F.col("fine").alias("end_fine"), F.col("last.q").alias("end_q"), F.col("last.row_key").alias("end_row"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: str = "mix:", small: int = 100_000) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target, mix_copies, mix_taken added.

    Sizes are words. Every document is taken floor(target / source_size) times whole: these copies are
    certain. The rest of the target is a Pareto order sample of the source's documents without replacement: by odds of a
    uniform number (from seed and id) over odds of inclusion, the latter growing with a document's size between
    half and twice its source's mean. It ends where another document would not bring the source nearer
    to its target, so the words are fixed within half a document. No document is taken over `most` times.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own; rows with a null id are
    ranked by their text, and rows that are wholly alike are taken alike; no row is dropped; columns that have the
    names of added ones are replaced. The table of sources is broadcast only if it has at most `small` rows.
    """
    source, text, ident = F.col("source"), F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("string")
    row_key = F.coalesce(ident, F.concat(F.lit("null:"), F.md5(text.cast("binary"))))
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
    docs = docs.drop(*added)
    source_key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))
    sized = cut(docs.select(source.cast("string").alias("source"), source_key.alias("source_key"), row_key.alias("row_key"), word_count(F.col("text")).alias("size")))
    totals = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    goal = targets(totals, weights, float(most))
    ratio = F.col("target") / F.col("source_size")
    some = F.col("source_size") > 0
    plan = goal.withColumn("copies", F.when(some, F.least(F.floor(ratio), F.lit(most))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.when(F.col("copies") < most, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("share", F.when(some, F.col("budget") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = cut(plan.withColumn("mean", F.col("source_size") / F.greatest("n", F.lit(1))).select("source_key", "source_size", "target", "copies", "budget", "share", "mean"))
    beside = F.broadcast if plan.count() <= small else (lambda x: x)

    def ranked(rows: DataFrame) -> DataFrame:
        lean = F.least(F.greatest(F.col("size") / F.col("mean"), F.lit(0.5)), F.lit(2.0))
        inclusion = F.least(F.col("share") * lean, F.lit(0.999))
        return rows.withColumn("q", F.when((F.col("size") > 0) & (F.col("budget") > 0), pareto_key(uniform(F.col("row_key"), seed), inclusion)))

    drawn = ranked(sized.join(beside(plan), "source_key")).where("q is not null").select("source_key", "row_key", "size", "budget", "q")
    ends = cut(_ends(drawn))
    plan = plan.join(ends, "source_key", "left")
    names = docs.columns
    whole = ranked(docs.select(F.struct(*names).alias("_row"), source_key.alias("source_key"), row_key.alias("row_key"), word_count(F.col("text")).alias("size")).join(beside(plan), "source_key"))
    part, fine = _parted(F.col("q"))
    inside = F.col("end_part").isNull() | (part < F.col("end_part")) | ((part == F.col("end_part")) & ((fine < F.col("end_fine")) | ((fine == F.col("end_fine")) & F.coalesce(F.struct("q", "row_key") <= F.struct("end_q", "end_row"), F.lit(False)) & F.col("end_q").isNotNull())))
    copies = F.when(F.col("size") > 0, F.col("copies") + F.when(F.col("q").isNotNull() & inside, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    whole = whole.withColumn("_copies", copies)
    return whole.select("_row.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("_copies").alias("mix_copies"), (F.col("_copies") * F.col("size")).alias("mix_taken"))

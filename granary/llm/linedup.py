"""Line dedup: later copies of repeated runs of lines, found by prefix doubling over line ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, beside, cut, join_unique, let

_LEAST = -(1 << 63)
_KEY = ("did", "th")


def _key(docs: DataFrame) -> DataFrame:
    """docs with the key of a document: its id (null as the least) and a hash of its text."""
    return docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def later_copies(docs: DataFrame) -> tuple[DataFrame, bool]:
    """((did, th) of documents whose text an earlier document has, whether a document is there twice)."""
    rows = _key(docs).select(*_KEY, F.length(F.coalesce("text", F.lit(""))).alias("size")).groupBy(*_KEY, "size").agg(F.count(F.lit(1)).alias("c"))
    rows = cut(rows)
    first = rows.groupBy("th", "size").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("th", "size", "first")
    copies = join_unique(rows, cut(first), ["th", "size"]).where("did <> first").select(*_KEY)
    return cut(copies), not rows.where("c > 1").isEmpty()


def line_table(docs: DataFrame, copies: DataFrame, repeated: bool, small: int = 100_000) -> DataFrame:
    """(did, th, pos, idx, h1, h2, w): lines with a word, in order, of the first document of each text.

    idx counts all lines, w words; h1, h2 are the line's id.
    """
    own = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("idx"), x.alias("line"))), lambda x: x["line"].rlike(WORD))
    rows = _key(docs).select(*_KEY, F.posexplode(own).alias("pos", "x"))
    rows = rows.select(*_KEY, "pos", F.col("x.idx").alias("idx"), F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), "x.line").alias("h2"), F.regexp_count("x.line", F.lit(WORD)).cast("long").alias("w"))
    rows = rows.join(beside(copies, small), list(_KEY), "left_anti")
    return rows.distinct() if repeated else rows


def _ranked(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(a, b, name) of the pairs that occur twice at least; name orders them as (a, b) do.

    A range partitioning puts equal and neighbouring pairs together, so numbers that grow along the
    sorted partitions are ranks. The checkpoint fixes them.
    """
    pairs = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(a, b)
    return cut(pairs.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn(name, F.monotonically_increasing_id()))


def suffix_ranks(lines: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(positions, levels): suffixes of the line sequences in the order of their first 1, 2, 4, ... lines.

    levels[k] has (did, th, pos, r): the rank of the 2^k lines from a position on among the blocks that occur at least twice;
    others have no row. Equal ranks are an interval of the suffix array whose common prefixes have 2^k lines
    at least. A round doubles the length: it ranks the pairs of a block's rank and that of the block behind it. It ends when no longer block
    occurs twice, or blocks of over half of `longest` lines are ranked: two of them, overlapping, name any block of up to `longest` lines.
    positions has the lines that occur twice, with their index, words and rank.
    """
    names = _ranked(lines, "h1", "h2", "r")
    positions = cut(join_unique(lines, names, ["h1", "h2"]).select(*_KEY, "pos", "idx", "w", "r"))
    levels = [positions.select(*_KEY, "pos", "r")]
    while 2 << (len(levels) - 1) <= longest:
        size = 1 << (len(levels) - 1)
        ahead = Window.partitionBy(*_KEY).orderBy("pos").rangeBetween(size, size)
        paired = cut(levels[-1].withColumn("next", F.max("r").over(ahead)).where("next is not null"))
        names = _ranked(paired, "r", "next", "rank")
        if names.isEmpty():
            break
        levels.append(cut(join_unique(paired, names, ["r", "next"]).select(*_KEY, "pos", F.col("rank").alias("r"))))
    return positions, levels


def repeated_lines(docs: DataFrame, min_words: int = 50, small: int = 100_000) -> DataFrame:
    """(did, th, gone, whole): for each document that loses lines, their indexes; whole: all lines with a word.

    Earlier means a smaller (id, text hash, position). A line goes if it lies in a run of lines of min_words words at least that an
    earlier position has too, so every later copy of a maximal run goes to its full length, whichever earlier copy it shares most with.

    From each position the shortest run of min_words words is taken (its seed). Its name, by suffix_ranks, is the ranks of its first
    and its last 2^k lines, so seeds with one name form an interval of the suffix array, and all but the first repeat an earlier one. Where
    neighbouring positions repeat, what the last of them shares with an earlier suffix ends last, so only there the longest
    common prefix is looked for. It goes on for under min_words words behind that position, else the next one would repeat too: of each
    member of the interval the prefixes of these few lines are named, and the longest whose first owner is earlier counts.

    A document with the text of an earlier one repeats it to its end; only the first of them takes part in the search.
    """
    copies, again = later_copies(docs)
    lines = cut(line_table(docs, copies, again, small))
    table, levels = suffix_ranks(lines, min_words)
    top = len(levels) - 1
    doc = Window.partitionBy(*_KEY).orderBy("pos")
    run = Window.partitionBy(*_KEY, "island")
    rows = table.withColumn("island", F.col("pos") - F.row_number().over(doc)).withColumn("upto", F.sum("w").over(run.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("w"))
    near = run.orderBy("before").rangeBetween(0, min_words - 1)
    ahead = F.collect_list("r").over(run.orderBy("upto").rangeBetween(1, min_words - 1))
    seeds = rows.withColumn("last", F.max("pos").over(near)).withColumn("words", F.max("upto").over(near) - F.col("before")).withColumn("ahead", ahead).where(F.col("words") >= min_words)
    size = (F.col("last") - F.col("pos") + 1).cast("int")
    # the largest k with 2^k <= size; a run twice as long as the longest repeated block is not repeated
    level = F.least(F.floor(F.log2(size.cast("double")) + F.lit(1e-9)).cast("int"), F.lit(top))
    # of the lines behind the position those that its seed does not have
    more = F.slice("ahead", size, F.greatest(F.size("ahead") - size + 1, F.lit(0)))
    seeds = seeds.select(*_KEY, "pos", "last", size.alias("size"), level.alias("k"), more.alias("more")).where(F.col("size") < F.lit(2 << top))
    seeds = seeds.withColumn("tail", (F.col("last") + 1 - F.expr("cast(shiftleft(1, k) as int)")).cast("int"))
    every = None
    for k, one in enumerate(levels):
        one = one.withColumn("k", F.lit(k))
        every = one if every is None else every.unionByName(one)
    heads = every.withColumnRenamed("r", "a")
    ends = every.select(*_KEY, F.col("pos").alias("tail"), "k", F.col("r").alias("b"))
    name, place = ["size", "a", "b"], F.struct(*_KEY, "pos")
    seeds = cut(seeds.join(heads, [*_KEY, "pos", "k"]).join(ends, [*_KEY, "tail", "k"]).select(*_KEY, "pos", *name, "more"))
    firsts = cut(seeds.groupBy(*name).agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*name, "f"))
    members = cut(join_unique(seeds, firsts, name).withColumn("later", place != F.col("f")).drop("f"))
    hits = cut(members.where("later").withColumn("goes_on", F.coalesce(F.lead("pos").over(doc) == F.col("pos") + 1, F.lit(False))).select(*_KEY, "pos", *name, "more", "goes_on"))
    last = hits.where("not goes_on")
    # the prefixes of what follows a seed, with the first position that has each
    followed = members.where(F.size("more") > 0)
    wanted = last.where(F.size("more") > 0).select(*name).distinct()
    if wanted.limit(small + 1).count() <= small:
        followed = followed.join(F.broadcast(wanted), name, "left_semi")

    def prefixes(x: DataFrame) -> DataFrame:
        each = x.select(*_KEY, "pos", *name, "more", F.explode(F.sequence(F.lit(1), F.size("more"))).alias("e"))
        return each.select(*_KEY, "pos", *name, "e", F.xxhash64(F.slice("more", F.lit(1), F.col("e"))).alias("x"))

    keys = [*name, "e", "x"]
    shared = cut(prefixes(followed).groupBy(*keys).agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, "f"))
    asked = cut(prefixes(last.where(F.size("more") > 0)))
    further = join_unique(asked, shared, keys).where(F.col("f") < place).groupBy(*_KEY, "pos").agg(F.max("e").alias("e"))
    spans = hits.where("goes_on").select(*_KEY, "pos", (F.col("pos") + F.col("size")).cast("int").alias("end"))
    spans = spans.unionByName(last.join(further, [*_KEY, "pos"], "left").select(*_KEY, "pos", (F.col("pos") + F.col("size") + F.coalesce("e", F.lit(0))).cast("int").alias("end")))
    covered = table.select(*_KEY, "pos", "idx").join(spans, [*_KEY, "pos"], "left").withColumn("reach", F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    gone = covered.where("reach > pos").groupBy(*_KEY).agg(F.collect_set("idx").alias("gone"))
    return gone.select(*_KEY, "gone", F.lit(False).alias("whole")).unionByName(copies.select(*_KEY, F.array().cast("array<int>").alias("gone"), F.lit(True).alias("whole")))


def dedup_lines(docs: DataFrame, min_words: int = 50, small: int = 1_000_000) -> DataFrame:
    """docs with text_kept, lines_gone and emptied added: the text without lines that repeat an earlier run.

    A run counts if it has min_words words at least and lies in one document; it may overlap its source.
    Lines without a word are not compared and stay. emptied: the text had words and has none left (an exact copy of a text of min_words words).
    Null texts stay null, empty ones empty; an empty table gives none; texts of any length are cut by the line, never sampled; rows with one
    id and one text are one document and are treated alike; of rows with one id and different texts the one with the smaller text
    hash is the earlier; null ids are the earliest; no row is dropped. Columns of docs named text_kept, lines_gone or emptied are replaced.
    The table of deletions is broadcast only if it has at most `small` lines; else texts are shuffled once to meet it.
    """
    gone = cut(repeated_lines(docs.select("doc_id", "text"), min_words))
    few = (gone.agg(F.sum(F.size("gone") + 3).alias("n")).first().n or 0) <= small
    docs = docs.drop("text_kept", "lines_gone", "emptied")
    names = docs.columns
    joined = _key(docs.select(F.struct(*names).alias("_row"), "doc_id", "text")).join(F.broadcast(gone) if few else gone, list(_KEY), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(F.transform(kept, lambda i: F.get(lines, i)).alias("kept"), F.size("gone").alias("n"))

    def none_left(lines: Column) -> Column:
        return let(F.filter(lines, lambda x: ~x.rlike(WORD)), lambda kept: F.struct(kept.alias("kept"), (F.size(lines) - F.size(kept)).alias("n")))

    # a copy of a text with too few words repeats no run
    lost = F.col("whole") & (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) >= min_words)
    made = let(_lines(F.col("text")), lambda lines: F.when(lost, none_left(lines)).when(~F.col("whole"), rest(lines)))
    out = joined.select("_row", "text", F.when(F.col("whole").isNotNull(), made).alias("_made"))
    text = F.when(F.col("_made").isNull(), F.col("text")).otherwise(F.array_join("_made.kept", "\n"))
    out = out.select("_row", text.alias("text_kept"), F.coalesce("_made.n", F.lit(0)).alias("lines_gone"))
    return out.select("_row.*", "text_kept", "lines_gone", ((F.col("lines_gone") > 0) & ~F.col("text_kept").rlike(WORD)).alias("emptied"))


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with their own columns: texts (and n_chars, if there is one) after dedup_lines, without the rows that it emptied.

    Nulls, ties, repeated rows, empty tables and long texts are as in dedup_lines; columns of any name keep their values.
    """
    taken = {"text_kept", "lines_gone", "emptied", "_own"} & set(docs.columns)
    # columns that have the names of the operator's own are carried in a struct
    rows = docs.select(*[c for c in docs.columns if c not in taken], F.struct(*sorted(taken)).alias("_own")) if taken else docs
    done = dedup_lines(rows, min_words).where(~F.col("emptied"))
    kept = {c: F.col("_own")[c] for c in taken} | {"text": F.col("text_kept")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col("lines_gone") > 0, F.length("text_kept").cast("long")).otherwise(F.col("n_chars"))
    return done.select(*[kept.get(c, F.col(c)).alias(c) for c in docs.columns])

"""Document fingerprints by I-Match: hashes of a text's terms in randomised sub-lexicons of an idf band."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, cut, let, word_array

#: The lexicon's terms are looked up in so many buckets.
BUCKETS = 1 << 13
#: Sub-lexicons of a level, and the factor by which the next level has more.
GROUPS, STEP = 16, 4


def terms(text: Column) -> Column:
    """The distinct terms of a text: 64-bit hashes of its lower-cased words."""
    return F.array_distinct(F.transform(word_array(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 0.0005, high: float = 0.08) -> DataFrame:
    """One row with the terms whose document frequency lies in the band, in an array of BUCKETS arrays.

    low and high are shares of all documents (idf from ln(1/high) to ln(1/low)); frequencies are counted
    for each term over all documents, empty ones included. At least one document must have the term. Texts with t distinct
    terms on average have at most t / low terms in the band, so the row's size does not grow with the corpus.
    """
    count = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").count()
    total = docs.select(F.count(F.lit(1)).alias("n"))
    known = count.withColumn("n", total.scalar())
    inside = known.where((F.col("count") >= F.col("n") * F.lit(low)) & (F.col("count") <= F.col("n") * F.lit(high)))
    own = inside.groupBy(_bucket(F.col("term")).alias("at")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("at"))
    rows = every.join(own, "at", "left").select("at", F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))
    return cut(rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("at", "terms"))).alias("w")).select(F.transform("w", lambda x: x["terms"]).alias("lexicon")))


def _bucket(term: Column) -> Column:
    return F.pmod(term, F.lit(BUCKETS)).cast("int")


def _in_band(band: Column, term: Column) -> Column:
    return F.array_contains(F.get(band, _bucket(term)), term)


def fingerprint(text: Column, band: Column) -> Column:
    """struct(level, hashes) of a text: 2 * GROUPS hashes, null where a sub-lexicon has none of its terms.

    The text's terms in the band (all its terms if none is) are sorted; sub-lexicon g of a level with m of
    them holds the terms whose random number modulo m is g. Two levels follow from the number of terms, so that a
    sub-lexicon has a few terms of a text of any length; texts of similar length share a level.
    """
    def hashes(own: Column, m: Column, up: int) -> Column:
        numbered = F.filter(F.transform(own, lambda t: F.struct(F.pmod(F.xxhash64(t, F.lit(up)), m).cast("int").alias("g"), t.alias("t"))), lambda x: x["g"] < GROUPS)
        # one array for each sub-lexicon, in the order of the terms
        return let(numbered, lambda n: F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: _hash(F.filter(n, lambda x: x["g"] == g))))

    def of(own: Column) -> Column:
        level = F.greatest(F.floor(F.ln(F.greatest(F.size(own), F.lit(1)) / F.lit(float(GROUPS))) / F.ln(F.lit(float(STEP))) + F.lit(1e-9)), F.lit(0)).cast("int")
        both = lambda n: F.concat(let(_groups(n), lambda m: hashes(own, m, 0)), let(_groups(n + 1), lambda m: hashes(own, m, 1)))
        return let(level, lambda n: F.struct(n.alias("level"), both(n).alias("hashes")))

    def chosen(every: Column) -> Column:
        return let(F.filter(every, lambda t: _in_band(band, t)), lambda kept: of(F.when(F.size(kept) > 0, kept).otherwise(every)))

    return let(F.sort_array(terms(text)), chosen)


def _groups(level: Column) -> Column:
    return (F.lit(GROUPS) * F.pow(F.lit(float(STEP)), level)).cast("long")


def _hash(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.xxhash64(x))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sub-lexicons, of levels that both have, in which either text has terms.

    1 if neither has any (two empty texts), 0 without a common level.
    """

    def share(x: Column, y: Column) -> Column:
        pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
        same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
        return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(same / F.size(pairs))

    x, y = a["hashes"], b["hashes"]
    step = a["level"] - b["level"]
    return F.when(step == 0, share(x, y)).when(step == 1, share(F.slice(x, 1, GROUPS), F.slice(y, GROUPS + 1, GROUPS))).when(step == -1, share(F.slice(x, GROUPS + 1, GROUPS), F.slice(y, 1, GROUPS))).otherwise(F.lit(0.0))


def written(f: Column) -> Column:
    """A fingerprint as text: the level and eight hex digits for each sub-lexicon, - for none."""
    return F.concat(f["level"].cast("string"), F.lit(":"), F.array_join(F.transform(f["hashes"], lambda h: F.coalesce(F.lower(F.substring(F.lpad(F.hex(h), 16, "0"), 9, 8)), F.lit("-"))), "."))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.0005, high: float = 0.08) -> DataFrame:
    """docs with a column `fingerprint` (see fingerprint) from the lexicon of docs itself.

    Null texts count as empty; an empty text has no terms, so only null hashes; repeated rows have equal
    fingerprints; an empty table gives none; texts of any length are taken whole; a column named fingerprint is replaced, others stay whatever their names.
    """
    band = lexicon(docs, text_col, low, high).scalar()
    rows = docs.drop("fingerprint")
    carried = rows.select(F.struct(*rows.columns).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("said")).withColumn("band", band)
    return carried.withColumn("made", fingerprint(F.col("said"), F.col("band"))).select("own.*", F.col("made").alias("fingerprint"))


def _following(keys: DataFrame, width: int) -> DataFrame:
    """(key, next) for each distinct key: the next smaller one, null for the smallest.

    Keys are cut into ranges of `width` values; only inside a range are they put in line, and the ranges are
    linked by the same means, so no task sees more than `width` keys.
    """
    keys = cut(keys.select("key").distinct())
    if keys.limit(width + 1).count() <= width:
        return keys.select("key", F.lead("key").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("key"))).alias("next"))
    ranged = keys.withColumn("range", F.floor(F.col("key") / width).cast("long"))
    inner = ranged.select("key", "range", F.lead("key").over(Window.partitionBy("range").orderBy(F.desc("key"))).alias("next"))
    tops = ranged.groupBy("range").agg(F.max("key").alias("top"))
    links = _following(tops.select(F.col("range").alias("key")), width).select(F.col("key").alias("range"), F.col("next").alias("below"))
    after = links.join(tops.select(F.col("range").alias("below"), F.col("top").alias("after")), "below").select("range", "after")
    return inner.join(after, "range", "left").select("key", F.coalesce("next", "after").alias("next"))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", width: int = 512, small: int = 50_000, task: int = 32_000_000, later: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with next_<c> for each column c: the value in the next row by descending id, after the last row the first.

    Each row moves once and whole, to the range of ids that it belongs to (`width` values), ranges being dealt to as many tasks as give each about `task` characters;
    a copy of the row behind a range's end goes along with it, so nothing moves again. Rows with one id stand in the order of their text. Rows with a null id are
    their own next row. Columns of docs named next_<c> are replaced, others stay whatever their names. later: adds columns to rows that have moved, which
    `columns` may name (it keeps the columns _key and _range, by which rows lie); so they are worked out once a row and not moved.
    """
    docs = docs.drop(*[f"next_{c}" for c in columns])
    names = docs.columns
    text = [c for c, t in docs.dtypes if t == "string" and c in columns]
    size = sum((F.coalesce(F.length(F.col(c)), F.lit(0)) for c in text), F.lit(64))
    of_own = lambda some: [F.col("own")[c].alias(c) for c in some]
    carried = docs.select(F.struct(*names).alias("own"), F.col(id_col).cast("long").alias("key"))
    carried = carried.withColumn("range", F.floor(F.col("key") / width).cast("long"))
    known = carried.where("key is not null")
    tops = docs.where(F.col(id_col).isNotNull()).groupBy(F.floor(F.col(id_col) / width).cast("long").alias("range")).agg(F.max(F.col(id_col).cast("long")).alias("top"), F.sum(size).alias("size"))
    tops = cut(tops)
    parts = int(max(1, -(-(tops.agg(F.sum("size")).first()[0] or 0) // task)))
    links = _following(tops.select(F.col("range").alias("key")), 2048).select(F.col("key").alias("range"), F.col("next").alias("below"))
    first = tops.agg(F.max("top").alias("first"))
    ends = links.join(tops.select(F.col("range").alias("below"), F.col("top").alias("after")), "below", "left").select("range", F.coalesce("after", first.scalar()).alias("key"))
    ends = cut(ends)
    heads = known.select("own", "key").join(beside(ends, small), "key").groupBy("range").agg(F.min_by("own", F.struct(*of_own(c for c in columns if c in names))).alias("own"))

    def added(rows: DataFrame) -> DataFrame:
        if later is not None:
            rows = later(rows.select("own.*", F.col("key").alias("_key"), F.col("range").alias("_range")))
            rows = rows.select(F.struct(*[c for c in rows.columns if c not in ("_key", "_range")]).alias("own"), F.col("_key").alias("key"), F.col("_range").alias("range"))
        return rows.withColumn("want", F.struct(*of_own(columns)))

    # the row from behind the end has no key, which stands last
    moved = known.unionByName(heads.select("own", F.lit(None).cast("long").alias("key"), "range")).repartition(parts, "range")
    w = Window.partitionBy("range").orderBy(F.desc("key"), F.struct(F.lit(0), *of_own(text)))
    out = added(moved).withColumn("next", F.lead("want").over(w)).where("key is not null").select("own", "next")
    out = out.unionByName(added(carried.where("key is null")).select("own", F.col("want").alias("next")))
    return out.select("own.*", *[F.col(f"next.{c}").alias(f"next_{c}") for c in columns])


def edited_likeness(docs: DataFrame, low: float = 0.0005, high: float = 0.08) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how like these and the next documents' they are.

    The edited text: the last floor(n/3) code points are replaced by the first as many (or all) of the next document.
    Null texts count as empty; rows with one id stand in the order of their text, and rows with a null id are their own next row; repeated rows are
    each returned; an empty table gives none; texts of any length are taken whole; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    band = lexicon(rows, "text", low, high).scalar()
    own = lambda d: d.withColumn("_band", band).select("doc_id", "text", "_key", "_range", F.explode(F.array(fingerprint(F.col("text"), F.col("_band")))).alias("fingerprint"))
    both = with_next(rows, ["text", "fingerprint"], later=own)
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    both = both.withColumn("_band", band)
    of_edited = let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e, F.col("_band")).alias("fp")))
    # one row of an array, so that the parts of the struct are not worked out again for each use
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.explode(F.array(of_edited)).alias("e"))
    both = both.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), "fingerprint", F.col("e.fp").alias("ef"), "next_fingerprint")
    return both.select("doc_id", "n_chars", "edited_sha256", written(F.col("fingerprint")).alias("fingerprint"), written(F.col("ef")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("ef")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))

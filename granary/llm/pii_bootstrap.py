"""Personal data: four base kinds by pattern, and further identifiers by bootstrapped contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, beside, cut, join_unique, let

#: Kinds in the order that breaks ties, then the kind of what contexts add.
KINDS = ("email", "ip", "card", "phone")
LEARNT = "id"

#: Matches whose places are worked out together.
BLOCK = 256

# Possessive quantifiers keep the matcher from recursing and from going back over long runs; a match can only begin where a run
# of its characters begins or the match before it ended, so the results are those of the plain patterns.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
_CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_OK = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: A word with a digit or an at sign may be an identifier; so may several of them with single blanks between (a number in groups).
_ONE = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_IDENT = rf"(?:(?<![^\x20\x09-\x0D])){_ONE}(?:\x20{_ONE})*+"
#: Identifiers that are known beside the base kinds: keys of at least 32 lower-case hexadecimal digits.
KEY = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
_EDGE = r"^[^\p{L}\p{N}@+]+|[^\p{L}\p{N}]+$"


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, value)> of the leftmost matches that do not overlap, in code points.

    Spark returns what a pattern matched but not where; the text between matches comes from a
    split by the same pattern, and running lengths of both give the places.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    between = F.transform(pieces, lambda x: F.length(x))
    zipped = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("g"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    def placed(z: Column) -> Column:
        """Running lengths by blocks of BLOCK matches, as each step copies what it has of its block."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK)))

        def joined(parts: Column) -> Column:
            size = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["g"] + F.length(y["m"])))
            start = F.aggregate(size, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
            return F.flatten(F.zip_with(parts, start, lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

        return F.when(F.size(z) == 0, none).otherwise(let(blocks, joined))

    return let(zipped, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's check: every second digit from the right doubled, sum divisible by ten."""
    turned = F.split(F.reverse(_digits(value)), "")
    each = F.transform(F.filter(turned, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct(start, kind, end, value)>: the four base kinds by start, then kind (as its place in KINDS)."""
    size = lambda v: F.length(_digits(v))
    kinds = (
        (_EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (_IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(_IP_OK)),
        (_CARD, text.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"), lambda v: (size(v) <= 19) & _luhn(v)),
        (_PHONE, F.contains(text, F.lit("+")), lambda v: size(v).between(10, 15)),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def of(i: int, pattern: str, right) -> Column:
        good = F.filter(matches(text, pattern), lambda m: right(m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    # most texts have none: the costly patterns only run where a cheap test lets them
    own = [F.when(maybe, of(i, pattern, right)).otherwise(none) for i, (pattern, maybe, right) in enumerate(kinds)]
    return F.array_sort(F.concat(*own))


def _plain(word: Column) -> Column:
    """A word without case and punctuation at its edges; as it is if it has nothing else."""
    bare = F.regexp_replace(word, _EDGE, "")
    return F.when(bare == "", word).otherwise(bare)


def _words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), SPACE), ""), _plain)


def contexts(text: Column, pattern: str) -> Column:
    """array<struct(left2, left, right)> for the matches of pattern: the two words before each, and the one behind; empty where there is none.

    Words count up to the matches on either side, so each part of a text is looked at twice at most, whatever its length.
    """
    # only the edges of a piece matter: its last two words and its first
    def edge(piece: Column) -> Column:
        tail = F.reverse(F.regexp_extract(F.reverse(piece), r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){0,2}", 0))
        return F.struct(_words(tail).alias("last"), F.get(_words(F.regexp_extract(piece, r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+", 0)), F.lit(0)).alias("first"))

    def around(e: Column) -> Column:
        sides = F.arrays_zip(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))).alias("b"), F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))).alias("a"))
        nearest = lambda w, k: F.coalesce(F.get(w, F.size(w) - k), F.lit(""))
        return F.transform(sides, lambda x: F.struct(F.when(F.size(x["b"]["last"]) > 1, F.concat_ws(" ", x["b"]["last"])).otherwise("").alias("left2"), nearest(x["b"]["last"], 1).alias("left"), F.coalesce(x["a"]["first"], F.lit("")).alias("right")))

    return let(F.transform(F.split(text, pattern, -1), edge), around)


def identifiers(rows: DataFrame) -> DataFrame:
    """(row, start, end, value, seed, covered, left2, left, right) of the words of rows (row, text, base) that look like identifiers.

    value has no punctuation at its edges; covered: it overlaps a base span; seed: that, or it has the form of a KEY; the others are its context (see
    contexts). Base spans and words meet in one line of each text, by their starts, so a text of many of both is sorted once.
    """
    some = rows.where(F.col("text").rlike("[0-9@]"))
    each = some.select("row", F.explode(F.arrays_zip(matches(F.col("text"), _IDENT).alias("m"), contexts(F.col("text"), _IDENT).alias("c"))).alias("x"))
    raw = F.col("x.m.value")
    lead = F.length(raw) - F.length(F.regexp_replace(raw, r"^[^\p{L}\p{N}@+]+", ""))
    clean = F.regexp_replace(raw, _EDGE, "")
    start = F.col("x.m.start") + lead
    each = each.select("row", start.alias("start"), (start + F.length(clean)).alias("end"), clean.alias("value"), "x.c.*").where("value <> ''").distinct()
    spans = some.select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end").distinct()
    blank = [F.lit(None).cast("string").alias(c) for c in ("value", "left2", "left", "right")]
    both = each.select("row", "start", "end", F.lit(None).cast("int").alias("base_end"), "value", "left2", "left", "right").unionByName(spans.select("row", "start", "end", F.col("end").alias("base_end"), *blank))
    line = Window.partitionBy("row").orderBy("start")
    upto = F.max("base_end").over(line.rangeBetween(Window.unboundedPreceding, 0))
    # from the end on, as a frame that is open behind would be gone through again for each row
    back = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    ahead = F.min(F.when(F.col("base_end").isNotNull(), F.col("start"))).over(back)
    covered = (F.coalesce(upto, F.lit(0)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
    met = both.withColumn("covered", covered).where("value is not null")
    return met.select("row", "start", "end", "value", (F.col("covered") | F.col("value").rlike(KEY)).alias("seed"), "covered", "left2", "left", "right")


def learnt_instances(found: DataFrame, texts: DataFrame, rounds: int = 2, support: int = 3, sure: float = 0.6, small: int = 100_000) -> DataFrame:
    """(value): identifiers that contexts of known ones reveal, and the known ones beside the base kinds.

    A pattern is the word on the left of identifiers, the two words there, or the word on the right. Its confidence is the share of its
    occurrences in all texts at which a known instance stands, weighted by the instances' own; it counts if
    `support` different known instances induce it. An instance's confidence is 1 - prod(1 - confidence) over the patterns
    it stands in. Instances of confidence `sure` or more become known, and the graph is scored again, `rounds` times. Known values
    and patterns are tables that are joined, never a list on the driver.
    """
    side = lambda kind, c: F.struct(F.lit(kind).alias("side"), F.col(c).alias("word"))
    edges = found.select("value", "seed", F.explode(F.array(side("L", "left"), side("M", "left2"), side("R", "right"))).alias("p"))
    edges = edges.select("value", "seed", "p.*").where("word <> ''")
    graph = cut(edges.groupBy("side", "word", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    words = cut(graph.groupBy("side", "word").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= support).select("side", "word"))
    # how often these occur at all, in all texts: of all words and pairs only theirs are counted
    asked = words.select(F.when(F.col("side") == "M", 2).otherwise(1).alias("k"), "word").distinct()
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(F.lit(2).alias("k"), F.concat_ws(" ", a, b).alias("word")))
    every = texts.select(F.explode(let(_words(F.col("text")), lambda w: F.concat(F.transform(w, lambda x: F.struct(F.lit(1).alias("k"), x.alias("word"))), pairs(w)))).alias("p")).select("p.*")
    every = every.join(F.broadcast(asked), ["k", "word"], "left_semi") if asked.limit(small + 1).count() <= small else every
    total = cut(join_unique(every.groupBy("k", "word").agg(F.count(F.lit(1)).alias("total")), asked, ["k", "word"], small=small))
    keyed = words.withColumn("k", F.when(F.col("side") == "M", 2).otherwise(1)).join(total, ["k", "word"]).select("side", "word", "total")
    graph = cut(join_unique(graph, cut(keyed), ["side", "word"], small=small).select("side", "word", "value", "n", "seed", "total"))
    known = cut(graph.where("seed").select("value", F.lit(1.0).alias("conf")).distinct())
    for _ in range(rounds):
        share = F.least(F.sum(F.col("n") * F.col("conf")) / F.max("total"), F.lit(1.0))
        pattern = graph.join(known, "value").groupBy("side", "word").agg(share.alias("p"), F.count(F.lit(1)).alias("k")).where((F.col("k") >= support) & (F.col("p") >= sure / 2))
        scored = graph.where("not seed").join(beside(pattern, small), ["side", "word"]).groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("conf")).where(F.col("conf") >= sure)
        known = cut(graph.where("seed").select("value", F.lit(1.0).alias("conf")).distinct().unionByName(scored))
    return known.select("value").unionByName(found.where("seed").select("value")).distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, support: int = 3, sure: float = 0.6) -> DataFrame:
    """(doc_id, base, spans) of every row of docs: arrays of struct(start, kind, end, value), kind as a name.

    base has the four kinds; spans also known keys and what contexts add (kind "id"), where it does not overlap base. Null texts count as empty; a null id
    is returned as it is; repeated rows and copies have equal spans; whole texts of any length count; an empty table gives none; other columns are ignored; without
    identifiers nothing is added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    own = base_spans(F.col("text"))
    # only texts with a digit or an at sign can hold anything; what is found is small beside the texts
    looked = rows.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("row"), "text", own.alias("base"))
    found = cut(identifiers(looked))
    new = cut(learnt_instances(found, rows, rounds, support, sure))
    added = join_unique(found.where("not covered"), new, ["value"]).groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "value")).alias("added"))
    joined = join_unique(cut(rows.select("doc_id", F.xxhash64("text").alias("row"), own.alias("base"))), cut(added), ["row"], "left")
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))))
    names = F.array(*[F.lit(k) for k in (*KINDS, LEARNT)])
    named = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return joined.select("doc_id", named(F.col("base")).alias("base"), named(both).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

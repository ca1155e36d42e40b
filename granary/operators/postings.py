"""Stored postings in blocks with each block's largest weight, and BM25 search over them that leaves out what cannot be among the best (MaxScore)."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieve import analysed, in_blocks, top_k
from .tables import exists, new_path, removed, shared_folder, written

#: Postings of a block, and partitions that a term's hash picks one of.
BLOCK, SHELVES = 32, 16
#: About so many postings of a term meet in one group at most: a term with more is dealt into lanes of whole blocks.
LANE = 1 << 16
#: A task counts the words of documents with about so many words at once.
_WORDS = 1 << 21
#: Changes when tables that are already stored would not do any more.
FORMAT = 5
#: Scores are compared to six digits; what is within this of a limit is kept.
_SLACK = 2e-6
#: Held while an index is looked for and built: searches that run side by side build it once.
_BUILDING = threading.Lock()


@dataclass(frozen=True)
class Postings:
    """An index as its tables: terms (shelf, term, df, blocks, top), lexicon (term, sorted over all files), blocks (shelf, term, part, n, top, hits (id, weight)), and the number of
    documents and shelves.

    A posting's weight is tf / (tf + k1 * (1 - b + b * dl / mean)); top is the largest one. A term's blocks are dealt by a hash of the document's id, so it is known
    in which block a document must be. Both tables are partitioned by shelf, a hash of the term.
    """

    path: str
    terms: DataFrame
    lexicon: DataFrame
    blocks: DataFrame
    documents: int
    shelves: int


_TERMS = "term string, df long, blocks long, top double, shelf int"


def open_postings(spark: SparkSession, path: str) -> Postings:
    stats = spark.read.parquet(f"{path}/stats").first()
    kinds = {"terms": _TERMS, "lexicon": "term string", "blocks": f"term string, part long, n long, top double, hits array<struct<id: {stats.id_type}, weight: double>>, shelf int"}
    return Postings(path, *[spark.read.schema(kinds[x]).parquet(f"{path}/{x}") for x in ("terms", "lexicon", "blocks")], stats.documents, stats.shelves)


def build_postings(docs: DataFrame, path: str | None = None, k1: float = 1.2, b: float = 0.75, size: int = BLOCK, shelves: int = SHELVES, slots: int = 4, id_col: str = "doc_id", text_col: str = "text", analyser: Callable[[Column], Column] = analysed, lane: int = LANE) -> Postings:
    """Reads texts once. Postings leave a task as rows of a term with all that its documents have of it, and are shuffled once, to where their blocks are cut.

    A frequent term's postings are spread over tasks: its number of blocks is broadcast (for one row in `lane` postings at most), and its blocks are dealt into
    lanes of about `lane` postings, each a group of its own. Each table has `shelves` partitions of at most `slots` files each, whatever the number of tasks;
    more postings want more slots.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    path = path or new_path(spark, "postings")
    counted = new_path(spark, "counted")
    _counted(docs.select(F.col(id_col).alias("id"), analyser(F.col(text_col)).alias("words")), kind).write.parquet(counted)
    rows = spark.read.schema(_COUNTED.format(kind)).parquet(counted)
    mean = F.coalesce(F.sum("words") / F.sum("n"), F.lit(0.0)).alias("mean")
    stats = rows.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), mean).withColumns({"shelves": F.lit(shelves), "id_type": F.lit(kind)})
    stats.coalesce(1).write.parquet(f"{path}/stats")
    mean = spark.read.parquet(f"{path}/stats").first().mean or 1.0
    own = rows.where("term is not null").drop("words")
    dealt_out = lambda df, *by: df.repartitionById(shelves * slots, (F.col("shelf") * slots + F.pmod(F.xxhash64(*by), F.lit(slots))).cast("int"))
    n_blocks = F.ceil(F.col("df") / size).cast("long").alias("blocks")
    often = own.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") > lane).select("term", n_blocks, F.ceil(F.col("df") / lane).cast("long").alias("lanes"))
    often = F.broadcast(written(often, "often"))
    seldom = own.join(often, "term", "left_anti").withColumns({"blocks": F.lit(None).cast("long"), "lane": F.lit(0).cast("long")})
    dealt = seldom.unionByName(_in_lanes(own.join(often, "term").withColumn("keys", _keys()), kind)).withColumn("shelf", _shelf(F.col("term"), shelves))
    # one shuffle: a block's postings meet where its file is written
    met = dealt_out(dealt, "term", "lane").sortWithinPartitions("term", "lane").select("shelf", "term", "lane", "blocks", "ids", _keys().alias("keys"), "tf", "dl")
    blocks = _cut(met, kind, size, lambda tf, dl: tf / (tf + k1 * (1 - b + b * dl / mean)))
    blocks.sortWithinPartitions("shelf", "term", "part").write.partitionBy("shelf").parquet(f"{path}/blocks")
    made = spark.read.schema("term string, n long, top double, shelf int").parquet(f"{path}/blocks")
    terms = made.groupBy("shelf", "term").agg(F.sum("n").alias("df"), F.max("top").alias("top")).select("shelf", "term", "df", n_blocks, "top")
    dealt_out(terms, "term").sortWithinPartitions("shelf", "term").write.partitionBy("shelf").parquet(f"{path}/terms")
    words = spark.read.schema(_TERMS).parquet(f"{path}/terms").select("term")
    words.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/lexicon")
    removed(spark, counted)
    return open_postings(spark, path)


_COUNTED = "term string, n long, words long, ids array<{}>, tf array<int>, dl array<int>"


def _keys() -> Column:
    return F.transform("ids", lambda i: F.xxhash64(i))


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of values, each from its start to the next one's."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Where equal values begin."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)


def _counted(docs: DataFrame, kind: str) -> DataFrame:
    """Of docs (id, words) rows of a term with the ids of the documents that have it, how often each has it (tf) and each one's words (dl); a row without a term
    has the number of documents and of all their words. A task's documents are taken together up to a number of words, so a term has few rows and the rows are short."""

    def some(ids: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded, n = words.flatten().dictionary_encode(), len(ids)
        place = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), size)
        place.sort()
        at = _starts(place)
        term, doc = np.divmod(place[at], n)
        begins, tf = _starts(term), np.diff(np.append(at, len(place)))
        df = np.diff(np.append(begins, len(term)))
        none = pa.nulls(len(begins), pa.int64())
        lists = [_lists(begins, x) for x in (ids.take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(size[doc].astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), none, *lists], names=names)
        empty = [_lists(np.zeros(1), x.values[:0]) for x in lists]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, coded.dictionary.type), pa.array([n]), pa.array([int(size.sum())]), *empty], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = np.cumsum(pc.list_value_length(b.column("words")).to_numpy(zero_copy_only=False)) // _WORDS
            for i, j in zip(at := _starts(share), [*at[1:], b.num_rows], strict=True):
                yield from some(b.column("id")[i:j], b.column("words")[i:j])

    names = ["term", "n", "words", "ids", "tf", "dl"]
    return docs.where("words is not null").mapInArrow(run, _COUNTED.format(kind))


def _in_lanes(rows: DataFrame, kind: str) -> DataFrame:
    """rows (term, blocks, lanes, ids, keys, tf, dl) cut into a row for each lane that they have postings in; a block is in one lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("ids")).to_numpy())
            blocks, lanes = (b.column(c).to_numpy() for c in ("blocks", "lanes"))
            lane = b.column("keys").flatten().to_numpy() % blocks[row] % lanes[row]
            own = (np.cumsum(lanes) - lanes)[row] + lane
            order = np.argsort(own, kind="stable")
            at = _starts(own[order])
            first = order[at]
            lists = [_lists(at, b.column(c).flatten().take(pa.array(order))) for c in ("ids", "tf", "dl")]
            yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(row[first])), pa.array(np.diff(np.append(at, len(row)))), *lists, pa.array(blocks[row[first]]), pa.array(lane[first])], names=["term", "n", "ids", "tf", "dl", "blocks", "lane"])

    return rows.mapInArrow(run, f"term string, n long, ids array<{kind}>, tf array<int>, dl array<int>, blocks long, lane long")


def _cut(rows: DataFrame, kind: str, size: int, weighed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks (shelf, term, part, n, top, hits) of rows (shelf, term, lane, blocks, ids, keys, tf, dl) whose terms and lanes follow each other in a task.

    A term that is not in lanes is there as a whole, which tells its number of blocks. Only the last group of a batch is held for the next one.
    """

    def cut(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        group = group - group[0]
        row = np.repeat(np.arange(len(t)), pc.list_value_length(t["ids"]).to_numpy())
        ids, keys, tf, dl = (t[c].combine_chunks().flatten() for c in ("ids", "keys", "tf", "dl"))
        whole = -(-np.bincount(group[row]) // size)
        blocks = pc.fill_null(t["blocks"], 0).to_numpy()[_starts(group)]
        blocks = np.where(blocks > 0, blocks, whole)
        part = keys.to_numpy() % blocks[group[row]]
        block = (np.cumsum(blocks) - blocks)[group[row]] + part
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.argsort(block * len(ids) + place)
        at = _starts(block[order])
        first, weight = order[at], weighed(tf.to_numpy().astype(np.float64), dl.to_numpy())[order]
        hits = _lists(at, pa.StructArray.from_arrays([ids.take(pa.array(order)), pa.array(weight)], ["id", "weight"]))
        shelf, term = (t[c].combine_chunks().take(pa.array(row[first])) for c in ("shelf", "term"))
        return pa.RecordBatch.from_arrays([term, pa.array(part[first]), pa.array(np.diff(np.append(at, len(ids)))), pa.array(np.maximum.reduceat(weight, at)), hits, shelf], names=["term", "part", "n", "top", "hits", "shelf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                t = pa.concat_tables([pa.Table.from_batches([b]), *([held] if held else [])][::-1])
                new = [pc.not_equal(t[c].combine_chunks()[1:], t[c].combine_chunks()[:-1]).to_numpy(zero_copy_only=False) for c in ("term", "lane")]
                group = np.append(0, np.cumsum(new[0] | new[1]))
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield cut(t[:last], group[:last])
                held = t[last:]
        if held:
            yield cut(held, np.zeros(len(held), np.int64))

    return rows.mapInArrow(run, f"term string, part long, n long, top double, hits array<struct<id: {kind}, weight: double>>, shelf int")


def _stored_path(spark: SparkSession, source: str, options: dict) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in ([fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else fs.listStatus(at)))
    name = hashlib.sha256(repr((FORMAT, BLOCK, SHELVES, files, sorted(options.items()))).encode()).hexdigest()[:32]
    return f"{shared_folder(spark)}/postings-{name}"


def found_postings(spark: SparkSession, source: str, **options) -> Postings | None:
    """The index of a table of files as it is now, if stored_postings has built it; a search that comes alone need not wait for a build."""
    path = _stored_path(spark, source, options)
    return open_postings(spark, path) if exists(spark, f"{path}/blocks/_SUCCESS") else None


def stored_postings(spark: SparkSession, source: str, **options) -> Postings:
    """The index of a table of files, built when it is first asked for and again after a file of the table has changed: its path tells the files, their lengths and times.

    Threads of one driver that ask for it at once wait for one build.
    """
    path = _stored_path(spark, source, options)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    with _BUILDING:
        if exists(spark, f"{path}/blocks/_SUCCESS"):
            return open_postings(spark, path)
        # written beside it first: what another run has left half done is not taken for an index
        made = build_postings(spark.read.parquet(source), **options)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(made.path), spark._jvm.org.apache.hadoop.fs.Path(path)):
            return made
        return open_postings(spark, path)


def _shelf(term: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shelves)).cast("int").alias("shelf")


def _part(id_: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(id_), blocks)


def query_terms(queries: DataFrame, analyser: Callable[[Column], Column] = analysed) -> DataFrame:
    """(query_id, term, boost): a query's words, each once. The index and its queries need one analyser."""
    return queries.select("query_id", F.explode(F.array_distinct(analyser(F.col("text")))).alias("term"), F.lit(1.0).alias("boost"))


def known_terms(index: Postings, asked: DataFrame) -> DataFrame:
    """(query_id, shelf, term, df, blocks, idf, top) of asked (query_id, term, boost), for terms that the index has; top is a bound of what the term adds to a score.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), times the boost. Only the terms' shelves of the dictionary are read.
    """
    own = asked.withColumn("shelf", _shelf(F.col("term"), index.shelves))
    idf = F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("boost")
    return index.terms.join(F.broadcast(own), ["shelf", "term"]).select("query_id", "shelf", "term", "df", "blocks", idf.alias("idf"), (F.col("top") * idf).alias("top"))


def whole_scores(index: Postings, terms: DataFrame) -> DataFrame:
    """(query_id, id, score) over all postings of terms (query_id, shelf, term, idf), a bounded number of rows."""
    met = index.blocks.join(F.broadcast(terms.select("query_id", "shelf", "term", "idf")), ["shelf", "term"])
    return met.select("query_id", "idf", F.explode("hits").alias("h")).groupBy("query_id", F.col("h.id").alias("id")).agg(F.sum(F.col("idf") * F.col("h.weight")).alias("score"))


def whole_search(index: Postings, queries: DataFrame, k: int = 10, terms=query_terms) -> DataFrame:
    """(query_id, id, score, rank) like pruned_search, but every posting of a query's terms is scored, in one pass without rounds: less to wait for, more to read."""

    def block(some: DataFrame) -> DataFrame:
        return whole_scores(index, known_terms(index, some)).select("query_id", "id", F.round("score", 6).alias("score"))

    return top_k(in_blocks(terms(queries), block), k, "score", False, "id")


def pruned_scores(index: Postings, asked: DataFrame, k: int = 10, steps: int = 3) -> tuple[DataFrame, DataFrame]:
    """(scores, facts) for asked (query_id, term, boost) of a bounded number: the scores (query_id, id, score) of documents that can be among a query's k best, exact.

    1. The rarest terms' postings (a sixteenth of the query's) give partial scores; the k-th best of these is a lower limit of the k-th best score.
    2. Terms whose bounds together stay under the limit need not be looked through: no document that has only these can be among the best. The others' blocks are read
       whole, and raise the limit.
    3. What is left of the terms is looked up in `steps` steps, those with the largest bounds first: each candidate in the one block of a term where it
       must be. Before a step a candidate goes whose score, with the largest weights of its blocks and the bounds of later steps, stays under the limit.

    facts: (query_id, blocks, blocks_read, postings, postings_read); a block that several candidates share counts once a query. Candidates and partial scores
    are tables, never on the driver; only query terms and limits are broadcast.
    """
    every = Window.partitionBy("query_id")
    rarest = every.orderBy("df", "term")
    terms = known_terms(index, asked)
    terms = terms.withColumn("seed", (F.sum("df").over(rarest) <= F.sum("df").over(every) / 16) | (F.row_number().over(rarest) == 1))
    terms = written(terms, "terms")
    blocks, cold = index.blocks, F.lit(float("-inf"))
    read_whole = lambda some: whole_scores(index, some)

    def limit(scores: DataFrame) -> DataFrame:
        """(query_id, least): the k-th best score, where there are as many."""
        best = top_k(scores, k, "score", False, "id")
        return best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score") - _SLACK).alias("least"))

    first = limit(read_whole(terms.where("seed")))
    rising = every.orderBy("seed", "top", "term")
    judged = terms.join(F.broadcast(first), "query_id", "left").withColumn("below", ~F.col("seed") & (F.sum("top").over(rising) < F.coalesce("least", cold)))
    # seeds are read anyway, so they come last in the order and their bounds count for nothing else
    step = F.ntile(steps).over(Window.partitionBy("query_id", "below").orderBy(F.desc("top"), "term"))
    judged = written(judged.withColumn("step", F.when(F.col("below"), step).otherwise(0)), "judged")
    scores = written(read_whole(judged.where("step = 0")), "scores")
    looked = None
    for i in range(1, steps + 1):
        now = judged.where(F.col("step") == i).select("query_id", "shelf", "term", "blocks", "idf")
        later = judged.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("step") > i, F.col("top"))), F.lit(0.0)).alias("later"), F.coalesce(F.sum(F.when(F.col("step") >= i, F.col("top"))), F.lit(0.0)).alias("rest"))
        bar = F.broadcast(limit(scores).join(F.broadcast(later), "query_id", "right").select("query_id", F.coalesce("least", cold).alias("least"), "later", "rest"))
        able = scores.join(bar, "query_id").where(F.col("score") + F.col("rest") >= F.col("least"))
        places = able.join(F.broadcast(now), "query_id").withColumn("part", _part(F.col("id"), F.col("blocks")))
        tops = blocks.select("shelf", "term", "part", F.col("top").alias("most")).join(F.broadcast(now.select("shelf", "term").distinct()), ["shelf", "term"], "left_semi")
        bounded = places.join(tops, ["shelf", "term", "part"], "left").withColumn("could", F.sum(F.coalesce(F.col("most") * F.col("idf"), F.lit(0.0))).over(Window.partitionBy("query_id", "id")))
        kept = written(bounded.where(F.col("score") + F.col("could") + F.col("later") >= F.col("least")).where("most is not null").select("query_id", "id", "score", "shelf", "term", "part", "idf"), "kept")
        bodies = blocks.select("shelf", "term", "part", "n", "hits").join(F.broadcast(now.select("shelf", "term").distinct()), ["shelf", "term"], "left_semi")
        found = kept.join(bodies, ["shelf", "term", "part"]).select("query_id", "id", "shelf", "term", "part", "n", (F.col("idf") * F.coalesce(F.get(F.filter("hits", lambda h: h["id"] == F.col("id")), F.lit(0))["weight"], F.lit(0.0))).alias("more"))
        found = written(found, "found")
        own = found.groupBy("query_id", "term", "part").agg(F.max("n").alias("n")).groupBy("query_id").agg(F.count(F.lit(1)).alias("b"), F.sum("n").alias("p"))
        looked = own if looked is None else looked.unionByName(own)
        added = found.groupBy("query_id", "id").agg(F.sum("more").alias("more"))
        # whoever can have none of this step's terms goes on as well
        going = able.select("query_id", "id", "score", "least", "later").join(added, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), "least", "later")
        scores = written(going.where(F.col("score") + F.col("later") >= F.col("least")).select("query_id", "id", "score"), "scores")
    whole = judged.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("step") == 0, F.col("blocks")).otherwise(0)).alias("b"), F.sum("df").alias("postings"), F.sum(F.when(F.col("step") == 0, F.col("df")).otherwise(0)).alias("p"))
    read = whole.select("query_id", "b", "p").unionByName(looked).groupBy("query_id").agg(F.sum("b").alias("blocks_read"), F.sum("p").alias("postings_read"))
    return scores, whole.select("query_id", "blocks", "postings").join(read, "query_id").select("query_id", "blocks", "blocks_read", "postings", "postings_read")


def pruned_search(index: Postings, queries: DataFrame, k: int = 10, terms=query_terms) -> DataFrame:
    """(query_id, id, score, rank): the k best documents by BM25 for queries (query_id, text), equal to retrieve.bm25_search but for what is read. terms: see query_terms."""

    def block(some: DataFrame) -> DataFrame:
        scores, _ = pruned_scores(index, some, k)
        return scores.select("query_id", "id", F.round("score", 6).alias("score"))

    return top_k(in_blocks(written(terms(queries), "asked"), block), k, "score", False, "id")

"""The upload pipeline: status rows first, then parse, chunk, embed and index; and embedding with a cache, retries and other providers."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import parsed
from .chunk import chunked
from .index import keyword_index
from .ingest import embedded, embedded_or_failed, empty_reason, hashed, split_duplicates, validated
from .tables import written

# States of a document.
PROCESSING, SUCCESS, WARNING, FAILED, REJECTED = "processing", "success", "warning", "failed", "rejected"


def upload(files: DataFrame, existing: DataFrame | None, chunker: Callable, embed: Callable[[list[str]], list[list[float]]], scope: tuple[str, ...] = ("tenant_id", "owner_user_id"), basic: bool = False, most_mb: int = 50) -> dict[str, DataFrame]:
    """Tables that follow from files (doc_id, file_name, mime_type, content, scope columns): status, chunks, vectors and postings.

    Every file has a status row first (processing). A file that does not pass validation, or whose bytes a live document of its scope or an earlier
    file has, is rejected with its reason before anything is written. One that cannot be parsed, or of which a chunk gets no vector, is failed, with up to 500
    characters of why, and leaves no chunks; one without chunks is a warning with its reason (success in the basic variant). Files are parsed and texts embedded once:
    both are tables of the shared folder.
    """
    checked = split_duplicates(hashed(validated(files, most_mb), "content", None), existing, list(scope), "doc_id")
    reason = F.coalesce("reject_reason", F.when(F.col("duplicate"), "duplicate"))
    judged = checked.withColumn("message", reason).withColumn("status", F.when(reason.isNull(), PROCESSING).otherwise(REJECTED))
    started = written(judged.select("doc_id", "file_name", *scope, "content_hash", "status", "message"), "started")
    ready = files.join(started.where(F.col("status") == PROCESSING).select("doc_id"), "doc_id", "left_semi").select("doc_id", *scope, "file_name", "mime_type", "content")
    done, chunks = processed(ready, chunker, embed, list(scope), basic)
    status = started.join(done, "doc_id", "left").select("doc_id", "file_name", *scope, "content_hash", F.coalesce("done_status", "status").alias("status"), F.coalesce("done_message", "message").alias("message"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return {"started": started.select("doc_id", "status"), "status": status, "chunks": chunks.drop("embedding"), "vectors": chunks, "postings": keyword_index(chunks, "chunk_id", "content")}


def processed(ready: DataFrame, chunker: Callable, embed: Callable[[list[str]], list[list[float]]], scope: list[str], basic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, done_status, done_message, chunk_count) of accepted files, and the chunks with their vectors of those that succeeded; see upload."""
    texts = written(parsed(ready).select("doc_id", *scope, F.col("text_content").alias("text"), "sections", F.substring(F.col("metadata")["error"], 1, 500).alias("parse_error")), "texts")
    chunks = chunked(texts.where("parse_error is null"), chunker, sections_col="sections")
    vectors = written(embedded_or_failed(chunks, embed), "embedded")
    n = vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("embed_error"))
    rows = texts.join(n, "doc_id", "left").withColumn("error", F.coalesce("parse_error", "embed_error"))
    bad, none = F.col("error").isNotNull(), F.col("n").isNull() & F.lit(not basic)
    done = rows.select("doc_id", *scope, F.when(bad, FAILED).when(none, WARNING).otherwise(SUCCESS).alias("done_status"), F.when(bad, F.col("error")).when(none, F.substring(empty_reason(F.col("text")), 1, 500)).alias("done_message"), F.when(bad, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("chunk_count"))
    good = done.where(F.col("done_status") == SUCCESS).select("doc_id", *scope)
    return done.drop(*scope), vectors.drop("error").join(good, "doc_id")


def without_upload(tables: dict[str, DataFrame], doc_id, documents: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The stores without a document: first its vectors, then its postings, then its metadata's flag."""
    gone = tables["chunks"].where(F.col("doc_id") == F.lit(doc_id)).select(F.col("chunk_id").alias("id"))
    left = tables | {k: tables[k].where(F.col("doc_id") != F.lit(doc_id)) for k in ("chunks", "vectors")}
    left["postings"] = tables["postings"].join(gone, "id", "left_anti")
    return left, documents.withColumn("deleted_flag", F.when(F.col("doc_id") == F.lit(doc_id), 1).otherwise(F.col("deleted_flag")))


def embedded_by_cache(rows: DataFrame, cache: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]], text_col: str = "content", size: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with embedding, the cache after it, (asked, hits, rate)): only texts that the cache does not have for this model are embedded.

    cache: (key, embedding), key is embedding:<model>:<hash of the text>. Every row counts as asked; equal texts of one call are all misses.
    """
    keyed = rows.withColumn("key", F.concat(F.lit(f"embedding:{model}:"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    known = keyed.join(cache.withColumnRenamed("embedding", "_have"), "key", "left")
    missing = known.where("_have is null").select("key", F.col(text_col).alias("content")).dropDuplicates(["key"])
    new = embedded(missing, embed, "content", size).select("key", "embedding")
    out = known.join(new, "key", "left").withColumn("embedding", F.coalesce("_have", "embedding")).drop("_have")
    stats = known.agg(F.count(F.lit(1)).alias("asked"), F.count("_have").alias("hits")).withColumn("rate", F.when(F.col("asked") > 0, F.round(F.col("hits") / F.col("asked"), 6)).otherwise(0.0))
    return out.select(*rows.columns, "embedding"), cache.unionByName(new), stats


class EmbeddingError(Exception):
    """A provider's failure: its HTTP status and reply."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"{status}: {body}"[:500])
        self.status, self.body = status, body

    @property
    def kind(self) -> str:
        if self.status == 429:
            return "QUOTA" if "quota" in self.body.lower() else "RATE_LIMITED"
        if self.status in (401, 403):
            return "AUTH"
        return "PROVIDER" if self.status >= 500 else "UNKNOWN"


class Providers:
    """Embedding by the first of several providers that answers: retries with growing delays, then the next one of equal dimension.

    A switch is kept for the calls that follow; recovered() asks the first provider again. A provider is (name, dimension, embed, slice): slice is
    the most texts of a request, None for one request whatever their number.
    """

    RETRYABLE = ("RATE_LIMITED", "PROVIDER")

    def __init__(self, providers: Sequence[tuple[str, int, Callable, int | None]], tries: int = 3, delay: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.tries, self.delay, self.factor, self.sleep, self.current = list(providers), tries, delay, factor, sleep, 0

    def _ask(self, provider, texts: list[str]) -> list[list[float]]:
        _, _, embed, most = provider
        out: list[list[float]] = []
        for i in range(0, len(texts), most or max(1, len(texts))):
            got = embed(texts[i : i + (most or len(texts))])
            # a reply may come in any order, with the index of each text
            out += [v for _, v in sorted(got)] if got and isinstance(got[0], tuple) else list(got)
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        dimension, last = self.providers[self.current][1], None
        order = [self.current, *(i for i in range(len(self.providers)) if i != self.current)]
        for i in order:
            if self.providers[i][1] != dimension:
                continue
            wait = self.delay
            for attempt in range(self.tries):
                try:
                    out = self._ask(self.providers[i], texts)
                except EmbeddingError as e:
                    last = e
                    if e.kind not in self.RETRYABLE:
                        break
                    if attempt + 1 < self.tries:
                        self.sleep(wait)
                        wait *= self.factor
                    continue
                self.current = i
                return out
        raise last or EmbeddingError(0, "no provider")

    def recovered(self, probe: str = "probe") -> bool:
        """Whether the first provider answers again; it is used from then on."""
        try:
            self._ask(self.providers[0], [probe])
        except EmbeddingError:
            return False
        self.current = 0
        return True


def images(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "gif", "webp")) -> DataFrame:
    """(path, name, length, modified) of the images of a folder, from its listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(F.lower(F.regexp_extract(F.col("path"), r"\.([^./]*)$", 1)).isin(*extensions))
    return kept.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"))


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A table of the console's database; with a numeric column and its bounds it is read by `parts` connections, and filters are pushed to it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


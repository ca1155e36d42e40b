"""Structured Streaming ingestion: files of documents as they come, hashed, deduplicated, chunked and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunked, semantic
from ..operators.ingest import hashed


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_ingest(stream: DataFrame, store: str, checkpoint: str, chunker: Callable = semantic, id_col: str = "doc_id", once: bool = True) -> StreamingQuery:
    """Appends each batch's new contents to store/documents and their chunks to store/chunks.

    A content hash that the store already has is rejected; of equal contents in a batch the smallest id stays. A batch that is
    run again after a failure writes to its own folder anew, so its rows are there once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = hashed(batch).withColumn("batch", F.lit(epoch))
        first = fresh.groupBy("content_hash").agg(F.min(id_col).alias(id_col))
        fresh = fresh.join(first, ["content_hash", id_col], "left_semi").dropDuplicates(["content_hash"])
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/documents")
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            known = spark.read.parquet(f"{store}/documents").where(F.col("batch") < epoch).select("content_hash").distinct()
            fresh = fresh.join(known, "content_hash", "left_anti")
        fresh.drop("batch").write.mode("overwrite").parquet(f"{store}/documents/batch={epoch}")
        stored = spark.read.parquet(f"{store}/documents/batch={epoch}")
        chunked(stored, chunker_of(chunker), id_col=id_col).write.mode("overwrite").parquet(f"{store}/chunks/batch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def chunker_of(chunker: Callable) -> Callable:
    return lambda text, sections, name: chunker(text, sections, name)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of a time window and key; a window begins every `slide`, else where the one before ends. In a stream rows that come over `late` after the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")

"""Uploads as a stream with state: one live copy of a content in a scope, and a status of each document that moves from processing to its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import validated
from ..operators.tables import exists
from ..operators.upload import PROCESSING, REJECTED, processed

STATUS = "doc_id long, file_name string, status string, message string, chunk_count long, step int"


def accepted(files: DataFrame, scope: list[str], ttl_days: int | None = None, most_mb: int = 50) -> DataFrame:
    """The stream files (doc_id, file_name, mime_type, content, scope) with content_hash, status and message: what passes validation and is the first of its content in its
    scope is processing, all else is rejected, without its content.

    State is kept for each scope and hash: the id that was accepted. Of rows of one content in a micro-batch the smallest id is the first; a task holds one row of a content at a time,
    however many there are. With ttl_days the state goes when its content has not come for so long, and the content is accepted again.
    """
    checked = validated(files, most_mb).withColumn("content_hash", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    for s in scope:
        checked = checked.withColumn(s, F.coalesce(F.col(s).cast("string"), F.lit("")))
    # what does not pass validation is no copy of anything: such rows have a key of their own
    checked = checked.withColumn("copy_key", F.when(F.col("reject_reason").isNull(), F.col("content_hash")).otherwise(F.concat(F.lit("rejected:"), F.col("doc_id").cast("string"))))
    columns = ["doc_id", "file_name", "mime_type", "content", "content_hash", *scope, "reject_reason"]
    out = columns[:-1] + ["status", "message"]

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, best = (state.get[0] if state.exists else None), None

        def rejected(row: dict, why: str) -> dict:
            return row | {"content": None, "status": REJECTED, "message": why}

        for pdf in batches:
            told = []
            for row in pdf[columns].to_dict("records"):
                if row["reject_reason"] is not None:
                    told.append(rejected(row, row["reject_reason"]))
                elif first is not None:
                    told.append(rejected(row, "duplicate"))
                elif best is None or row["doc_id"] < best["doc_id"]:
                    told += [rejected(best, "duplicate")] if best is not None else []
                    best = row
                else:
                    told.append(rejected(row, "duplicate"))
            if told:
                yield pd.DataFrame(told)[out]
        if best is not None:
            first = best["doc_id"]
            yield pd.DataFrame([best | {"status": PROCESSING, "message": None}])[out]
        if first is not None:
            state.update((int(first),))
            if ttl_days is not None:
                state.setTimeoutDuration(ttl_days * 86_400_000)

    kinds = dict(checked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out[:-2]) + ", status string, message string"
    wait = GroupStateTimeout.NoTimeout if ttl_days is None else GroupStateTimeout.ProcessingTimeTimeout
    return checked.groupBy(*scope, "copy_key").applyInPandasWithState(judge, schema, "first long", "append", wait)


def start_uploads(stream: DataFrame, store: str, checkpoint: str, chunker: Callable, embed: Callable[[list[str]], list[list[float]]], scope: tuple[str, ...] = ("tenant_id", "owner_user_id"), ttl_days: int | None = None, once: bool = True) -> StreamingQuery:
    """Takes files of a stream to store/status and store/chunks.

    Each micro-batch writes the first status of all its rows (step 0), then the chunks with their vectors, then the last status of what was accepted (step 1), each to a folder of its
    own that a run after a failure writes anew. State and offsets are those of the micro-batch, so the same rows are accepted again: there is one copy, and a document that was left
    in processing gets its end.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        at = lambda table: f"{store}/{table}/batch={epoch}"
        batch.select("doc_id", *scope, "content_hash", "file_name", "mime_type", "status", "message", "content").write.mode("overwrite").parquet(at("received"))
        rows = batch.sparkSession.read.parquet(at("received"))
        rows.select("doc_id", "file_name", "status", "message", F.lit(0).cast("long").alias("chunk_count")).write.mode("overwrite").parquet(f"{at('status')}/step=0")
        ready = rows.where(F.col("status") == PROCESSING).select("doc_id", *scope, "file_name", "mime_type", "content")
        done, chunks = processed(ready, chunker, embed, list(scope))
        chunks.write.mode("overwrite").parquet(at("chunks"))
        ended = done.join(ready.select("doc_id", "file_name"), "doc_id")
        ended.select("doc_id", "file_name", F.col("done_status").alias("status"), F.col("done_message").alias("message"), "chunk_count").write.mode("overwrite").parquet(f"{at('status')}/step=1")

    writer = accepted(stream, list(scope), ttl_days).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_status(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, file_name, status, message, chunk_count): each document's last status, to be polled; no rows before the first micro-batch."""
    if not exists(spark, f"{store}/status"):
        return spark.createDataFrame([], STATUS).drop("step")
    rows = spark.read.schema(f"{STATUS}, batch long").parquet(f"{store}/status")
    last = F.max_by(F.struct("file_name", "status", "message", "chunk_count"), F.struct("batch", "step"))
    return rows.groupBy("doc_id").agg(last.alias("r")).select("doc_id", "r.*")

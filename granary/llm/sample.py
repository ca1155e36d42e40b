"""A bounded sample of labelled documents, and what is held out of it."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that nothing is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int = 100_000) -> DataFrame:
    """(doc_id, y, text) of at most `most` labelled documents that are not held out, of at most `longest` characters each.

    The bounds are parameters: the ids with the smallest hashes are taken, so reruns agree and
    the sample does not depend on how the tables are dealt out. Rows without id, label or text, and longer texts, are
    left out of what is learnt from; of several labels of one id the largest counts, of several texts the smallest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").where(F.length("text") <= longest)
    # at most `most` rows: their size is proven
    found = text.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("doc_id", "y", "text")


def fitted(rows: DataFrame, fit: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray] | None:
    """The arrays that fit makes of all rows by doc_id; None without rows.

    The rows are a bounded sample. They are learnt from in one task of an executor, which Spark runs again if it is lost; the driver gets the model only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            out = io.BytesIO()
            np.savez(out, **fit(pa.Table.from_batches(own)))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(lean(run), "model binary").collect()
    if not found:
        return None
    with np.load(io.BytesIO(bytes(found[0].model))) as z:
        return {k: z[k] for k in z.files}

"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpoints, delete, read, shared_folder
from granary.llm.contamination import without_contaminated
from granary.llm.linedup import without_repeats
from granary.llm.mixing import mix
from granary.llm.ngram_join import one_of_each
from granary.llm.quality_fm import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines, and documents of which nothing is left."""
    return without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: five words, similarity 0.8."""
    return one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document with the number of its copies in the mix, those with none left out.

    The number is the column copies; a column of documents with that name is replaced, and one that mix adds (see there) too.
    """
    mixed = mix(docs).where("mix_copies > 0")
    return mixed.select(*[c for c in docs.columns if c != "copies"], F.col("mix_copies").alias("copies"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing to target weights", mixing)]

#: SQL cannot express the learnt stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written and read again.

    What a stage has read and its checkpoints are deleted when its own result is written; the last result stays.
    """
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path, before = f"{base}/{i}", checkpoints(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete(spark, [*(checkpoints(spark) - before), *([f"{base}/{i - 1}"] if i else [])])
    return docs

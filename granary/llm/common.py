"""What the operators share: words, stable hashes, checkpoints and batch helpers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names in spark.checkpoint.dir.

    Where that is unset and driver and executors are one process (local mode) a temporary folder is made and set; on a
    cluster without it this is an error, as no folder of one machine would do.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.getConf().get("spark.checkpoint.dir")
        if own is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="granary-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoints(spark: SparkSession) -> set[str]:
    """The checkpoints that this application has written and not deleted."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        return set()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().toString() for f in fs.listStatus(path)} if fs.exists(path) else set()


def delete(spark: SparkSession, paths) -> None:
    """Deletes folders of the shared folder that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def beside(df: DataFrame, small: int = 100_000) -> DataFrame:
    """df, marked for a broadcast if it has at most `small` rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(small + 1).count() <= small else df


def join_unique(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner", small: int = 100_000, share: int = 1000, least: int = 10_000) -> DataFrame:
    """rows joined to keyed, which has one row a key, whatever share of rows one key holds.

    A small table is broadcast. Else keys with a `share`-th of all rows (`least` rows at any rate) are told apart: they are at most `share`
    keys, so their part of keyed is broadcast, and only keys with fewer rows meet in a shuffle. No row is lost. rows is read several times.
    """
    if keyed.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(keyed), on, how)
    total = rows.count()
    hot = cut(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(least, total // share)).select(*on))
    if hot.isEmpty():
        return rows.join(keyed, on, how)
    few = F.broadcast(hot)
    apart = rows.join(few, on, "left_semi").join(F.broadcast(keyed.join(few, on, "left_semi")), on, how)
    return rows.join(few, on, "left_anti").join(keyed, on, how).unionByName(apart)


def let(value: Column, f) -> Column:
    """f of a value that is worked out once: the only element of an array that a lambda names."""
    return F.element_at(F.transform(F.array(value), f), 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text, null as empty, by Spark's own functions."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words of a text, null as empty: starts of words are counted, nothing is built."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on key and seed only, alike in any SQL engine that has md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 texts of an Arrow string column, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


class Codes(dict):
    """Word to 64-bit code. Emptied when full, so its memory is bounded."""

    def __init__(self, full: int = 400_000):
        super().__init__()
        self.full = full

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.full:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=_U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads each bit over all 64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(texts: list[bytes], most: int = 8_000_000, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes and at most `rows` texts each, so that a batch of long texts stays small in memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if (size and size + len(t) > most) or i - start >= rows:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def lean(run):
    """run, a function for mapInArrow, that gives the memory it has freed back to the system when a task ends; workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def components(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """(node, component) of the graph of edges (a, b): component is the smallest node that links reach.

    Every round hooks each root to the smallest neighbouring label and then halves the paths, so
    paths of any length take a logarithmic number of rounds; the state is a table, never on the driver.
    At most `few` edges are one partition, so that rounds over a small graph are not dealt to hundreds of tasks each; more are shuffled.
    """
    both = cut(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    if both.count() <= few:
        both = both.coalesce(1)
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        to = label.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        near = both.join(to, "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("near"))
        seen = label.join(near, "node").select("node", "component", F.least("component", "near").alias("best"))
        # what a node has seen also moves the node that it points to
        hook = seen.groupBy(F.col("component").alias("node")).agg(F.min("best").alias("hook"))
        moved = seen.join(hook, "node", "left").select("node", "component", F.least("best", F.coalesce("hook", "best")).alias("best"))
        jump = moved.select(F.col("node").alias("best"), F.col("best").alias("far"))
        new = cut(moved.join(jump, "best", "left").select("node", F.col("component").alias("old"), F.least("best", F.coalesce("far", "best")).alias("component")))
        done = new.where("old <> component").isEmpty()
        label = new.select("node", "component")
        if done:
            return label

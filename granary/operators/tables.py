"""Tables of the shared folder: results that are worked out once and read several times, by executors that may be lost."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in spark.checkpoint.dir. In local mode a temporary one does where it is unset; a cluster needs it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.getConf().get("spark.checkpoint.dir")
        if own is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="granary-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """df as a table of the shared folder: computed once, read from files ever after, so that no lineage is left."""
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not by else df.sparkSession.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner", hot: int = 10_000, most: int = 1000) -> DataFrame:
    """rows joined to keyed, which has one row a key and tells in `count` how many rows have that key.

    Keys with at least `hot` rows (the `most` most frequent ones at most, whatever the size) are broadcast, so that such a key's rows stay where they are; the other
    keys, none of which has many rows, meet in a shuffle. No row is lost.
    """
    top = keyed.where(F.col(count) >= hot).orderBy(F.desc(count), *on).limit(most)
    few = F.broadcast(written(top.select(*on), "hot"))
    apart = rows.join(few, on, "left_semi").join(F.broadcast(keyed.join(few, on, "left_semi")), on, how)
    return rows.join(few, on, "left_anti").join(keyed.join(few, on, "left_anti"), on, how).unionByName(apart)

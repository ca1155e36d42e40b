"""A stored vector collection: rows of a declared dimension in partitions by cell, appended by Spark's own committer, deleted by rewriting the touched cells only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import exists, new_path, removed, written

#: Columns of a row beside its scope: the metric is told to searches, rows do not have it.
COLUMNS = "id string, document_id long, content string, embedding array<float>, metadata map<string, string>"


@dataclass(frozen=True)
class Collection:
    """A collection's declaration, stored beside its rows: the vectors' dimension, the metric that searches use, the scope columns and the number of cells."""

    path: str
    dimension: int
    metric: str = "l2"
    scope: tuple[str, ...] = ("tenant_id", "owner_user_id")
    cells: int = 64

    @property
    def schema(self) -> str:
        return ", ".join([COLUMNS, *[f"{s} string" for s in self.scope], "cell int"])


def created(spark: SparkSession, collection: Collection) -> Collection:
    """Stores the declaration. A collection that is there already must have the same one."""
    if exists(spark, f"{collection.path}/declaration"):
        if opened(spark, collection.path) != collection:
            raise ValueError(f"{collection.path} is declared otherwise")
        return collection
    spark.createDataFrame([(json.dumps(asdict(collection)),)], "declaration string").coalesce(1).write.text(f"{collection.path}/declaration")
    return collection


def opened(spark: SparkSession, path: str) -> Collection:
    told = json.loads(spark.read.text(f"{path}/declaration").first().value)
    return Collection(**told | {"path": path, "scope": tuple(told["scope"])})


def rows_of(spark: SparkSession, collection: Collection) -> DataFrame:
    """The live rows; none before the first insert. Folders that a failed write has left are not read."""
    at = f"{collection.path}/rows"
    return spark.read.schema(collection.schema).parquet(at) if exists(spark, at) else spark.createDataFrame([], collection.schema)


def _cell(collection: Collection):
    """Rows of one document lie in few cells, those of a very large one in several."""
    spread = F.pmod(F.xxhash64("id"), F.lit(4))
    return F.pmod(F.xxhash64("document_id", spread), F.lit(collection.cells)).cast("int")


def inserted(rows: DataFrame, collection: Collection) -> None:
    """Appends rows (id, document_id, content, embedding, metadata, scope). A row without an id or with a vector of another dimension fails its task, and then nothing is written:
    a job's files become visible together when all its tasks are done."""
    fault = F.when(F.col("id").isNull(), F.lit("a row without an id")).when(F.coalesce(F.size("embedding"), F.lit(-1)) != collection.dimension, F.concat(F.lit("a vector whose dimension is not declared: "), F.col("id")))
    checked = rows.withColumn("id", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("id").cast("string")))
    names = [c.strip().split(" ")[0] for c in collection.schema.replace("map<string, string>", "map").split(",")]
    checked.withColumn("cell", _cell(collection)).select(*names).write.mode("append").partitionBy("cell").parquet(f"{collection.path}/rows")


def deleted(spark: SparkSession, collection: Collection, hit, within=None) -> list[int]:
    """Drops the rows for which hit holds; the cells that were written anew or are gone. within narrows the cells that are looked at.

    Only cells that have such a row are rewritten: what is left of them goes to a staged table first, then takes the place of the cells together (dynamic overwrite);
    a cell of which nothing is left goes as a folder. After a failure between these two steps another call ends the work.
    """
    rows = rows_of(spark, collection)
    hit = F.coalesce(hit, F.lit(False))
    near = rows if within is None else rows.where(within)
    touched = sorted(r.cell for r in near.where(hit).select("cell").distinct().collect())
    if not touched:
        return []
    _replaced(spark, collection, touched, rows.where(F.col("cell").isin(touched)).where(~hit))
    return touched


def _replaced(spark: SparkSession, collection: Collection, cells: list[int], kept: DataFrame) -> None:
    """Puts kept in the place of the cells: a staged table first, then all of them together; a cell without rows goes as a folder."""
    staged = new_path(spark, "kept")
    kept.write.parquet(staged)
    rows = spark.read.schema(collection.schema).parquet(staged)
    left = {r.cell for r in rows.select("cell").distinct().collect()}
    if left:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{collection.path}/rows")
    for cell in cells:
        if cell not in left:
            removed(spark, f"{collection.path}/rows/cell={cell}")
    removed(spark, staged)


def document_deleted(spark: SparkSession, collection: Collection, document_id: int, **scope: str) -> list[int]:
    """Drops a document's rows in a scope; looks at the document's own cells only."""
    hit = F.col("document_id") == F.lit(document_id)
    for name, value in scope.items():
        hit = hit & (F.col(name) == F.lit(value))
    own = spark.range(4).select(F.pmod(F.xxhash64(F.lit(document_id).cast("long"), "id"), F.lit(collection.cells)).cast("int").alias("cell")).distinct().collect()
    return deleted(spark, collection, hit, F.col("cell").isin([r.cell for r in own]))


def upserted(rows: DataFrame, collection: Collection) -> list[int]:
    """Appends rows and drops earlier ones of the same id and document; of equal ids in rows one should stand."""
    spark = rows.sparkSession
    old = rows_of(spark, collection).select("id", "document_id", "cell")
    same = old.join(rows.select(F.col("id").cast("string").alias("id"), "document_id").distinct(), ["id", "document_id"], "left_semi")
    known = written(same, "replaced")
    touched = sorted(r.cell for r in known.select("cell").distinct().collect())
    if touched:
        _replaced(spark, collection, touched, rows_of(spark, collection).where(F.col("cell").isin(touched)).join(known.select("id", "document_id"), ["id", "document_id"], "left_anti"))
    inserted(rows, collection)
    return touched


def cleared(spark: SparkSession, collection: Collection) -> None:
    removed(spark, f"{collection.path}/rows")

"""Exact joins of vectors by similarity without comparing all pairs: cells around pivots, slabs of distance, tiles of large groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import vectors_of
from .tables import written

#: Most pivots, rows of a side that one comparison takes, and large groups that are told apart.
PIVOTS, TILE, LARGE = 1024, 2048, 100_000
#: Places that a row may have on average before fewer pivots are taken; rows that are placed at once, and rows or pairs that leave a task at once.
COPIES, ROWS, BATCH = 16, 256, 16_384
#: What rounding may add to a distance.
_SLACK = 1e-6


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0))


def _placed(rows: DataFrame, pivots: np.ndarray, reach: float, radius: np.ndarray | None, keys: list[str], counted: bool = False) -> DataFrame:
    """rows (id, v, keys) with their places (cell, slab): the nearest pivot's and the slab of the distance to it, if radius is None.

    Else every place where a row of another side within reach may be: cells whose border (the plane half way to the own pivot) is within reach and whose outermost row
    is not farther; in each, the slabs that the distance to the pivot and the reach allow.
    """
    width = max(reach, 1e-3)
    between = np.maximum(_distances(pivots, pivots), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                d = _distances(_directions(vectors_of(b.column("v"))), pivots)
                own = d.argmin(1)
                if radius is None:
                    at, cell = np.arange(len(d)), own
                    slab = np.floor(d[at, cell] / width).astype(np.int64)
                else:
                    nearest = d[np.arange(len(d)), own]
                    border = (d * d - (nearest * nearest)[:, None]) / (2 * between[own])
                    border[np.arange(len(d)), own] = 0
                    at, cell = np.nonzero((border <= reach + _SLACK) & (d <= radius[None] + reach + _SLACK))
                    low = np.floor(np.maximum(d[at, cell] - reach - _SLACK, 0) / width).astype(np.int64)
                    high = np.floor((d[at, cell] + reach + _SLACK) / width).astype(np.int64)
                    again = high - low + 1
                    if counted:
                        yield pa.RecordBatch.from_arrays([pa.array([int(again.sum())], pa.int64())], names=["n"])
                        continue
                    slab = np.repeat(low, again) + np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                    at, cell = np.repeat(at, again), np.repeat(cell, again)
                far = d[at, cell]
                for i in range(0, len(at), BATCH):
                    part = slice(i, i + BATCH)
                    yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(at[part])) for c in ("id", "v", *keys)] + [pa.array(cell[part].astype(np.int32)), pa.array(slab[part].astype(np.int32)), pa.array(far[part])], names=["id", "v", *keys, "cell", "slab", "far"])

    kinds = dict(rows.dtypes)
    types = "n long" if counted else ", ".join(f"`{c}` {kinds[c]}" for c in ("id", "v", *keys)) + ", cell int, slab int, far double"
    return rows.select("id", "v", *keys).mapInArrow(run, types)


def near_join(left: DataFrame, right: DataFrame, keys: list[str], similar: float, itself: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, compared): (left_id, right_id, sim) of rows (id, v, keys) with equal keys whose cosine is over `similar`, and (n): how many pairs were compared.

    Unit vectors over `similar` are within r = sqrt(2 - 2 * similar). Every right row lies in the cell of its nearest pivot, in a slab of width r of its distance to it; a left row goes
    to each cell and slab in which a row within r can lie (triangle inequality), so each pair meets once. Groups over TILE rows a side are dealt into tiles, which
    meet tile by tile; a task holds two tiles and compares at most TILE by TILE rows at once, and its pairs leave it as they are found. Pivots are at most PIVOTS right rows, drawn by
    a hash of their ids. Where the reach is so wide that a left row would have over COPIES places on average, every eighth pivot is taken, and so on down to one: then tiles do the work.

    itself: left and right are one table; of two rows the one with the smaller id is left. Rows with a null key, vector or no direction have no pairs.
    """
    spark, reach = right.sparkSession, math.sqrt(max(0.0, 2 - 2 * similar))
    fit = F.exists("v", lambda x: x != 0)
    for k in keys:
        fit = fit & F.col(k).isNotNull()
    left, right = left.where(fit), right.where(fit)
    n = right.count()
    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    if n == 0:
        none = spark.createDataFrame([], f"left_id {kinds[0]}, right_id {kinds[1]}, sim double")
        return none, spark.range(1).select(F.lit(0).cast("long").alias("n"))
    chosen = right.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, 2 * math.isqrt(n - 1) + 1)).select("v").toArrow()
    pivots = np.unique(_directions(vectors_of(chosen["v"])), axis=0)
    asked = left.count()
    while True:
        homes = written(_placed(right, pivots, reach, None, keys), "homes")
        radius = np.full(len(pivots), -np.inf)
        for r in homes.groupBy("cell").agg(F.max("far").alias("far")).collect():
            radius[r.cell] = r.far
        if len(pivots) == 1 or (_placed(left, pivots, reach, radius, keys, counted=True).agg(F.sum("n")).first()[0] or 0) <= COPIES * asked:
            break
        pivots = pivots[::8]
    visits = written(_placed(left, pivots, reach, radius, keys), "visits")
    place = [*keys, "cell", "slab"]
    sides = homes.withColumn("home", F.lit(True)).unionByName(visits.withColumn("home", F.lit(False))) if kinds[0] == kinds[1] else None
    if sides is None:
        raise ValueError("ids of both sides must have one type")
    counted = sides.groupBy(*place).agg(F.count_if("home").alias("_h"), F.count_if(~F.col("home")).alias("_v"))
    tile = max(4 * TILE, -(-2 * (homes.count() + visits.count()) // LARGE))
    large = F.broadcast(written(counted.where((F.col("_h") > tile) | (F.col("_v") > tile)), "large"))
    parts = lambda c: F.coalesce(F.ceil(F.col(c) / tile), F.lit(1)).cast("int")
    dealt = sides.join(large, place, "left").withColumns({"_h": F.greatest(parts("_h"), F.lit(1)), "_v": F.greatest(parts("_v"), F.lit(1))})
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("_h")).otherwise(F.col("_v"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("_v")).otherwise(F.col("_h")) - 1))
    tiled = dealt.select("id", "v", "home", *place, own.alias("_own"), other.alias("_other"))
    tiled = tiled.select("id", "v", "home", *place, F.when(F.col("home"), F.col("_own")).otherwise(F.col("_other")).alias("_a"), F.when(F.col("home"), F.col("_other")).otherwise(F.col("_own")).alias("_b"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        home = t["home"].to_numpy()
        x, y = t.filter(pa.array(~home)), t.filter(pa.array(home))
        a, b = x["id"].combine_chunks(), y["id"].combine_chunks()
        if x.num_rows and y.num_rows:
            u, w = vectors_of(x["v"]), vectors_of(y["v"])
            nu, nw = np.sqrt((u * u).sum(1)), np.sqrt((w * w).sum(1))
            for i in range(0, len(u), TILE):
                for j in range(0, len(w), TILE):
                    at, row = np.nonzero((u[i : i + TILE] @ w[j : j + TILE].T) > (similar - _SLACK) * nu[i : i + TILE, None] * nw[None, j : j + TILE])
                    for k in range(0, len(at), BATCH):
                        p, q = at[k : k + BATCH] + i, row[k : k + BATCH] + j
                        sims = (u[p] * w[q]).sum(1) / (nu[p] * nw[q])
                        out = pa.table({"left_id": a.take(pa.array(p)), "right_id": b.take(pa.array(q)), "sim": pa.array(sims), "compared": pa.array(np.zeros(len(p), np.int64))})
                        out = out.filter(pa.array(sims > similar))
                        yield from (out.filter(pc.less(out["left_id"], out["right_id"])) if itself else out).combine_chunks().to_batches()
        # the last row of a group tells how much it has compared
        note = {"left_id": pa.nulls(1, a.type), "right_id": pa.nulls(1, b.type), "sim": pa.nulls(1, pa.float64()), "compared": pa.array([x.num_rows * y.num_rows], pa.int64())}
        yield pa.RecordBatch.from_pydict(note)

    found = written(tiled.groupBy(*place, "_a", "_b").applyInArrow(met, f"left_id {kinds[0]}, right_id {kinds[1]}, sim double, compared long"), "pairs")
    return found.where("sim is not null").select("left_id", "right_id", "sim"), found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("n"))


def classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, representative): rows (id, v, keys) with equal keys and components have the smallest of their ids as representative."""
    digest = F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",", "null").cast("binary"), 256)
    named = rows.select("id", *keys, digest.alias("_d"))
    first = named.groupBy(*keys, "_d").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("_n"))
    # only rows with equals are joined, and each class once: rows meet by a part of their own id, to which the class is copied
    many = first.where("_n > 1").withColumn("_s", F.explode(F.sequence(F.lit(0), F.least(F.ceil(F.col("_n") / TILE), F.lit(LARGE)).cast("int") - 1))).withColumn("_m", F.least(F.ceil(F.col("_n") / TILE), F.lit(LARGE)).cast("int"))
    sizes = F.broadcast(written(many.where("_m > 1").select(*keys, "_d", "_m").distinct().orderBy(F.desc("_m")).limit(LARGE), "sizes"))
    dealt = named.join(sizes, [*keys, "_d"], "left").withColumn("_s", F.pmod(F.xxhash64("id"), F.coalesce("_m", F.lit(1))).cast("int")).drop("_m")
    return dealt.join(many.select(*keys, "_d", "_s", "representative"), [*keys, "_d", "_s"], "left").select("id", F.coalesce("representative", "id").alias("representative"))

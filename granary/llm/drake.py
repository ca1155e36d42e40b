"""Centroid clustering of integer vectors with Drake's adaptive bounds: exact assignments, most of them without a distance."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, shared_folder

#: Components are below this in magnitude, so that a squared distance of up to 64 of them fits a long.
LARGEST = 1 << 27
#: Squared distances are exact in doubles if no component of a batch and of the centroids is above it (for 64 components).
_EXACT = 1 << 22
#: What rounding may take from a bound: each bound is wider by this share.
_SLACK = 1e-9


def fixed_point(vectors: DataFrame, width: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with exactly `width` components, none null or non-finite, each component x as the integer floor(scale * x).

    A row with a component of 2^27 or more after scaling is left out as well: its distances would not fit a long.
    """
    v = F.col(vec_col)
    fit = (F.size(v) == width) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(LARGEST)), F.lit(False)))
    # the floor is taken of rows that fit only: others may not be numbers
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fit, F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))).alias("v")).where("v is not null")


def seeds(vectors: DataFrame, clusters: int, salt: str = "1:") -> np.ndarray:
    """The vectors whose ids have the smallest SHA-256 (hex of salt and id), in that order: at most `clusters` rows, all that the driver gets.

    Repeated ids stand in the order of their vectors; rows without an id come last.
    """
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select("v", name.alias("name")).orderBy(F.asc_nulls_last("name"), "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c, as integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT and x.shape[1] <= 64:
        y, d = x.astype(np.float64), c.astype(np.float64)
        return ((y * y).sum(1)[:, None] - 2 * (y @ d.T) + (d * d).sum(1)[None]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


class Bounds:
    """What is known of a batch of vectors: its cluster, an upper bound of the distance to it, the nearest other centroids with a lower bound each, and one
    lower bound for all the rest. Bounds are of plain, not squared, distances."""

    FIELDS = pa.schema([("cluster", pa.int32()), ("upper", pa.float64()), ("near", pa.list_(pa.int32())), ("lower", pa.list_(pa.float64())), ("rest", pa.float64()), ("looked", pa.int64())])

    def __init__(self, cluster, upper, near, lower, rest, looked):
        self.cluster, self.upper, self.near, self.lower, self.rest, self.looked = cluster, upper, near, lower, rest, looked

    @classmethod
    def scanned(cls, d2: np.ndarray, width: int, looked: np.ndarray) -> Bounds:
        """From exact squared distances to all centroids; of equally near ones the smaller number stands first."""
        order = np.argsort(d2, axis=1, kind="stable")
        distance = np.sqrt(np.take_along_axis(d2, order, 1).astype(np.float64))
        low = distance * (1 - _SLACK)
        rest = low[:, width + 1] if low.shape[1] > width + 1 else np.full(len(low), np.inf)
        return cls(order[:, 0].astype(np.int32), distance[:, 0] * (1 + _SLACK), order[:, 1 : width + 1].astype(np.int32), low[:, 1 : width + 1], rest, looked + d2.shape[1])

    def narrowed(self, width: int) -> Bounds:
        """With only the `width` smallest listed bounds; the others go into the remainder's."""
        if self.near.shape[1] > width:
            order = np.argsort(self.lower, axis=1, kind="stable")
            self.near, self.lower = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.lower, order, 1)
            self.rest = np.minimum(self.rest, self.lower[:, width])
            self.near, self.lower = self.near[:, :width], self.lower[:, :width]
        return self

    def moved(self, drift: np.ndarray) -> Bounds:
        """After centroids have moved by drift: bounds give way by as much."""
        drift = drift * (1 + _SLACK)
        self.upper = self.upper + drift[self.cluster]
        self.lower = self.lower - drift[self.near]
        self.rest = self.rest - drift.max(initial=0)
        return self

    def assigned(self, x: np.ndarray, c: np.ndarray) -> int:
        """Settles every row exactly; the number of listed centroids that any row still needed.

        A row whose upper bound is below all lower bounds keeps its cluster. Else the distance to its own centroid is worked out, then those to
        the listed ones that could be nearer or as near; if the remainder could, all of them. A tie needs a distance, as the smaller number wins.
        """
        width, needed = self.near.shape[1], 0
        floor = np.minimum(self.lower.min(1, initial=np.inf), self.rest)
        open_ = np.flatnonzero(self.upper >= floor)
        if len(open_):
            own = _paired(x[open_], c, self.cluster[open_][:, None])[:, 0]
            self.looked[open_] += 1
            self.upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + _SLACK)
            still = self.upper[open_] >= floor[open_]
            open_, own = open_[still], own[still]
        if not len(open_):
            return 0
        far = self.upper[open_] >= self.rest[open_]
        every, listed, own = open_[far], open_[~far], own[~far]
        if len(every):
            fresh = Bounds.scanned(squared(x[every], c), width, self.looked[every])
            for name in ("cluster", "upper", "near", "lower", "rest", "looked"):
                getattr(self, name)[every] = getattr(fresh, name)
            needed = width
        if len(listed):
            needed = max(needed, int((self.lower[listed] <= self.upper[listed][:, None]).sum(1).max()))
            ids = np.concatenate((self.cluster[listed][:, None], self.near[listed]), axis=1)
            d2 = np.concatenate((own[:, None], _paired(x[listed], c, ids[:, 1:])), axis=1)
            # by distance, then by number
            order = np.lexsort((ids, d2), axis=1)
            ids, distance = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d2, order, 1).astype(np.float64))
            self.cluster[listed], self.near[listed] = ids[:, 0], ids[:, 1:]
            self.upper[listed], self.lower[listed] = distance[:, 0] * (1 + _SLACK), distance[:, 1:] * (1 - _SLACK)
            self.looked[listed] += width
        return needed


def _paired(x: np.ndarray, c: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to the centroids of its own row of ids."""
    return np.stack([((x - c[ids[:, j]]) ** 2).sum(1) for j in range(ids.shape[1])], axis=1) if ids.shape[1] else np.zeros((len(x), 0), np.int64)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))


_STATE = "vec_id long, v array<int>, cluster int, upper double, near array<int>, lower array<double>, rest double, looked long, distance long, needed int"


def _round(state: DataFrame, c: np.ndarray, drift: np.ndarray | None, width: int, exact: bool) -> DataFrame:
    """state after one assignment to the centroids c; drift is None the first time, when every row is scanned. exact: with the squared distance to the own centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), np.int64)
            if drift is None:
                known, needed = Bounds.scanned(squared(x, c), width, np.zeros(len(x), np.int64)), width
            else:
                col = lambda n: b.column(n).to_numpy(zero_copy_only=False).copy()
                known = Bounds(col("cluster"), col("upper"), _matrix(b.column("near"), np.int32), _matrix(b.column("lower"), np.float64), col("rest"), col("looked")).narrowed(width).moved(drift)
                needed = known.assigned(x, c)
            own = _paired(x, c, known.cluster[:, None])[:, 0] if exact else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(known.cluster, pa.int32()), pa.array(known.upper), _lists(known.near, pa.int32()), _lists(known.lower, pa.float64()), pa.array(known.rest), pa.array(known.looked), pa.array(own), pa.array(np.full(len(x), needed, np.int32))],
                names=["vec_id", "v", "cluster", "upper", "near", "lower", "rest", "looked", "distance", "needed"],
            )

    return state.mapInArrow(run, _STATE)


def drake_means(vectors: DataFrame, clusters: int = 16, rounds: int = 3) -> DataFrame:
    """(vec_id, v, cluster, distance, cluster_inertia, inertia, centroid_sha256, looked) of vectors (vec_id, v array<int>): k-means from given seeds.

    Each of `rounds` rounds assigns every vector to the nearest centroid (of equally near ones the smaller number), then replaces every centroid that has vectors by the
    floor of their mean, component by component and exactly; a last assignment follows. `looked` counts the distances that were worked out to decide a row;
    a plain search takes clusters * (rounds + 1).

    A vector keeps lower bounds to a quarter of the centroids at first; the list shrinks, down to an eighth, to as many as any row has needed in the last
    round (the rest goes into the remainder bound). The state of a round is a table in the shared folder, written once and deleted when the next one is
    there, so a lost executor costs its tasks only. The driver gets clusters * width sums a round, whatever the number of rows.

    No vectors: no rows. Fewer vectors than clusters: as many clusters as vectors. Repeated rows are clustered each.
    """
    spark = vectors.sparkSession
    c = seeds(vectors, clusters)
    if not len(c):
        none = vectors.select("vec_id", "v", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).cast("long").alias("looked"))
        return none.limit(0)
    base = f"{shared_folder(spark)}/drake-{uuid.uuid4().hex}"
    width = min(len(c) - 1, max(1, len(c) // 4))
    state, drift, old = vectors.select("vec_id", "v"), None, None
    for i in range(rounds + 1):
        path = f"{base}/{i}"
        _round(state, c, drift, width, i == rounds).write.parquet(path)
        state = spark.read.parquet(path)
        if old:
            delete(spark, [old])
        old = path
        if i == rounds:
            break
        sums = state.select("cluster", "needed", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("long")).alias("s"), F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed")).collect()
        new = c.copy()
        for r in sums:
            new[r.cluster, r.at] = r.s // r.n
        drift, c = np.sqrt(((new - c).astype(np.float64) ** 2).sum(1)), new
        width = min(width, max(max(r.needed for r in sums), len(c) // 8, 1)) if width else 0
    totals = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(i, totals.get(i, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, one)).encode()).hexdigest()) for i, one in enumerate(c.tolist())]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "v", "cluster", "distance", "looked").join(F.broadcast(facts), "cluster").select("vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "looked")

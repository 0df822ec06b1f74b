"""Operator 12: centroid clustering, centroids filtered by rotated coordinates.

The table of vectors is turned once: mean and covariance are summed in Spark, the
eigenvectors of the covariance (components x components numbers, on the driver) give a
rotation, and each vector is stored as its integers, its leading rotated coordinates y and
the norm r of what they leave out.  Centroids get the same y and r.  Since the left-out
parts of a vector and a centroid lie in one subspace,

    |y_v - y_c|^2 + (r_v - r_c)^2  <=  |v - c|^2,

so a centroid whose left side exceeds the exact distance of another one can't be nearest.
The centroid of the least bound is measured first; those whose bound, less a margin
for rounding, does not exceed that distance survive and are measured too, in integers.
Equal distances go to the smaller number.

A round is one pass over the table: tasks sum up their vectors by centroid, a shuffle adds
the sums, and k x components numbers reach the driver.  Means are floored exactly.

Defined results: a vector that is null, has null or non-finite components or not exactly ``dim``
of them gives no row.  Repeated rows are rows of their own; null ids come last when
centroids are chosen, equal ids by their vectors.  Fewer vectors than k: fewer clusters.
A centroid without vectors stays.  An empty table gives an empty result.  Other columns of
the table are neither read nor returned, so no name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.intvec import SUM_ROWS, floor_means, integer_vectors, matrix, slices, sum_rows
from adloom.session import materialize

#: Share of the squared norms that covers all rounding in a bound, many times over.
ROUNDING = 1e-10


class Rotation:
    """Mean and the leading eigenvectors of the covariance."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes          # axes: components x leading

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = x - self.mean
        y = centred @ self.axes
        return y, np.linalg.norm(centred - y @ self.axes.T, axis=1)


def fit_rotation(vectors: DataFrame, dim: int, leading: int) -> Rotation:
    """From the column x of all vectors.  Results don't depend on it, only how much is filtered."""
    def run(batches):
        total = np.zeros((dim + 1, dim + 1))       # the last row and column hold sums and the count
        for b in slices(batches):
            x = np.concatenate((matrix(b.column(0), dim, np.float64), np.ones((b.num_rows, 1))), axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["at", "s"])

    rows = vectors.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((dim + 1) ** 2)
    for r in rows:
        total[r["at"]] = r["s"]
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[dim, dim], 1.0)
    mean = total[dim, :dim] / n
    _, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1][:, :leading]))


class Filter:
    """Nearest centroids of stored vectors."""

    def __init__(self, centroids: np.ndarray, rotation: Rotation):
        self.centroids = centroids
        self.y, self.r = rotation.project(centroids.astype(np.float64))
        self.norm = (self.y * self.y).sum(axis=1) + self.r * self.r

    def _exact(self, x: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), 32768):
            gap = x[rows[at:at + 32768]] - self.centroids[numbers[at:at + 32768]]
            out[at:at + 32768] = np.einsum("pd,pd->p", gap, gap)
        return out

    def nearest(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's centroid, and how many distances were measured."""
        own = (y * y).sum(axis=1)
        bound = own[:, None] + (self.y * self.y).sum(axis=1)[None, :] - 2 * (y @ self.y.T) + (r[:, None] - self.r[None, :]) ** 2
        rows = np.arange(len(x))
        guess = np.argmin(bound, axis=1)
        best = self._exact(x, rows, guess)
        margin = ROUNDING * ((own + r * r)[:, None] + self.norm[None, :] + 1)
        open_ = bound - margin <= best[:, None].astype(np.float64) * (1 + ROUNDING)
        open_[rows, guess] = False
        at, number = np.nonzero(open_)
        found = self._exact(x, at, number)
        least = best.copy()
        np.minimum.at(least, at, found)
        cluster = np.where(best == least, guess, len(self.centroids))
        ties = found == least[at]
        np.minimum.at(cluster, at[ties], number[ties])
        return cluster, least, len(x) + len(at)


def _assigner(centroids: np.ndarray, rotation: Rotation, dim: int):
    """Of a batch with columns x, y, r at its end: integers, clusters, distances."""
    filter_ = Filter(centroids, rotation)

    def of(b: pa.RecordBatch):
        n = b.num_columns
        x = matrix(b.column(n - 3), dim)
        cluster, far, _ = filter_.nearest(x, matrix(b.column(n - 2), rotation.axes.shape[1], np.float64), np.asarray(b.column(n - 1)))
        return x, cluster, far
    return of


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 40,
                      rounds: int = 5, seed: int = 2, leading: int = 16) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    The first centroids are the k vectors with the smallest sha256 of ``<seed>:<vec_id>``."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    whole = integer_vectors(vectors, vec_col, {"vec_id": F.col(id_col)}).filter(F.size("x") == dim)
    rotation = fit_rotation(whole, dim, min(leading, dim))

    def rotate(batches):
        for b in slices(batches):
            y, r = rotation.project(matrix(b.column(1), dim, np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(r)], names=["vec_id", "x", "y", "r"])

    stored = materialize(whole.mapInArrow(rotate, f"vec_id {kind}, x array<int>, y array<double>, r double"), "rotated")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = stored.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()   # k rows
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dim)
    if not len(first):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    n = len(centroids)
    for _ in range(rounds):
        def add_up(batches, centroids=centroids):
            assign = _assigner(centroids, rotation, dim)
            sums, counts = np.zeros((n, dim), np.int64), np.zeros(n, np.int64)
            for b in slices(batches):
                x, cluster, _ = assign(b)
                by = np.argsort(cluster, kind="stable")
                used, at = np.unique(cluster[by], return_index=True)
                sums[used] += np.add.reduceat(x[by], at, axis=0)
                counts += np.bincount(cluster, minlength=n)
            yield sum_rows(sums, counts)

        centroids = floor_means(stored.select("x", "y", "r").mapInArrow(add_up, SUM_ROWS), centroids)

    def label(batches):
        assign = _assigner(centroids, rotation, dim)
        for b in slices(batches):
            _, cluster, far = assign(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = materialize(stored.mapInArrow(label, f"vec_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}   # at most k rows
    facts = [(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
             for j, s in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

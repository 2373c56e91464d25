"""K-means over whole-number vectors, every assignment decided by a tournament of bisectors.

Vectors of ``dims`` components become integers floor(``scale`` * x). Of two centroids i < j the
nearer one lies on the vector's side of their bisector: with the normal n = 2 (c_j - c_i) and the
threshold t = |c_j|^2 - |c_i|^2, computed once per round, j is nearer exactly if x.n > t. A vector
starts with centroid 0 and meets the others in order; each of the k-1 sign tests eliminates one
centroid, and a zero leaves the smaller number. Only the winner's distance is computed, exactly.

**Scale.** A round is one scan: every task adds up its vectors per centroid, so at most
k (dims + 1) sums leave a task, are combined by the shuffle and come to the driver. The centroids
(k dims numbers) and the normals (k k dims) are bound by the parameters, not by the data. A hot
vector or cluster only adds to a sum.

Cases: vectors that are null, of another length, or hold null or non-finite components take no
part and are not returned. With fewer than ``k`` vectors there are as many centroids as vectors;
an empty table gives an empty result. A null key draws the hash of the empty key; of vectors with
equal hashes the smaller one starts a smaller centroid. Equal centroids: the smaller number wins,
the other stays as it is. Components whose integer is not below 2^26 in size would leave exact
64-bit arithmetic; the job then fails and says so. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecall.llm.shared import saved

K = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = "2"
_MOST = 1 << 26
_ROWS = 8192


def vectors_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that hold ``dims`` finite components, and those as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), float("nan"))
    flat = flat.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row, ~np.isfinite(flat), len(size)) > 0
    keep = (size == dims) & ~bad
    return np.flatnonzero(keep), flat[keep[row]].reshape(-1, dims)


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component."""
    scaled = np.floor(scale * vectors)
    if len(scaled) and np.abs(scaled).max() >= _MOST:
        raise ValueError(f"a component times {scale} is not below 2^26 in size")
    return scaled.astype(np.int64)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        square = (centroids * centroids).sum(axis=1)
        self.normal = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.threshold = square[None, :] - square[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of every vector, and its squared distance."""
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normal[best, j]) - self.threshold[best, j]
            best[side > 0] = j
        apart = x - self.centroids[best]
        return best, np.einsum("ij,ij->i", apart, apart)


def _blocks(column: pa.Array, dims: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, len(column), _ROWS):
        row, x = vectors_of(column.slice(lo, _ROWS), dims)
        yield row + lo, integers(x, scale)


def _taking_part(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return (F.size(vector) == dims) & finite


def first_centroids(rows: DataFrame, k: int, dims: int, scale: float, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:key``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    plain = F.transform("vector", lambda x: x.cast("double"))
    chosen = (
        rows.where(_taking_part(F.col("vector"), dims))
        .select(F.sha2(name.cast("binary"), 256).alias("hash"), plain.alias("vector"))
        .orderBy("hash", "vector")
        .limit(k)
        .collect()  # k vectors
    )
    return integers(np.array([r["vector"] for r in chosen], float).reshape(-1, dims), scale)


def cluster_sums(rows: DataFrame, bisectors: Bisectors, dims: int, scale: float) -> np.ndarray:
    """Per centroid the number of its vectors and their componentwise sums."""
    k = len(bisectors.centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for _, x in _blocks(batch.column("vector"), dims, scale):
                best, _ = bisectors.nearest(x)
                np.add.at(total, best, np.column_stack([np.ones(len(x), np.int64), x]))
        cluster = np.flatnonzero(total[:, 0])
        place = np.tile(np.arange(dims + 1), len(cluster))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(cluster, dims + 1), pa.int64()),
                pa.array(place, pa.int64()),
                pa.array(total[cluster].reshape(-1), pa.int64()),
            ],
            names=["cluster", "place", "total"],
        )

    parts = rows.select("vector").mapInArrow(add, "cluster bigint, place bigint, total bigint")
    sums = np.zeros((k, dims + 1), np.int64)
    for cluster, place, total in (
        parts.groupBy("cluster", "place").agg(F.sum("total")).collect()  # k (dims + 1) numbers
    ):
        sums[cluster, place] = total
    return sums


def assigned(rows: DataFrame, bisectors: Bisectors, dims: int, scale: float) -> DataFrame:
    """``key``, ``cluster`` and ``distance`` of every vector that takes part."""
    kind = rows.schema["key"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in _blocks(batch.column("vector"), dims, scale):
                best, distance = bisectors.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(row)),
                        pa.array(best, pa.int32()),
                        pa.array(distance, pa.int64()),
                    ],
                    names=["key", "cluster", "distance"],
                )

    return rows.mapInArrow(assign, f"key {kind}, cluster int, distance bigint")


def cluster_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: float = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``
    of every vector that takes part, after ``rounds`` rounds."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    centroids = first_centroids(rows, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        sums = cluster_sums(rows, Bisectors(centroids), dims, scale)
        n = sums[:, :1]
        centroids = np.where(n > 0, sums[:, 1:] // np.maximum(n, 1), centroids)
    if len(centroids):
        placed = saved(assigned(rows, Bisectors(centroids), dims, scale), "assigned")
    else:
        placed = rows.limit(0).selectExpr("key", "int(null) AS cluster", "bigint(null) AS distance")
    digests = [
        (i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    spark = df.sparkSession
    named = spark.createDataFrame(digests, "cluster INT, centroid_sha256 STRING")
    totals = (
        placed.groupBy("cluster")
        .agg(F.sum("distance").alias("cluster_inertia"))
        .join(F.broadcast(named), "cluster")
        .withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    )
    # one row per centroid
    return placed.join(F.broadcast(totals), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

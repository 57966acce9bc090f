"""Centroid clustering of integer vectors: rounds of floor means, nearest centroids by a tournament of bisectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import ship, stored

#: All pairs of centroids have a precomputed normal, so that memory grows with the square of their number.
MOST_CENTROIDS = 256
#: Components below this keep every product and sum of up to 1,024 components within 64 bits.
SMALL = 1 << 24
LIMB = 32


class Bisectors:
    """Integer normals and thresholds of the planes halfway between every two centroids.

    For numbers ``i < j`` the point ``x`` is nearer to ``j`` exactly if ``2 x . (cj - ci) > cj . cj - ci . ci``;
    equality is a tie, which the smaller number wins.
    """

    def __init__(self, centroids: list[list[int]]):
        exact = np.array(centroids, dtype=object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        self.exact = self._planes(exact)
        self.small = exact.shape[1] <= 1024 and all(abs(v) < SMALL for v in exact.ravel())
        self.fast = tuple(a.astype(np.int64) for a in self.exact) if self.small else None

    @staticmethod
    def _planes(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        squares = (centers * centers).sum(axis=1)
        return centers, 2 * (centers[None, :, :] - centers[:, None, :]), squares[None, :] - squares[:, None]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of every point, and the exact squared distance to it.

        Integers of 64 bits where these suffice (``points`` of that type are below ``SMALL``), else unlimited ones.
        """
        if self.small and points.dtype != object:
            centers, normals, thresholds = self.fast
        else:
            points = points.astype(object)
            centers, normals, thresholds = self.exact
        best = np.zeros(len(points), np.int64)
        # after step j, best is the nearest of the centroids 0 to j: each test eliminates one of two
        for j in range(1, len(centers)):
            side = (points * normals[best, j]).sum(axis=1) - thresholds[best, j]
            best[side > 0] = j
        apart = points - centers[best]
        return best, (apart * apart).sum(axis=1)


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite doubles: 64-bit integers if all are below ``SMALL``, else unlimited ones."""
    if not values.size or np.abs(values).max() * scale < SMALL - 1:
        return np.floor(values * scale).astype(np.int64)
    # doubles of this size are integers; the product may exceed the doubles
    whole = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def limbs(total: int) -> list[int]:
    """Parts of an integer whose sum, each times ``2 ** (32 * place)``, is the integer; all but the last are not negative."""
    out = []
    while total not in (0, -1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _blocks(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and integer points of a batch; rows with large components apart, so that the others stay fast."""
    flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = flat.reshape(-1, dims)
    large = (np.abs(values) * scale >= SMALL - 1).any(axis=1) if dims else np.zeros(len(values), bool)
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(rows):
            yield rows, floors(values[rows], scale)


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _means(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """Floor means of the vectors nearest to each centroid; a centroid without vectors stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        sums = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            for _, points in _blocks(batch, dims, scale):
                best, _ = planes.nearest(points)
                for c in np.unique(best).tolist():
                    own = points[best == c]
                    sums[c, :dims] += own.sum(axis=0).astype(object)
                    sums[c, dims] += len(own)
        # the task's sums as limbs, so that Spark adds them exactly however large they are
        parts = [
            (c, d, place, part)
            for c, row in enumerate(sums)
            if row[dims]
            for d, total in enumerate(row)
            for place, part in enumerate(limbs(int(total)))
        ]
        columns = zip(*parts) if parts else ((), (), (), ())
        arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["cluster", "dim", "place", "part"])

    partial = vectors.select("_v").mapInArrow(run, "cluster int, dim int, place int, part long")
    # centroids x components x limbs rows, however many vectors there are
    totals: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("cluster", "dim", "place").agg(F.sum("part").alias("part")).collect():
        totals[r.cluster, r.dim] = totals.get((r.cluster, r.dim), 0) + (r.part << (LIMB * r.place))
    return [
        [totals[c, d] // totals[c, dims] for d in range(dims)] if (c, dims) in totals else list(centroids[c])
        for c in range(k)
    ]


def centroid_clusters(
    df: DataFrame,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    carry: tuple[str, ...] = (),
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: str = "1:",
) -> DataFrame:
    """One row per usable vector: id, ``carry``, ``cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors with exactly ``dims`` components, none null or non-finite, take part, each component as the integer
    ``floor(scale * x)``. The first centroids are the ``k`` vectors with the least SHA-256 of ``seed`` and the id,
    in that order. Every round assigns all vectors to the nearest centroid by :class:`Bisectors` and replaces the
    non-empty centroids by the floor of the exact means; then the vectors are assigned once more.

    Null ids take part and come last among the first centroids. Rows with the same id are ordered by their vectors;
    repeated rows are vectors like others, so that equal first centroids can occur, of which the smaller number
    wins all. With fewer than ``k`` usable vectors there are as many centroids as vectors, without any the result
    is empty. A squared distance, or a sum of them, beyond 64 bits is null; means are exact at any size. Other
    columns are ignored, whatever their names.
    """
    if not 0 < k <= MOST_CENTROIDS or dims < 1 or scale < 1:
        raise ValueError(f"k must be 1 to {MOST_CENTROIDS}, dims and scale 1 or more")
    spark = df.sparkSession
    ship(spark)
    vectors = df.where(usable(F.col(vector), dims)).select(
        F.col(vec_id).alias("_id"), *[F.col(c).alias(f"_carry_{c}") for c in carry], F.col(vector).alias("_v")
    )
    named = vectors.select("_id", "_v", F.sha2(F.concat(F.lit(seed), F.col("_id").cast("string")), 256).alias("_h"))
    first = named.orderBy(F.col("_h").asc_nulls_last(), "_id", "_v").limit(k).collect()
    centroids = [[int(v) for v in floors(np.array(r["_v"], np.float64), scale)] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = _means(vectors, centroids, dims, scale)

    kept = vectors.drop("_v").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "cluster int, distance long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        for batch in batches:
            cluster = np.zeros(batch.num_rows, np.int32)
            distance: list[int | None] = [None] * batch.num_rows
            for rows, points in _blocks(batch, dims, scale):
                best, apart = planes.nearest(points)
                cluster[rows] = best
                for row, d in zip(rows.tolist(), apart.tolist()):
                    distance[row] = d if d < 1 << 63 else None
            own = [batch.column(f.name) for f in kept]
            arrays = [*own, pa.array(cluster), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept.names, "cluster", "distance"])

    assigned = stored(vectors.select(*kept.names, "_v").mapInArrow(run, schema))
    sums = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("*") - F.count("distance")).alias("none")
    )
    totals = {r.cluster: None if r.none else int(r.total) for r in sums.collect()}
    whole = None if None in totals.values() else sum(totals.values())

    def fitting(total: int | None) -> int | None:
        return total if total is not None and total < 1 << 63 else None

    # one row per centroid
    groups = spark.createDataFrame(
        [
            (c, fitting(totals.get(c, 0)), fitting(whole), hashlib.sha256(",".join(map(str, center)).encode()).hexdigest())
            for c, center in enumerate(centroids)
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(groups), "cluster").select(
        F.col("_id").alias(vec_id),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        "centroid_sha256",
    )

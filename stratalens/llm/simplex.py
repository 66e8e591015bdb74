"""Centroid clustering with centroids filtered by n-simplex bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.session import save_shared

#: Parameters of the registered query.
CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2
#: Pivots of the simplex, the least height of a pivot over the earlier ones (of the longest edge), and the rounding
#: that bounds are given, of the distances to the first pivot.
PIVOTS = 12
LEAST_HEIGHT = 0.01
ROUNDING = 1e-5
#: Largest integer component: squared distances of 64 such components fit a long.
LARGEST = 1 << 27
ROWS = 4096


class Simplex:
    """A base simplex of pivots, and the apex that distances to them put over it.

    The base is laid out in a space of one dimension less than it has pivots.
    A point's distances to the pivots fix its apex: coordinates in the base's
    space and a height over it. Between two points, the distance of their
    apexes is a lower bound of the true one, and with one of the heights turned
    downward an upper bound.
    """

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        """Pivots from ``points`` (n x d integers, n > 0): each the one highest over the earlier ones."""
        rest = (points - points[0]).astype(np.float64)
        chosen = [0]
        longest = np.sqrt((rest**2).sum(axis=1)).max()
        while len(chosen) < min(most, points.shape[1]):
            heights = np.sqrt((rest**2).sum(axis=1))
            best = int(heights.argmax())
            if longest == 0 or heights[best] < LEAST_HEIGHT * longest:
                break
            chosen.append(best)
            unit = rest[best] / heights[best]
            rest = rest - np.outer(rest @ unit, unit)
        self.pivots = points[chosen]
        edges = self.pivots[1:] - self.pivots[0]
        self.squares = (edges**2).sum(axis=1)
        self.base = np.linalg.cholesky((edges @ edges.T).astype(np.float64)) if len(edges) else np.zeros((0, 0))

    def squared_distances(self, points: np.ndarray) -> np.ndarray:
        """Exact integers, one column per pivot."""
        return np.stack([((points - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Base coordinates, height and distance to the first pivot, from squared distances to all pivots."""
        first = squared[:, 0]
        along = (first[:, None] - squared[:, 1:] + self.squares) / 2
        inner = np.linalg.solve(self.base, along.T).T if len(self.base) else along
        height = np.sqrt(np.maximum(first - (inner**2).sum(axis=1), 0))
        return np.column_stack([inner, height, np.sqrt(first)])


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, exact squared distance to it, and how many exact distances that took.

    A centroid stays a candidate if its lower bound is not above the least
    upper bound of all; candidates are compared by exact integers, ties go to
    the smaller number.
    """
    others = simplex.apexes(simplex.squared_distances(centroids))
    flat = (apexes[:, None, :-2] - others[None, :, :-2]) ** 2
    flat = flat.sum(axis=2)
    high, far = (apexes[:, None, -2], others[None, :, -2]), (apexes[:, None, -1] + others[None, :, -1])
    lower = np.sqrt(flat + (high[0] - high[1]) ** 2) - ROUNDING * far
    upper = np.sqrt(flat + (high[0] + high[1]) ** 2) + ROUNDING * far
    row, number = np.nonzero(lower <= upper.min(axis=1)[:, None])
    exact = ((points[row] - centroids[number]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, np.arange(len(points)))
    least = np.minimum.reduceat(exact, starts)
    hits = np.flatnonzero(exact == least[row])
    return number[hits[np.searchsorted(row[hits], np.arange(len(points)))]], least, len(row)


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, point: the kept vectors as little-endian 32-bit integers floor(scale * x)."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            own = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
            column, ids = column.filter(own), batch.column("vec_id").filter(own)
            flat = column.flatten()
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            good = np.isfinite(values).all(axis=1)
            points = np.floor(scale * values[good])
            if (np.abs(points) > LARGEST).any():
                raise OverflowError(f"a component above {LARGEST}: squared distances would not fit a long")
            data = [row.tobytes() for row in points.astype("<i4")]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(data, pa.binary())], names=["vec_id", "point"])

    return vectors.select("vec_id", "embedding").mapInArrow(quantise, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, point binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, points and apexes, some thousand rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            block = batch.slice(at, ROWS)
            yield block.column("vec_id"), _matrix(block.column("point"), "<i4").astype(np.int64), _matrix(block.column("apex"), "<f8")


def first_centroids(points: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The ``clusters`` points with the least SHA-256 of ``seed:vec_id``; of rows that repeat an id, those with the least bytes first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.orderBy(order, "point").limit(clusters).select("point").collect()  # as many as there are clusters
    return np.array([np.frombuffer(row["point"], dtype="<i4") for row in rows], dtype=np.int64)


def next_centroids(cached: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Every non-empty centroid moved to the floor of its points' mean; tasks send one sum per cluster and component."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for _, points, apexes in _blocks(batches):
            number, _, _ = nearest(points, apexes, centroids, simplex)
            np.add.at(sums, number, points)
            rows += np.bincount(number, minlength=len(centroids))
        cluster, place = np.indices(sums.shape)
        used = rows[cluster.ravel()] > 0
        columns = [cluster.ravel().astype(np.int32), place.ravel().astype(np.int32), sums.ravel(), rows[cluster.ravel()]]
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], names=["cluster", "place", "total", "n"])

    found = cached.mapInArrow(add_up, "cluster int, place int, total long, n long")
    moved = centroids.copy()
    for row in found.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[row["cluster"], row["place"]] = row["total"] // row["n"]  # clusters x components rows
    return moved


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    pivots: int = PIVOTS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding).

    Lloyd's rounds over integer vectors, all sums and distances exact. Pivots
    are taken from the first centroids; every vector's distances to them are
    computed once and stored as its apex, so that later rounds compute exact
    distances only to centroids which the bounds leave over.

    Kept are vectors of exactly ``dimensions`` components, none NULL or
    non-finite. Repeated rows are vectors of their own. A NULL vec_id is
    hashed as empty text. Ties go to the smaller centroid number. With fewer
    vectors than ``clusters`` each is a centroid. An empty table gives an
    empty result. A component above 2^27 after scaling is an error, since its
    distances do not fit a long. The driver holds the centroids alone.
    """
    spark: SparkSession = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    points = save_shared(integer_vectors(vectors, dimensions, scale), "points")
    centroids = first_centroids(points, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    simplex = Simplex(centroids, pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = simplex.apexes(simplex.squared_distances(_matrix(batch.column("point"), "<i4").astype(np.int64)))
                data = pa.array([row.tobytes() for row in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, data], names=["vec_id", "point", "apex"])

    cached = save_shared(points.mapInArrow(project, f"vec_id {kind}, point binary, apex binary"), "apexes")
    for _ in range(rounds):
        centroids = next_centroids(cached, centroids, simplex)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, apexes in _blocks(batches):
            number, distance, _ = nearest(points, apexes, centroids, simplex)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = save_shared(cached.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # a row per cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = sum(int(row["total"]) for row in sums)
    rows = [(row["cluster"], int(row["total"]), inertia, digests[row["cluster"]]) for row in sums]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

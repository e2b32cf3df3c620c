"""K-means over integer vectors with a LAESA pivot table in front of exact distances.

Each vector's distances to ``PIVOTS`` fixed vectors are stored once, beside the vector. In every round the centroids' distances to the pivots
bound those to the vectors from below: by the triangle inequality no centroid is nearer than the largest difference of the two distances
to one pivot. Centroids are tried in the order of their bounds, and one whose bound is above the best exact distance is ruled out; ties
are never ruled out, as the bounds are lowered by more than doubles can be wrong. Exact distances are integers.

A round is one pass over the table: tasks return the sums and the sizes of their clusters, and only these totals reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.text import releasing
from pathloom.scale import cut_lineage

WIDTH = 64
CLUSTERS = 8
ROUNDS = 10
PIVOTS = 16
# Pivots are chosen among so many vectors.
PIVOT_SAMPLE = 512
SCALE = 1024
SALT = 3
# Beyond this, distances as a rule do not fit the result's 64 bits.
LARGEST = 1 << 30


def vectors_as_integers(df: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, v (array<long>)`` of the rows whose ``embedding`` has ``width`` components, all of them finite. A component beyond
    ``LARGEST`` after scaling is an error, as distances to it would not fit a long."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size("embedding") == width, x).alias("x")).filter(
        "x is not null").filter(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    too_large = F.exists("x", lambda e: F.abs(e) * scale >= LARGEST)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}: distances would not fit 64 bits")).cast("array<long>"))
    return kept.select("vec_id", checked.otherwise(F.transform("x", lambda e: F.floor(e * scale).cast("long"))).alias("v"))


def _fit_64_bits(*arrays: np.ndarray) -> bool:
    """Whether the sum of the squared differences of any two rows is below 2**63."""
    largest = max(int(np.abs(a).max(initial=0)) for a in arrays)
    return 4 * largest * largest * arrays[0].shape[-1] < 1 << 63


def squared_distances(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``points`` (rows) to ``other`` (one vector, or a row for each point), as Python integers where 64 bits
    may not hold them."""
    if _fit_64_bits(points, other):
        difference = points - other
        return np.einsum("ij,ij->i", difference, difference)
    difference = points.astype(object) - other.astype(object)
    return (difference * difference).sum(axis=1) if len(points) else np.empty(0, object)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class PivotSearch:
    """The nearest of a few centroids for many vectors."""

    pivots: np.ndarray
    centroids: np.ndarray

    def __post_init__(self):
        # centroid, pivot
        self.to_pivots = np.array([_root(squared_distances(self.pivots, c)) for c in self.centroids]).reshape(len(self.centroids), len(self.pivots))

    def bounds(self, stored: np.ndarray) -> np.ndarray:
        """Per vector and centroid a number that the distance is not below. ``stored``: the vectors' distances to the pivots."""
        bound = np.zeros((len(stored), len(self.centroids)))
        for p in range(stored.shape[1]):
            far = self.to_pivots[:, p]
            # Rounding of both roots, with room to spare.
            slack = 1e-12 * (stored[:, p, None] + far) + 1e-9
            np.maximum(bound, np.abs(stored[:, p, None] - far) - slack, out=bound)
        return bound

    def nearest(self, vectors: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (the smallest of equally near ones), the squared distance, and how many exact distances it took."""
        bound = self.bounds(stored)
        order = np.argsort(bound, axis=1, kind="stable")
        cluster = np.full(len(vectors), len(self.centroids), np.int64)
        best = np.full(len(vectors), np.inf)
        distance = np.zeros(len(vectors), np.int64 if _fit_64_bits(vectors, self.centroids) else object)
        exact = 0
        for rank in range(len(self.centroids)):
            candidate = order[:, rank]
            left = np.flatnonzero(bound[np.arange(len(vectors)), candidate] <= best)
            if not len(left):
                break
            exact += len(left)
            own = candidate[left]
            found = squared_distances(vectors[left], self.centroids[own])
            nearer = (cluster[left] == len(self.centroids)) | (found < distance[left]) | ((found == distance[left]) & (own < cluster[left]))
            at = left[nearer]
            distance[at], cluster[at] = found[nearer], own[nearer]
            # Raised by more than the rounding of the root.
            best[at] = _root(distance[at]) * (1 + 1e-12) + 1e-9
        return cluster, distance, exact


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, salt: int = SALT) -> np.ndarray:
    """The ``k`` vectors (fewer, if there are not as many) with the smallest SHA-256 of ``salt:vec_id`` in hexadecimal digits. A null id hashes
    ``salt:``; rows that share an id follow each other by their components."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("_hash"), "v").orderBy("_hash", "v").limit(k).collect()
    return np.array([row["v"] for row in sorted(rows, key=lambda row: (row["_hash"], row["v"]))], np.int64)


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """``pivots`` vectors that are far from each other, each the farthest from those before it, among ``sample`` vectors with small hashes.
    Any choice gives right results."""
    rows = vectors.select(F.xxhash64("vec_id", "v").alias("_hash"), "v").orderBy("_hash", "v").limit(sample).collect()
    found = np.array([row["v"] for row in rows], np.int64)
    if not len(found):
        return found
    chosen, far = [0], _root(squared_distances(found, found[0]))
    while len(chosen) < min(pivots, len(found)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _root(squared_distances(found, found[chosen[-1]])))
    return found[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v, to_pivots``: the vectors with their distances to the pivots, computed once and stored in the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch["v"], pivots.shape[1])
            stored = np.column_stack([_root(squared_distances(points, p)) for p in pivots])
            edges = np.arange(len(points) + 1, dtype=np.int32) * len(pivots)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.ListArray.from_arrays(edges, stored.ravel())], names=["vec_id", "v", "to_pivots"])

    return cut_lineage(vectors.mapInArrow(releasing(work), "vec_id long, v array<long>, to_pivots array<double>"))


def next_centroids(table: DataFrame, search: PivotSearch) -> tuple[np.ndarray, int]:
    """The centroids after one round, and how many exact distances it took. Empty clusters keep theirs."""
    width = search.centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(search.centroids), width), np.int64)
        counts, exact = np.zeros(len(search.centroids), np.int64), 0
        for batch in batches:
            points = _matrix(batch["v"], width)
            cluster, _, tried = search.nearest(points, _matrix(batch["to_pivots"], len(search.pivots)))
            exact += tried
            order = np.argsort(cluster, kind="stable")
            heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(heads):
                sums[cluster[order][heads]] += np.add.reduceat(points[order], heads)
            counts += np.bincount(cluster, minlength=len(counts))
        kept = np.flatnonzero(counts)
        edges = np.arange(len(kept) + 1, dtype=np.int32) * width
        tried = np.where(np.arange(len(kept)) == 0, exact, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept), pa.array(counts[kept]), pa.array(tried), pa.ListArray.from_arrays(edges, sums[kept].ravel())], names=["cluster", "n", "exact", "sums"])

    # Sums of tasks fit a long (fewer than 2**33 rows a task); their total is a decimal.
    parts = table.mapInArrow(releasing(work), "cluster long, n long, exact long, sums array<long>")
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("exact").alias("exact"), *[F.sum(F.col("sums")[i].cast("decimal(28,0)")).alias(f"_{i}") for i in range(width)]).collect()
    centroids = search.centroids.copy()
    for row in totals:
        centroids[row["cluster"]] = [int(row[f"_{i}"]) // row["n"] for i in range(width)]
    return centroids, sum(row["exact"] for row in totals)


def assigned(table: DataFrame, search: PivotSearch) -> DataFrame:
    """``vec_id, cluster, distance`` of every row. A squared distance beyond 64 bits is an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = search.nearest(_matrix(batch["v"], search.centroids.shape[1]), _matrix(batch["to_pivots"], len(search.pivots)))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(cluster, pa.int32()), pa.array(distance.tolist() if distance.dtype == object else distance, pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(releasing(work), "vec_id long, cluster int, distance long")


def cluster_vectors(df: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, pivots: int = PIVOTS) -> DataFrame:
    """K-means of ``df (vec_id, embedding)``; other columns are ignored.

    Rows take part whose embedding has ``width`` components, none of them null, NaN or infinite; components become ``floor(SCALE * x)``. The
    centroids start as the ``k`` vectors of :func:`first_centroids`. Each round assigns every vector to its nearest centroid (squared
    Euclidean distance, the smaller number of equal ones) and moves every centroid that has vectors to the floor of their mean. At last the
    vectors are assigned once more. Rows that repeat count each. Returns ``vec_id, cluster, distance`` (squared), ``cluster_inertia`` and
    ``inertia`` (sums of distances over the cluster and over all), ``centroid_sha256`` (of the components of the final centroid as
    decimal numbers, joined by commas). Without a vector that takes part there are no rows.
    """
    vectors = cut_lineage(vectors_as_integers(df, width))
    centroids = first_centroids(vectors, k)
    spark = df.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    fixed = choose_pivots(vectors, pivots)
    table = pivot_table(vectors, fixed)
    for _ in range(rounds):
        centroids, _ = next_centroids(table, PivotSearch(fixed, centroids))
    found = cut_lineage(assigned(table, PivotSearch(fixed, centroids)))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).cast("long").alias("s")).collect()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row per centroid.
    known = spark.createDataFrame([(r["cluster"], r["s"], sum(x["s"] for x in sums), names[r["cluster"]]) for r in sums],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

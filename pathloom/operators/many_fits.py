"""K-means of many parameters over one table of vectors, advanced together.

The trials of a search share their vectors. One pass over them assigns every row in every trial, by one matrix product with all centres, and returns the
sums of all clusters; so an iteration is one job, however many trials there are, and a task emits a row for each cluster. Starting centres come from
candidates that k-means|| draws once for all trials of a distance measure; each trial chooses its own among them by weighted k-means++.
Scores take two more passes: cluster sums, then the silhouette of every row from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITER = 20
TOLERANCE = 1e-4
INIT_STEPS = 2
# Candidates that a step of the start draws on average, for each centre of the largest trial.
OVERSAMPLING = 2
_ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Fit:
    """Parameters of one K-means."""

    k: int
    distance_measure: str = "euclidean"
    seed: int = 1


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _prepared(x: np.ndarray, distance_measure: str) -> np.ndarray:
    return _unit(x) if distance_measure == "cosine" else x


def _costs(x: np.ndarray, centres: np.ndarray, distance_measure: str) -> np.ndarray:
    """Squared Euclidean distances, or one minus the cosine of vectors of length one. (row, centre)"""
    products = x @ centres.T
    if distance_measure == "cosine":
        return 1 - products
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * products + (centres * centres).sum(axis=1), 0)


@dataclass(frozen=True)
class CentreModel:
    """Centres of a K-means. ``transform`` adds ``cluster_id``, the nearest centre's number, to a table with ``vector``; it keeps no state."""

    centres: np.ndarray
    distance_measure: str

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _costs(_prepared(x, self.distance_measure), self.centres, self.distance_measure).argmin(axis=1)

    def transform(self, features: DataFrame) -> DataFrame:
        @F.arrow_udf("int")
        def nearest(vectors: pa.Array) -> pa.Array:
            if not len(vectors):
                return pa.array([], pa.int32())
            return pa.array(self.nearest(vectors.flatten().to_numpy().reshape(len(vectors), -1)), pa.int32())

        return features.withColumn("cluster_id", nearest(vector_to_array("vector")))


def points_of(features: DataFrame, weight: str | None = None) -> DataFrame:
    """``x (array<double>), w (double)`` of a table with ``vector``, kept for the passes; unpersist it afterwards."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return features.select(vector_to_array("vector").alias("x"), w.alias("w")).persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    for whole in batches:
        for start in range(0, len(whole), _ROWS_AT_ONCE):
            batch = whole.slice(start, _ROWS_AT_ONCE)
            yield batch["x"].flatten().to_numpy().reshape(len(batch), -1), batch["w"].to_numpy(), batch


# Rows, their weights and the batch they come from.
Kernel = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], Iterator[tuple[tuple[int, int], np.ndarray]]]


def _summed(points: DataFrame, kernel: Kernel, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Totals of the vectors of length ``width`` that ``kernel`` gives for keys ``(trial, cluster)``. Tasks add up their own; a key is one row of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for x, w, batch in _blocks(batches):
            for key, values in kernel(x, w, batch):
                own[key] = own[key] + values if key in own else values
        keys = sorted(own)
        edges = np.arange(len(keys) + 1, dtype=np.int32) * width
        flat = np.concatenate([own[key] for key in keys]) if keys else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.ListArray.from_arrays(edges, flat)], names=["trial", "cluster", "sums"])

    parts = points.mapInArrow(work, "trial int, cluster int, sums array<double>")
    totals = parts.groupBy("trial", "cluster").agg(*[F.sum(F.col("sums")[i]).alias(f"_{i}") for i in range(width)]).toArrow()
    columns = np.column_stack([totals[f"_{i}"].to_numpy() for i in range(width)]) if len(totals) else np.empty((0, width))
    return {key: row for key, row in zip(zip(totals["trial"].to_pylist(), totals["cluster"].to_pylist()), columns)}


def _by_measure(fits: Sequence[Fit], active: Sequence[int]) -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for n in active:
        groups.setdefault(fits[n].distance_measure, []).append(n)
    return groups


def _cluster_sums(centres: Sequence[np.ndarray], fits: Sequence[Fit], active: Sequence[int]) -> Kernel:
    """For each cluster of the active trials: weight, weighted cost, weighted squared lengths, weighted sum of vectors."""
    groups = _by_measure(fits, active)

    def kernel(x: np.ndarray, w: np.ndarray, _: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        for measure, trials in groups.items():
            own, weights = _prepared(x, measure), w
            if measure == "cosine":  # vectors without a direction are in no cluster
                directed = (x != 0).any(axis=1)
                own, weights = own[directed], w[directed]
            costs = _costs(own, np.concatenate([centres[n] for n in trials]), measure)
            lengths = (own * own).sum(axis=1)
            first = 0
            for n in trials:
                part = costs[:, first:first + len(centres[n])]
                first += len(centres[n])
                cluster = part.argmin(axis=1)
                members = (cluster == np.arange(len(centres[n]))[:, None]) * weights
                totals = np.column_stack([members.sum(axis=1), members @ part.min(axis=1), members @ lengths, members @ own])
                for c in np.flatnonzero(totals[:, 0]).tolist():
                    yield (n, c), totals[c]

    return kernel


def _candidates(points: DataFrame, width: int, measure: str, k: int, seed: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates for centres by k-means||, and the weight of the rows nearest to each; one row at least, if there is one to cluster."""
    place = lambda step: (F.pmod(F.xxhash64("x", F.lit(seed), F.lit(step)), F.lit(1 << 40)) / float(1 << 40))
    usable = points.filter(F.exists("x", lambda e: e != 0)) if measure == "cosine" else points
    first = usable.select("x", place(0).alias("at")).orderBy("at", "x").limit(1).collect()
    if not first:
        return np.empty((0, width)), np.empty(0)
    chosen = _prepared(np.array([first[0]["x"]]), measure)
    for step in range(1, steps + 1):
        known = chosen

        def cost(x, w, _, known=known):
            yield (0, 0), np.array([(w * _costs(_prepared(x, measure), known, measure).min(axis=1)).sum()])

        total = _summed(usable, cost, 1).get((0, 0), np.zeros(1))[0]
        if not total > 0:
            break

        def drawn(batches, known=known, total=total):
            for x, w, batch in _blocks(batches):
                chance = OVERSAMPLING * k * w * _costs(_prepared(x, measure), known, measure).min(axis=1) / total
                yield batch.select(["x"]).filter(pa.array(batch["at"].to_numpy() < chance))

        # About OVERSAMPLING * k rows, whatever the size of the table.
        rows = usable.withColumn("at", place(step)).mapInArrow(drawn, "x array<double>").distinct().orderBy("x").collect()
        if rows:
            chosen = np.concatenate([chosen, _prepared(np.array([row["x"] for row in rows]), measure)])

    def weights(x, w, _):
        nearest = _costs(_prepared(x, measure), chosen, measure).argmin(axis=1)
        yield (0, 0), np.bincount(nearest, w, len(chosen))

    return chosen, _summed(usable, weights, len(chosen)).get((0, 0), np.zeros(len(chosen)))


def _chosen(candidates: np.ndarray, weights: np.ndarray, fit: Fit) -> np.ndarray:
    """Weighted k-means++ among the candidates; fewer centres if fewer of them differ."""
    draw = np.random.default_rng(fit.seed)
    chance = weights.astype(float)
    at: list[int] = []
    for _ in range(fit.k):
        if not chance.sum() > 0:
            break
        at.append(int(draw.choice(len(candidates), p=chance / chance.sum())))
        far = _costs(candidates, candidates[at], fit.distance_measure).min(axis=1)
        far[at] = 0
        chance = weights * np.where(far > 1e-12 * max(far.max(), 1e-300), far, 0)
    return candidates[at]


def starting_centres(points: DataFrame, fits: Sequence[Fit], *, init_steps: int = INIT_STEPS) -> list[np.ndarray]:
    """Centres for every fit; none where no row can be clustered."""
    first = points.select(F.size("x").alias("n")).first()
    if first is None:
        return [np.empty((0, 0)) for _ in fits]
    centres: list = [None] * len(fits)
    for measure, trials in _by_measure(fits, range(len(fits))).items():
        candidates, weights = _candidates(points, first["n"], measure, max(fits[n].k for n in trials), fits[trials[0]].seed, init_steps)
        for n in trials:
            centres[n] = _chosen(candidates, weights, fits[n])
    return centres


def advance_all(points: DataFrame, fits: Sequence[Fit], centres: Sequence[np.ndarray], *, max_iter: int = MAX_ITER,
                tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Lloyd's iterations of all fits from given centres, one job for each. A fit is over when no centre moves by more than ``tolerance``;
    clusters without rows keep their centre."""
    centres = list(centres)
    active = [n for n, c in enumerate(centres) if len(c)]
    for _ in range(max_iter):
        if not active:
            break
        sums = _summed(points, _cluster_sums(centres, fits, active), 3 + centres[active[0]].shape[1])
        still = []
        for n in active:
            moved = centres[n].copy()
            for c in range(len(moved)):
                if (n, c) in sums:
                    total = sums[n, c]
                    moved[c] = total[3:] / total[0]
            measure = fits[n].distance_measure
            if measure == "cosine":  # a mean of zero has no direction: the centre stays
                flat = ~(moved != 0).any(axis=1)
                moved = _unit(moved)
                moved[flat] = centres[n][flat]
            steps = 1 - (moved * centres[n]).sum(axis=1) if measure == "cosine" else np.sqrt(((moved - centres[n]) ** 2).sum(axis=1))
            centres[n] = moved
            if (steps > tolerance).any():
                still.append(n)
        active = still
    return centres


def fit_many(features: DataFrame, fits: Sequence[Fit], *, weight: str | None = None, max_iter: int = MAX_ITER) -> list[CentreModel | None]:
    """A model for every fit over ``vector``; None where no row can be clustered. Under cosine distance rows with a zero vector take no part.

    :param weight: column that tells for how many equal rows each row stands.
    """
    points = points_of(features, weight)
    try:
        centres = advance_all(points, fits, starting_centres(points, fits), max_iter=max_iter)
    finally:
        points.unpersist()
    return [CentreModel(c, fit.distance_measure) if len(c) else None for fit, c in zip(fits, centres)]


def silhouette_rows(x: np.ndarray, cluster: np.ndarray, totals: dict[int, np.ndarray], distance_measure: str) -> np.ndarray:
    """Silhouettes of rows in the clusters ``cluster``. ``totals``: of each cluster weight, (unused), squared lengths, sum of vectors; vectors and sums
    are of length one under cosine distance. A row stands for one or more equal rows, which ``totals`` counts."""
    names = sorted(totals)
    n = np.array([totals[c][0] for c in names])
    sums = np.array([totals[c][3:] for c in names])
    if distance_measure == "cosine":
        mean = 1 - (x @ sums.T) / n
    else:
        mean = np.maximum((x * x).sum(axis=1)[:, None] + np.array([totals[c][2] for c in names]) / n - 2 * (x @ sums.T) / n, 0)
    own = np.searchsorted(names, cluster)
    at = np.arange(len(x))
    alone = n[own] <= 1
    inside = mean[at, own] * n[own] / np.where(alone, 1, n[own] - 1)
    mean[at, own] = np.inf
    outside = mean.min(axis=1)
    largest = np.maximum(inside, outside)
    return np.where(alone | (largest == 0), 0, (outside - inside) / np.where(largest == 0, 1, largest))


def silhouettes(features: DataFrame, models: Sequence[CentreModel | None], *, weight: str | None = None) -> list[float | None]:
    """Mean silhouette of every model, squared for Euclidean distance; None where fewer than two clusters have rows."""
    fits = [Fit(0, m.distance_measure if m else "euclidean") for m in models]
    centres = [m.centres if m else np.empty((0, 0)) for m in models]
    points = points_of(features, weight)
    try:
        known = [n for n, m in enumerate(models) if m]
        if not known:
            return [None] * len(models)
        sums = _summed(points, _cluster_sums(centres, fits, known), 3 + centres[known[0]].shape[1])
        totals = {n: {c: total for (m, c), total in sums.items() if m == n} for n in known}
        scored = [n for n in known if len(totals[n]) > 1]

        def kernel(x, w, _):
            for n in scored:
                measure = models[n].distance_measure
                directed = (x != 0).any(axis=1) if measure == "cosine" else np.ones(len(x), bool)
                own = _prepared(x[directed], measure)
                cluster = _costs(own, models[n].centres, measure).argmin(axis=1)
                each = silhouette_rows(own, cluster, totals[n], measure)
                yield (n, 0), np.array([(w[directed] * each).sum(), w[directed].sum()])

        means = _summed(points, kernel, 2) if scored else {}
    finally:
        points.unpersist()
    return [float(means[n, 0][0] / means[n, 0][1]) if (n, 0) in means else None for n in range(len(models))]


def silhouette_of(clustered: DataFrame, distance_measure: str, weight: str | None = None) -> float | None:
    """Mean silhouette over ``cluster_id`` and ``vector``, where each row stands for ``weight`` equal rows; None without two clusters."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    points = clustered.select(vector_to_array("vector").alias("x"), w.alias("w"), "cluster_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = points.select(F.size("x").alias("n")).first()
        if first is None:
            return None

        def cluster_sums(x, w, batch):
            own, cluster = _prepared(x, distance_measure), batch["cluster_id"].to_numpy()
            for c in np.unique(cluster).tolist():
                members = (cluster == c) * w
                yield (0, c), np.concatenate([[members.sum(), 0, members @ (own * own).sum(axis=1)], members @ own])

        totals = {c: total for (_, c), total in _summed(points, cluster_sums, 3 + first["n"]).items()}
        if len(totals) < 2:
            return None

        def kernel(x, w, batch):
            each = silhouette_rows(_prepared(x, distance_measure), batch["cluster_id"].to_numpy(), totals, distance_measure)
            yield (0, 0), np.array([(w * each).sum(), w.sum()])

        total, rows = _summed(points, kernel, 2)[0, 0]
        return float(total / rows)
    finally:
        points.unpersist()

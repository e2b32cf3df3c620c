"""Search for the clustering parameters with the best score."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby, product
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.weights import PositionWeight, PythonWeight
from pathloom.operators.clustering import MAX_ITER, ClusterModel, assign_clusters, fit_clusters, without_zero_vectors
from pathloom.operators.features import SharedVectors, share_vectors, standardize
from pathloom.operators.many_fits import CentreModel, Fit, fit_many, silhouette_of, silhouettes
from pathloom.operators.patterns import pattern_features, pattern_means, term_patterns, to_urls
from pathloom.operators.scores import silhouette
from pathloom.scale import cut_lineage

# The searched ranges, bounds included.
K_RANGE = (4, 20)
DISTANCE_MEASURES = ("euclidean", "cosine")
WINDOW_RANGE = (2, 5)
S_RANGE = (0.5, 5.0)

Score = Callable[[DataFrame], float]
Model = ClusterModel | CentreModel


@dataclass(frozen=True)
class Trial:
    k: int
    distance_measure: str
    window_size: int
    s: float


@dataclass(frozen=True)
class SearchResult:
    """``trials``: every trial with its score, in order. ``best``: the first trial with the highest score, with its
    ``model``; both None if no trial could be scored. ``clustered``: the URLs under the best model."""

    trials: DataFrame
    best: Trial | None
    best_score: float | None
    model: Model | None
    clustered: DataFrame | None


def random_trials(n: int, seed: int = 1) -> list[Trial]:
    """``n`` trials drawn from the ranges above; the same seed gives the same trials."""
    draw = random.Random(seed)
    return [
        Trial(draw.randint(*K_RANGE), draw.choice(DISTANCE_MEASURES), draw.randint(*WINDOW_RANGE), draw.uniform(*S_RANGE))
        for _ in range(n)
    ]


def grid_trials(ks: Iterable[int], distance_measures: Iterable[str], window_sizes: Iterable[int],
                ss: Iterable[float]) -> list[Trial]:
    """Every combination of the given values."""
    return [Trial(k, distance, window, s) for window, s, k, distance in product(window_sizes, ss, ks, distance_measures)]


def _has_two_clusters(clustered: DataFrame) -> bool:
    return clustered.select("cluster_id").distinct().limit(2).count() == 2


def _clusterable(features: DataFrame, trial: Trial) -> DataFrame:
    return without_zero_vectors(features) if trial.distance_measure == "cosine" else features


def run_trial(features: DataFrame, trial: Trial, algorithm: str, score: Score | None = None, *, max_iter: int = MAX_ITER, seed: int = 1,
              weight: str | None = None) -> tuple[float | None, ClusterModel | None]:
    """Fit and score one trial on its (cached) features. Under cosine distance rows with a zero vector are in no cluster. No
    score if no row is left or, without a score function, only one cluster came out.

    :param weight: column that tells for how many equal rows each row of ``features`` stands.
    """
    features = _clusterable(features, trial)
    if not features.limit(1).count():
        return None, None
    model = fit_clusters(features, trial.k, trial.distance_measure, algorithm=algorithm, max_iter=max_iter, seed=seed, weight=weight)
    clustered = assign_clusters(model, features)
    if score is not None:
        return score(clustered), model
    if weight is not None:
        value = silhouette_of(clustered, trial.distance_measure, weight)
        return value, None if value is None else model
    if not _has_two_clusters(clustered):
        return None, None
    return silhouette(clustered, trial.distance_measure), model


@dataclass(frozen=True)
class Outcome:
    score: float | None
    model: Model | None


class Ledger:
    """Finished trials of a search in a Parquet folder: one row each, appended when a feature set is done, so that a search which was stopped
    scores only what is left. Rows are found again by the parameters of the trial and by ``run``, which names inputs, algorithm and seed."""

    SCHEMA = ("run string, k int, distance_measure string, window_size int, s double, score double, "
              "centres array<array<double>>")

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run

    def finished(self) -> dict[Trial, Outcome]:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("run") == self.run).collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {
            Trial(row["k"], row["distance_measure"], row["window_size"], row["s"]):
                Outcome(row["score"], CentreModel(np.array(row["centres"]), row["distance_measure"]) if row["centres"] else None)
            for row in rows
        }

    def append(self, outcomes: dict[Trial, Outcome]) -> None:
        rows = [
            (self.run, trial.k, trial.distance_measure, trial.window_size, trial.s, outcome.score,
             [list(map(float, c)) for c in outcome.model.centres] if isinstance(outcome.model, CentreModel) else None)
            for trial, outcome in outcomes.items()
        ]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def _fingerprint(df: DataFrame, *columns: Column | str) -> str:
    """Of the rows of a table, in any order; equal rows count."""
    hashed = F.xxhash64(*columns).cast("decimal(20,0)")
    return str(tuple(df.agg(F.count(F.lit(1)), F.sum(hashed), F.sum(F.pmod(hashed * hashed, F.lit(1_000_000_007)))).first()))


def _run_name(patterns: DataFrame, vectors_of: Callable[[int], DataFrame], trials: Sequence[Trial], *settings) -> str:
    sizes = sorted({trial.window_size for trial in trials})
    parts = [_fingerprint(patterns, "pattern", "urls"), *settings]
    return sha256(repr(parts).encode()).hexdigest() + "".join(
        f" {size}:{sha256(_fingerprint(vectors_of(size), 'word', vector_to_array('vector')).encode()).hexdigest()[:16]}" for size in sizes)


def search_clusters(ranked: DataFrame, vectors_of: Callable[[int], DataFrame], trials: Sequence[Trial], *,
                    algorithm: str = "kmeans", score: Score | None = None,
                    weight: PositionWeight | PythonWeight | None = None, max_iter: int = MAX_ITER, seed: int = 1,
                    parallelism: int = 1, ledger: str | None = None) -> SearchResult:
    """Run all trials and keep the best.

    :param vectors_of: the word vectors of a window size, e.g. a table read from a store.
    :param score: score of a clustered DataFrame, higher is better; by default the silhouette under the distance
        measure of the trial, so scores of different measures are compared as they are.
    :param parallelism: feature sets worked on at a time. The URLs are reduced to weighted patterns of terms once; the means of each
        feature set are cached while its trials run, and trials with equal ``window_size`` and ``s`` share them. All its
        K-means trials advance together. The word vectors of one window size at a time are shared by its feature sets.
    :param ledger: folder in which finished trials are kept. A search over the same tables with the same algorithm, seed and iterations
        takes their scores from there. Functions cannot be compared: use one folder for each ``score`` and ``weight``.
    """
    spark = ranked.sparkSession
    patterns = cut_lineage(term_patterns(ranked))
    book = None if ledger is None else Ledger(spark, ledger, _run_name(patterns, vectors_of, trials, algorithm, seed, max_iter))
    done = {} if book is None else book.finished()
    lock = Lock()
    # The clusters of the best trial that has been run, by pattern.
    kept: dict[Trial, DataFrame] = {}
    places = {t: at for at, t in reversed(list(enumerate(trials)))}

    def first_best(candidates: Iterable[Trial]) -> Trial | None:
        """The first trial with the highest score."""
        scored = [t for t in sorted(set(candidates), key=places.__getitem__) if done[t].score is not None and done[t].score == done[t].score]
        return max(scored, key=lambda t: done[t].score, default=None)

    def of_urls(clustered: DataFrame) -> float:
        return score(to_urls(ranked, clustered, ["split_url", "coefficients", "vector", "cluster_id"]))

    def run_group(shared: SharedVectors | DataFrame, group: list[Trial]) -> None:
        means = pattern_means(patterns, shared, group[0].s, weight).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            features = standardize(means, weight="urls")
            if algorithm == "kmeans":
                models = fit_many(features, [Fit(t.k, t.distance_measure, seed) for t in group], weight="urls", max_iter=max_iter)
                values = silhouettes(features, models, weight="urls") if score is None else [
                    of_urls(assign_clusters(m, _clusterable(features, t))) if m else None for t, m in zip(group, models)]
                found = {t: Outcome(value, model) for t, value, model in zip(group, values, models)}
            else:
                found = {t: Outcome(*run_trial(features, t, algorithm, score and of_urls, max_iter=max_iter, seed=seed, weight="urls")) for t in group}
            with lock:
                done.update(found)
                if book is not None:
                    book.append(found)
                best = first_best([*found, *kept])
                if best is not None and best not in kept:
                    clustered = cut_lineage(assign_clusters(found[best].model, _clusterable(features, best)).select("pattern", "cluster_id", "vector"))
                    kept.clear()
                    kept[best] = clustered
        finally:
            means.unpersist()

    left = sorted({t for t in trials if t not in done}, key=lambda t: (t.window_size, t.s, t.k, t.distance_measure))
    for window_size, of_window in groupby(left, key=lambda t: t.window_size):
        groups = [list(group) for _, group in groupby(list(of_window), key=lambda t: t.s)]
        with _shared(vectors_of(window_size)) as shared:
            if parallelism > 1:
                with ThreadPool(parallelism) as pool:
                    pool.starmap(inheritable_thread_target(spark)(run_group), [(shared, group) for group in groups])
            else:
                for group in groups:
                    run_group(shared, group)
    rows = [(at, algorithm, t.k, t.distance_measure, t.window_size, t.s, done[t].score) for at, t in enumerate(trials, 1)]
    table = spark.createDataFrame(
        rows, "trial int, algorithm string, k int, distance_measure string, window_size int, s double, score double"
    )
    best = first_best(trials)
    if best is None:
        return SearchResult(table, None, None, None, None)
    model = done[best].model
    if best not in kept:  # finished by an earlier search, which has left its centres at most
        with _shared(vectors_of(best.window_size)) as shared:
            features = cut_lineage(_clusterable(pattern_features(patterns, shared, best.s, weight), best))
        model = model or fit_clusters(features, best.k, best.distance_measure, algorithm=algorithm, max_iter=max_iter, seed=seed, weight="urls")
        kept[best] = assign_clusters(model, features)
    clustered = cut_lineage(to_urls(ranked, kept[best], ["cluster_id", "vector"]))
    return SearchResult(table, best, done[best].score, model, clustered)


@contextmanager
def _shared(vectors: DataFrame) -> Iterator[SharedVectors | DataFrame]:
    shared = share_vectors(vectors)
    try:
        yield shared or vectors
    finally:
        if shared is not None:
            shared.destroy()

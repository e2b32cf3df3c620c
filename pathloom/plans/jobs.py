"""The steps as jobs over stored tables, in the order in which they are run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from pathloom.functions.url import TermSorter
from pathloom.functions.weights import PositionWeight, PythonWeight
from pathloom.operators import coordinates, scores, terms, timing, vocabulary, word_vectors
from pathloom.operators.features import url_features
from pathloom.operators.patterns import cluster_urls_by_pattern
from pathloom.plans.search import Score, SearchResult, Trial, random_trials, search_clusters
from pathloom.schemas import REJECTS
from pathloom.sources.tables import UrlStore, VersionedTable, quarantine, read_labels, read_urls, require_unique_ids

Weight = PositionWeight | PythonWeight | None


def split_urls(spark: SparkSession, store: UrlStore, urls_csv: str, term_sorter: TermSorter | None = None, *, rejects: str | None = None) -> None:
    """Read the URL file, check that no id repeats, and store its terms.

    :param rejects: folder for rows that cannot be used, ``file, line, reason`` (see :func:`pathloom.sources.tables.quarantine`). The others are
        stored then, and rows that repeat an id are no error.
    """
    if rejects is not None:
        found = quarantine(spark, urls_csv)
        VersionedTable(spark, rejects, REJECTS).write(found.rejects)
        store.write_split_urls(terms.split_urls(found.rows, term_sorter))
        return
    store.write_split_urls(terms.split_urls(require_unique_ids(read_urls(spark, urls_csv)), term_sorter))


def rank_terms(spark: SparkSession, store: UrlStore, min_count: int = vocabulary.MIN_COUNT,
               max_ratio: float = vocabulary.MAX_RATIO, *, unique_ids: bool = True) -> int:
    """Count, prune and rank the stored terms. Returns how many URLs kept no word and are therefore left out.

    :param unique_ids: that no id repeats, as :func:`split_urls` has checked; otherwise copies are removed.
    """
    split = store.read_split_urls(spark)
    store.write_ranked_urls(vocabulary.rank_terms(split, min_count, max_ratio, unique_ids=unique_ids))
    return vocabulary.dropped_urls(split, store.read_ranked_urls(spark)).count()


def train_word_vectors(spark: SparkSession, store: UrlStore, window_sizes: Iterable[int] = word_vectors.WINDOW_SIZES,
                       vector_size: int = word_vectors.VECTOR_SIZE, **training) -> None:
    """Train and store word vectors for each window size."""
    corpus = store.read_ranked_urls(spark).select("split_url").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for size in window_sizes:
            store.write_word_vectors(word_vectors.word_vectors(corpus, size, vector_size, **training), size)
    finally:
        corpus.unpersist()


def stored_features(spark: SparkSession, store: UrlStore, window_size: int, s: float, weight: Weight = None) -> DataFrame:
    """Features of the stored ranked URLs under the stored word vectors of ``window_size``."""
    return url_features(store.read_ranked_urls(spark), store.read_word_vectors(spark, window_size), s, weight)


def cluster_urls(spark: SparkSession, store: UrlStore, k: int, distance_measure: str, s: float, window_size: int,
                 weight: Weight = None, *, algorithm: str = "kmeans", **fitting) -> None:
    """Cluster the stored URLs with given parameters and store the result under the algorithm's name. The fit sees each pattern of terms once,
    as heavy as its URLs are many."""
    clustered = cluster_urls_by_pattern(store.read_ranked_urls(spark), store.read_word_vectors(spark, window_size), s, k, distance_measure, weight,
                                        algorithm=algorithm, **fitting)
    store.write_clustered_urls(clustered, algorithm)


def search_clusters_stored(spark: SparkSession, store: UrlStore, trials: Sequence[Trial] | int, weight: Weight = None, *,
                           algorithm: str = "kmeans", score: Score | None = None, seed: int = 1,
                           **search) -> SearchResult:
    """Search over the stored tables and store the best clustering.

    :param trials: the trials, or how many to draw at random.
    """
    drawn = random_trials(trials, seed) if isinstance(trials, int) else trials
    result = search_clusters(store.read_ranked_urls(spark), lambda size: store.read_word_vectors(spark, size), drawn,
                             algorithm=algorithm, score=score, weight=weight, seed=seed, **search)
    if result.clustered is not None:
        store.write_clustered_urls(result.clustered, algorithm)
    return result


def evaluate_clusters(spark: SparkSession, store: UrlStore, labels_csv: str, algorithm: str = "kmeans") -> DataFrame:
    """One row of V-measure scores of the stored clusters against a label file."""
    return scores.evaluate_clusters(store.read_clustered_urls(spark, algorithm), read_labels(spark, labels_csv))


def plane_coordinates(spark: SparkSession, store: UrlStore, labels_csv: str, algorithm: str = "kmeans") -> DataFrame:
    """Two-dimensional coordinates of the stored clusters that have a label."""
    clustered, labels = store.read_clustered_urls(spark, algorithm), read_labels(spark, labels_csv)
    return coordinates.plane_coordinates(coordinates.attach_labels(clustered, labels))


def profile_clusters(spark: SparkSession, store: UrlStore, k: int = 10, distance_measure: str = "euclidean",
                     s: float = 3.0, window_size: int = 5, *, algorithm: str = "kmeans", runs: int = 10,
                     **fitting) -> DataFrame:
    """Time ``runs`` fits over the stored tables and summarize them."""
    features = stored_features(spark, store, window_size, s)
    timings = timing.profile_fit(features, k, distance_measure, algorithm=algorithm, runs=runs, **fitting)
    return timing.timing_summary(timings)

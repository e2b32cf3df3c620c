"""URLs by the pattern of their terms.

Once rare terms are pruned, many URLs of a site have the same terms with the same ranks, and all of them have one vector. A pattern is such a
pair of arrays, weighted by the number of its URLs. Means, deviations, fits and scores over weighted patterns are those over the URLs, at a cost
that follows the number of patterns; only the join at the end sees every URL, and it carries no vector through a shuffle if the patterns fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.weights import PositionWeight, PythonWeight
from pathloom.operators.clustering import ClusterModel, assign_clusters, fit_clusters, without_zero_vectors
from pathloom.operators.features import SharedVectors, standardize, url_means
from pathloom.scale import BROADCAST_BYTES, HOT_KEYS, cut_lineage, join_skewed


def _pattern() -> Column:
    return F.struct("split_url", "word_frequency_orders")


def term_patterns(ranked: DataFrame) -> DataFrame:
    """``pattern, urls``: the different ``struct<split_url, word_frequency_orders>`` of a ranked table and how many rows have each.
    Combined on the map side; rows that repeat count each."""
    return ranked.groupBy(_pattern().alias("pattern")).agg(F.count(F.lit(1)).alias("urls"))


def pattern_means(patterns: DataFrame, vectors: DataFrame | SharedVectors, s: float, weight: PositionWeight | PythonWeight | None = None,
                  **bounds) -> DataFrame:
    """``pattern, urls, split_url, coefficients, vector``: the mean vector of every pattern, as
    :func:`pathloom.operators.features.url_means` has it for each of its URLs. ``split_url`` holds the terms that have a vector."""
    rows = patterns.select(F.struct("pattern", "urls").alias("id"), F.lit("").alias("url"), "pattern.*")
    return url_means(rows, vectors, s, weight, **bounds).select("id.pattern", "id.urls", "split_url", "coefficients", "vector")


def pattern_features(patterns: DataFrame, vectors: DataFrame | SharedVectors, s: float, weight: PositionWeight | PythonWeight | None = None,
                     **bounds) -> DataFrame:
    """:func:`pattern_means`, standardized by the deviations over all URLs."""
    return standardize(cut_lineage(pattern_means(patterns, vectors, s, weight, **bounds)), weight="urls")


def to_urls(ranked: DataFrame, by_pattern: DataFrame, columns: list[str], *, hot_keys: int = HOT_KEYS,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id, url`` and ``columns`` of ``by_pattern`` for every row of ``ranked`` whose pattern it has.

    Patterns within ``broadcast_bytes`` are broadcast and the URLs stay where they are. Of more, the ``hot_keys`` most frequent are broadcast, so
    that no pattern that many URLs share is shuffled.
    """
    keyed = ranked.select("id", "url", _pattern().alias("pattern"))
    width = F.octet_length(F.to_json(F.struct(*[c for c in columns if c != "vector"]))) if set(columns) != {"vector"} else F.lit(0)
    values = by_pattern.select("pattern", *columns)
    if "vector" in columns:
        width = width + F.lit(16) + 8 * _vector_size(values)
    return join_skewed(keyed, values, "pattern", payload=width, hot_keys=hot_keys, broadcast_bytes=broadcast_bytes).select("id", "url", *columns)


def _vector_size(values: DataFrame) -> int:
    first = values.select("vector").first()
    return 0 if first is None else len(first["vector"])


def features_by_pattern(ranked: DataFrame, vectors: DataFrame | SharedVectors, s: float,
                        weight: PositionWeight | PythonWeight | None = None, **bounds) -> DataFrame:
    """The rows of :func:`pathloom.operators.features.url_features`, computed once per pattern."""
    table = pattern_features(term_patterns(ranked), vectors, s, weight, **bounds)
    return to_urls(ranked, table, ["split_url", "coefficients", "vector"])


def cluster_patterns(features: DataFrame, k: int, distance_measure: str = "euclidean", **fitting) -> tuple[ClusterModel, DataFrame]:
    """Fit on weighted patterns and assign them: the model, and ``features`` with ``cluster_id``. Under cosine distance patterns with a zero
    vector are in no cluster."""
    features = without_zero_vectors(features) if distance_measure == "cosine" else features
    model = fit_clusters(features, k, distance_measure, weight="urls", **fitting)
    return model, assign_clusters(model, features)


def cluster_urls_by_pattern(ranked: DataFrame, vectors: DataFrame | SharedVectors, s: float, k: int, distance_measure: str = "euclidean",
                            weight: PositionWeight | PythonWeight | None = None, **fitting) -> DataFrame:
    """``id, url, cluster_id, vector`` of the rows of ``ranked``: patterns are clustered, each as heavy as its URLs are many, and every URL is in
    the cluster of its pattern."""
    features = cut_lineage(pattern_features(term_patterns(ranked), vectors, s, weight))
    clustered = cluster_patterns(features, k, distance_measure, **fitting)[1]
    return to_urls(ranked, clustered, ["cluster_id", "vector"])

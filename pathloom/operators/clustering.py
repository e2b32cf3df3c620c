"""K-means and bisecting K-means over URL vectors."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel, KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from pathloom.functions.vectors import is_zero

ESTIMATORS = {"kmeans": KMeans, "bisecting_kmeans": BisectingKMeans}
MAX_ITER = 20

ClusterModel = KMeansModel | BisectingKMeansModel


def fit_clusters(features: DataFrame, k: int, distance_measure: str = "euclidean", *, algorithm: str = "kmeans",
                 max_iter: int = MAX_ITER, seed: int = 1, weight: str | None = None) -> ClusterModel:
    """Fit ``algorithm`` (``kmeans`` or ``bisecting_kmeans``) on ``vector``; predictions go to ``cluster_id``.

    With ``cosine`` no vector may be all zeros; Spark refuses such rows (:func:`without_zero_vectors` leaves them out). The
    column ``weight`` tells for how many equal rows each row stands.
    """
    estimator = ESTIMATORS[algorithm](k=k, distanceMeasure=distance_measure, maxIter=max_iter, seed=seed,
                                      featuresCol="vector", predictionCol="cluster_id", **({"weightCol": weight} if weight else {}))
    return estimator.fit(features)


def assign_clusters(model: ClusterModel, features: DataFrame) -> DataFrame:
    """Add ``cluster_id``. Stateless: works on streaming DataFrames too. Models of :mod:`pathloom.operators.many_fits` do as well."""
    return model.transform(features)


def without_zero_vectors(features: DataFrame) -> DataFrame:
    """The rows that have a direction, so that cosine distances to them exist."""
    return features.where(~is_zero(vector_to_array("vector")))


def cluster_urls(features: DataFrame, k: int, distance_measure: str = "euclidean", **fitting) -> DataFrame:
    """Fit and assign: ``id, url, cluster_id, vector``. Under cosine distance rows with a zero vector are in no cluster."""
    features = without_zero_vectors(features) if distance_measure == "cosine" else features
    model = fit_clusters(features, k, distance_measure, **fitting)
    return assign_clusters(model, features).select("id", "url", "cluster_id", "vector")

"""Repeated timings of a cluster fit, and their summary."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.clustering import assign_clusters, fit_clusters


def profile_fit(features: DataFrame, k: int, distance_measure: str = "euclidean", *, algorithm: str = "kmeans",
                runs: int = 10, **fitting) -> DataFrame:
    """``algorithm, n_rows, run, millis``: times of fitting, assigning and counting, over cached features."""
    cached = features.persist(StorageLevel.MEMORY_AND_DISK)
    timings = []
    try:
        n_rows = cached.count()
        for run in range(1, runs + 1):
            start = time.perf_counter()
            model = fit_clusters(cached, k, distance_measure, algorithm=algorithm, **fitting)
            assign_clusters(model, cached).count()
            timings.append((algorithm, n_rows, run, int((time.perf_counter() - start) * 1000)))
    finally:
        cached.unpersist()
    return features.sparkSession.createDataFrame(timings, "algorithm string, n_rows long, run int, millis long")


def timing_summary(timings: DataFrame) -> DataFrame:
    """Mean and sample standard deviation per ``algorithm, n_rows``; the deviation of a single run is null."""
    return timings.groupBy("algorithm", "n_rows").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("millis").alias("mean_millis"),
        F.stddev_samp("millis").alias("std_millis"),
    )

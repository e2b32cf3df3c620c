"""Labelled two-dimensional coordinates of clustered URLs, ready to plot."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.scale import BROADCAST_BYTES, fits_broadcast


def attach_labels(clusters: DataFrame, labels: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Clustered URLs that have a label, with ``label``. Ids are unique on both sides, so no key is hot."""
    few = fits_broadcast(labels, "id", F.coalesce(F.octet_length("label"), F.lit(0)), broadcast_bytes)
    labelled = labels.select("id", "label")
    return clusters.join(F.broadcast(labelled) if few else labelled, "id")


def plane_coordinates(labelled: DataFrame) -> DataFrame:
    """``x, y, id, url, label, cluster_id``: the first two principal components of ``vector``.

    The sign of a component is arbitrary; here its largest loading is positive.
    """
    model = PCA(k=2, inputCol="vector", outputCol="_plane").fit(labelled.select("vector"))
    loadings = model.pc.toArray()
    largest = loadings[np.abs(loadings).argmax(axis=0), [0, 1]]
    x_sign, y_sign = (1.0 if loading >= 0 else -1.0 for loading in largest)
    plane = model.transform(labelled).withColumn("_plane", vector_to_array("_plane"))
    return plane.select(
        (F.col("_plane")[0] * x_sign).alias("x"), (F.col("_plane")[1] * y_sign).alias("y"),
        "id", "url", "label", "cluster_id",
    )

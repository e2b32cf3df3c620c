"""Distances between a vector column and a few fixed centres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two ``array<double>``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine of two ``array<double>``; null if one of them has length zero."""
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


DISTANCES = {"euclidean": squared_distance, "cosine": cosine_distance}


def nearest_centre(vector: Column, centres: Column, distance_measure: str = "euclidean") -> Column:
    """``cluster_id`` of the nearest of ``centres``, the lower id on equal distance.

    :param centres: ``array<struct<cluster_id, centre: array<double>>>``, one entry per cluster.
    """
    distance = DISTANCES[distance_measure]
    candidates = F.transform(
        centres,
        lambda c: F.struct(distance(vector, c["centre"]).alias("distance"), c["cluster_id"].alias("cluster_id")),
    )
    return F.array_min(candidates)["cluster_id"]


def is_zero(vector: Column) -> Column:
    """Whether every component of an ``array<double>`` is zero."""
    return F.forall(vector, lambda x: x == 0)

"""Scores of a clustering: silhouette without labels, V-measure against labels."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.scale import BROADCAST_BYTES, fits_broadcast, join_skewed, number_rows


def silhouette(clustered: DataFrame, distance_measure: str = "euclidean") -> float:
    """Mean silhouette over ``cluster_id`` and ``vector``; ``euclidean`` means its square. Needs two clusters or more.

    Spark ML works from per-cluster sums, so the cost is linear in the rows.
    """
    measure = "squaredEuclidean" if distance_measure == "euclidean" else distance_measure
    evaluator = ClusteringEvaluator(predictionCol="cluster_id", featuresCol="vector", distanceMeasure=measure)
    return evaluator.evaluate(clustered.select("cluster_id", "vector"))


def align_labels(labels: DataFrame, clusters: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id, label, cluster_id`` of every labelled id; -1 where it is in no cluster.

    Labels are usually few: then the clusters are first narrowed to the labelled ids by a broadcast, so that the large
    side is not shuffled.
    """
    assigned = clusters.select("id", "cluster_id")
    if fits_broadcast(labels, "id", limit=broadcast_bytes):
        assigned = assigned.join(F.broadcast(labels.select("id")), "id", "left_semi")
    aligned = labels.select("id", "label").join(assigned, "id", "left")
    return aligned.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def encode_labels(aligned: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``label_id``: labels numbered from 1 in the order of their first id; null is a label like any other."""
    first_seen = aligned.groupBy("label").agg(F.min("id").alias("_first"))
    codes = number_rows(first_seen, [F.asc("_first"), F.asc("label")], "label_id").select("label", "label_id")
    named = join_skewed(aligned.where("label is not null"), codes.where("label is not null"), "label", broadcast_bytes=broadcast_bytes)
    of_null = codes.where("label is null").agg(F.max("label_id")).scalar()
    return named.unionByName(aligned.where("label is null").withColumn("label_id", of_null))


def v_measure(assigned: DataFrame, label: str = "label", cluster: str = "cluster_id") -> DataFrame:
    """One row ``homogeneity, completeness, v_measure`` of a labelled clustering.

    From the contingency table and its two margins, all by combinable sums: with ``f = n ln n``, entropies of counts are
    ``ln N - sum(f) / N`` and the mutual information is the two margin entropies less the joint one. A single label is
    homogeneous, a single cluster complete, and V is 0 if both scores are 0.
    """
    pairs = assigned.groupBy(F.col(label).alias("_label"), F.col(cluster).alias("_cluster")).agg(
        F.count(F.lit(1)).alias("_pairs")
    )
    # 0: a cell of the table, 1: a label margin, 2: a cluster margin.
    counts = pairs.groupingSets([["_label", "_cluster"], ["_label"], ["_cluster"]], "_label", "_cluster").agg(
        F.sum("_pairs").alias("_n"), F.grouping_id().alias("_margin")
    )
    n, margin = F.col("_n").cast("double"), F.col("_margin")
    sums = counts.agg(
        F.sum(F.when(margin == 0, n)).alias("rows"),
        F.count(F.when(margin == 1, n)).alias("labels"),
        F.count(F.when(margin == 2, n)).alias("clusters"),
        *[F.sum(F.when(margin == i, n * F.ln(n))).alias(name) for i, name in enumerate(["joint", "by_label", "by_cluster"])],
    )
    entropy = {name: F.ln("rows") - F.col(name) / F.col("rows") for name in ["joint", "by_label", "by_cluster"]}
    information = F.greatest(entropy["by_label"] + entropy["by_cluster"] - entropy["joint"], F.lit(0.0))
    homogeneity = F.when(F.col("labels") <= 1, 1.0).otherwise(F.try_divide(information, entropy["by_label"]))
    completeness = F.when(F.col("clusters") <= 1, 1.0).otherwise(F.try_divide(information, entropy["by_cluster"]))
    scores = sums.select(homogeneity.alias("homogeneity"), completeness.alias("completeness"))
    h, c = F.col("homogeneity"), F.col("completeness")
    return scores.withColumn("v_measure", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)))


def evaluate_clusters(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of V-measure scores of ``id, cluster_id`` against ``id, label``; unclustered ids count as cluster -1."""
    return v_measure(align_labels(labels, clusters))

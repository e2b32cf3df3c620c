import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from pathloom import evaluate_clusters, silhouette, v_measure
from pathloom.operators.scores import align_labels, encode_labels
from tests.plans import explained


def assigned(spark, labels, clusters):
    return spark.createDataFrame(list(zip(labels, clusters)), "label string, cluster_id int")


def scores_of(df):
    return tuple(v_measure(df).first())


@pytest.mark.parametrize(
    "labels, clusters, expected",
    [
        ("aabb", [1, 1, 0, 0], (1, 1, 1)),
        ("aabb", [0, 0, 0, 0], (0, 1, 0)),
        ("aabb", [0, 1, 2, 3], (1, 0.5, 2 / 3)),
        ("aaaa", [0, 1, 0, 1], (1, 0, 0)),
        ("aaaa", [2, 2, 2, 2], (1, 1, 1)),
        ("abab", [0, 0, 1, 1], (0, 0, 0)),
    ],
)
def test_v_measure_cases(spark, labels, clusters, expected):
    assert scores_of(assigned(spark, labels, clusters)) == pytest.approx(expected, abs=1e-12)


def test_v_measure_of_nothing(spark):
    assert scores_of(assigned(spark, "a", [1]).limit(0)) == (1, 1, 1)


def test_v_measure_matches_entropies_and_is_symmetric(spark):
    draw = random.Random(5)
    labels = [draw.choice("aaaaabcd") for _ in range(500)]
    clusters = [ord(label) % 3 if draw.random() < 0.6 else draw.randint(0, 5) for label in labels]

    def entropy(values):
        return -sum(n / len(values) * math.log(n / len(values)) for n in Counter(values).values())

    shared = entropy(labels) + entropy(clusters) - entropy(list(zip(labels, clusters)))
    h, c = shared / entropy(labels), shared / entropy(clusters)
    df = assigned(spark, labels, clusters)
    assert scores_of(df) == pytest.approx((h, c, 2 * h * c / (h + c)), abs=1e-12)
    swapped = v_measure(df, label="cluster_id", cluster="label").first()
    assert tuple(swapped) == pytest.approx((c, h, 2 * h * c / (h + c)), abs=1e-12)


def test_v_measure_combines_before_its_shuffles(spark):
    plan = explained(v_measure(assigned(spark, "ab", [0, 1])))
    assert plan.count("partial_count(1)") == 1 and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("broadcast_bytes", [0, 2**27])
def test_labels_meet_clusters(spark, broadcast_bytes):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, label string")
    clusters = spark.createDataFrame([(2, 5), (3, 6), (9, 7)], "id long, cluster_id int")
    rows = align_labels(labels, clusters, broadcast_bytes=broadcast_bytes).orderBy("id").collect()
    assert [(r.id, r.cluster_id) for r in rows] == [(1, -1), (2, 5), (3, 6), (4, -1)]


@pytest.mark.parametrize("broadcast_bytes", [0, 2**27])
def test_label_codes(spark, broadcast_bytes):
    aligned = spark.createDataFrame([(5, "x", 0), (2, "y", 0), (3, "x", 1), (9, "z", 0), (4, "y", 2)],
                                    "id long, label string, cluster_id int")
    rows = encode_labels(aligned, broadcast_bytes=broadcast_bytes).orderBy("id").collect()
    assert [(r.id, r.label_id) for r in rows] == [(2, 1), (3, 2), (4, 1), (5, 2), (9, 3)]


def test_evaluation(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id long, label string")
    clusters = spark.createDataFrame([(1, 0), (2, 0), (7, 4)], "id long, cluster_id int")
    assert evaluate_clusters(clusters, labels).first().v_measure == pytest.approx(1)


@pytest.mark.parametrize("measure", ["euclidean", "cosine"])
def test_silhouette_matches_pairwise_distances(spark, measure):
    draw = np.random.default_rng(2)
    points = draw.normal(size=(90, 4)) + np.repeat(np.eye(3, 4) * 3, 30, axis=0)
    clusters = np.repeat([0, 1, 2], 30)
    df = spark.createDataFrame([(int(c), Vectors.dense(p)) for c, p in zip(clusters, points)], ["cluster_id", "vector"])
    if measure == "euclidean":
        distance = ((points[:, None] - points[None]) ** 2).sum(-1)
    else:
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        distance = 1 - unit @ unit.T
    values = []
    for i in range(90):
        own = distance[i, clusters == clusters[i]].sum() / 29
        other = min(distance[i, clusters == c].mean() for c in range(3) if c != clusters[i])
        values.append((other - own) / max(own, other))
    assert silhouette(df, measure) == pytest.approx(np.mean(values), abs=1e-9)


def test_null_is_a_label_like_any_other(spark):
    aligned = spark.createDataFrame([(3, None, 0), (1, "b", 1), (4, None, 1), (2, "a", 1)], "id long, label string, cluster_id int")
    found = {r.id: r.label_id for r in encode_labels(aligned).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 3}
    assert {r.id: r.label_id for r in encode_labels(aligned, broadcast_bytes=0).collect()} == found

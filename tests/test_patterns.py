"""Patterns of terms stand for their URLs, and many fits in one pass for single ones."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors


from pathloom import url_features
from pathloom.operators import many_fits
from pathloom.operators.clustering import assign_clusters, cluster_urls
from pathloom.operators.features import standardize
from pathloom.operators.many_fits import Fit, advance_all, fit_many, points_of, silhouette_of, silhouettes, starting_centres
from pathloom.operators.patterns import cluster_urls_by_pattern, features_by_pattern, pattern_features, term_patterns, to_urls
from pathloom.operators.scores import silhouette
from tests.plans import explained

RANKED = "id long, url string, split_url array<string>, word_frequency_orders array<long>"


@pytest.fixture(scope="module")
def tables(spark):
    """600 URLs with 40 patterns, one of which holds a third of all; words 28 and 29 have no vector."""
    draw = random.Random(7)
    patterns = [draw.sample(range(30), draw.randint(1, 5)) for _ in range(38)] + [[28, 29], []]
    rows = []
    for i in range(600):
        pattern = patterns[0] if i % 3 == 0 else draw.choice(patterns)
        rows.append((i, f"u{i}", [f"w{t}" for t in pattern], [t + 1 for t in pattern]))
    vectors = [(f"w{t}", Vectors.dense([draw.gauss(0, 1) for _ in range(6)])) for t in range(28)]
    ranked = spark.createDataFrame(rows, RANKED).repartition(3).cache()
    return ranked, spark.createDataFrame(vectors, ["word", "vector"]).cache()


def rows_of(df):
    return {r["id"]: r for r in df.collect()}


def test_patterns_count_their_urls(tables):
    ranked, _ = tables
    counted = {tuple(r.pattern.split_url): r.urls for r in term_patterns(ranked).collect()}
    assert sum(counted.values()) == 600 and max(counted.values()) > 200 and len(counted) <= 40


@pytest.mark.parametrize("bounds", [{}, {"hot_keys": 4, "broadcast_bytes": 0}])
def test_features_are_those_of_the_urls(tables, bounds):
    ranked, vectors = tables
    mine, plain = rows_of(features_by_pattern(ranked, vectors, 1.3, **bounds)), rows_of(url_features(ranked, vectors, 1.3))
    assert mine.keys() == plain.keys()
    for i in plain:
        assert mine[i].split_url == plain[i].split_url and mine[i].url == plain[i].url
        assert np.allclose(mine[i].coefficients, plain[i].coefficients) and np.allclose(mine[i].vector.toArray(), plain[i].vector.toArray())


def test_weighted_standardize(spark):
    rows = [(Vectors.dense(1, 5, 2), 3), (Vectors.dense(3, 5, -1), 1), (Vectors.dense(0, 5, 4), 7)]
    weighted = standardize(spark.createDataFrame(rows, ["vector", "n"]), weight="n").collect()
    repeated = standardize(spark.createDataFrame([(v, n) for v, n in rows for _ in range(n)], ["vector", "n"])).distinct().collect()
    assert sorted(map(str, ([round(x, 9) for x in r.vector] for r in weighted))) == sorted(map(str, ([round(x, 9) for x in r.vector] for r in repeated)))
    one = standardize(spark.createDataFrame(rows[:1], ["vector", "n"]), weight="n").first()
    assert one.vector.toArray().tolist() == [0, 0, 0]


def test_patterns_reach_their_urls_without_a_shuffle(tables):
    ranked, vectors = tables
    table = pattern_features(term_patterns(ranked), vectors, 1.3).cache()
    plan = explained(to_urls(ranked, table, ["vector"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    split = to_urls(ranked, table, ["vector"], hot_keys=1, broadcast_bytes=0)
    assert rows_of(split) == rows_of(to_urls(ranked, table, ["vector"]))


@pytest.mark.parametrize("algorithm", ["kmeans", "bisecting_kmeans"])
def test_clusters_of_patterns(tables, algorithm):
    """URLs of a pattern are in one cluster, no URL is lost, and well separated patterns are clustered as their URLs are."""
    ranked, vectors = tables
    found = rows_of(cluster_urls_by_pattern(ranked, vectors, 1.3, 4, algorithm=algorithm))
    assert found.keys() == rows_of(url_features(ranked, vectors, 1.3)).keys()
    by_pattern = {}
    for r in ranked.collect():
        if r.id in found:
            by_pattern.setdefault(tuple(r.split_url), set()).add(found[r.id].cluster_id)
    assert all(len(clusters) == 1 for clusters in by_pattern.values()) and len({c for s in by_pattern.values() for c in s}) == 4


def lloyd(x, w, centres, measure, iterations):
    """One fit by itself, row by row."""
    if measure == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(iterations):
        own = [min(range(len(centres)), key=lambda c: (1 - v @ centres[c]) if measure == "cosine" else ((v - centres[c]) ** 2).sum()) for v in x]
        moved = []
        for c in range(len(centres)):
            members = [i for i, o in enumerate(own) if o == c]
            mean = sum(w[i] * x[i] for i in members) / w[members].sum() if members else centres[c]
            moved.append(mean / np.linalg.norm(mean) if measure == "cosine" else mean)
        centres = np.array(moved)
    return centres


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 5)) + 3 * np.repeat(np.eye(6, 5), 50, axis=0)
    w = draw.integers(1, 5, 300)
    df = spark.createDataFrame([(i, Vectors.dense(v), int(n)) for i, (v, n) in enumerate(zip(x, w))], ["id", "vector", "n"]).repartition(4).cache()
    return x, w, df


def test_many_fits_are_single_fits(points):
    x, w, df = points
    fits = [Fit(k, measure, seed) for k in (2, 5, 9) for measure in ("euclidean", "cosine") for seed in (1, 2)]
    table = points_of(df, "n")
    starts = starting_centres(table, fits)
    for fit, start, found in zip(fits, starts, advance_all(table, fits, starts, max_iter=6, tolerance=0.0)):
        assert len(start) == fit.k
        assert np.allclose(found, lloyd(x, w, start, fit.distance_measure, 6))


def test_centres_are_those_of_spark_from_the_same_start(spark, points):
    from pyspark.mllib.clustering import KMeans, KMeansModel

    x, _, df = points
    fits = [Fit(4), Fit(7, seed=5)]
    table = points_of(df)
    starts = starting_centres(table, fits)
    for fit, start, found in zip(fits, starts, advance_all(table, fits, starts, max_iter=20)):
        spark_model = KMeans.train(spark.sparkContext.parallelize(list(x), 2), fit.k, maxIterations=20, initialModel=KMeansModel(list(start)))
        assert np.allclose(found, spark_model.clusterCenters, atol=1e-3)


def test_one_job_an_iteration(points, monkeypatch):
    _, _, df = points
    passes = []
    summed = many_fits._summed
    monkeypatch.setattr(many_fits, "_summed", lambda *args: passes.append(1) or summed(*args))
    table = points_of(df)
    fits = [Fit(k, measure) for k in range(2, 12) for measure in ("euclidean", "cosine")]
    starts = starting_centres(table, fits)
    # Costs twice and weights once, for either measure.
    assert len(passes) <= 2 * (many_fits.INIT_STEPS + 1)
    passes.clear()
    advance_all(table, fits, starts, max_iter=5, tolerance=0.0)
    assert len(passes) == 5


@pytest.mark.parametrize("measure", ["euclidean", "cosine"])
def test_silhouettes_are_those_of_the_expanded_rows(spark, points, measure):
    x, w, df = points
    models = fit_many(df, [Fit(2, measure), Fit(6, measure)], weight="n")
    expanded = spark.createDataFrame([(Vectors.dense(v),) for v, n in zip(x, w) for _ in range(n)], ["vector"])
    for model, value in zip(models, silhouettes(df, models, weight="n")):
        assert value == pytest.approx(silhouette(assign_clusters(model, expanded), measure))
        assert silhouette_of(assign_clusters(model, df), measure, "n") == pytest.approx(value)


def test_odd_points(spark):
    df = spark.createDataFrame([(Vectors.dense(0, 0), 2), (Vectors.dense(1, 0), 1), (Vectors.dense(1, 0), 4), (Vectors.dense(0, 3), 1)], ["vector", "n"])
    models = fit_many(df, [Fit(5), Fit(5, "cosine"), Fit(1)], weight="n")
    # As many centres as rows differ; a zero vector has no direction.
    assert [len(m.centres) for m in models] == [3, 2, 1]
    values = silhouettes(df, models, weight="n")
    assert values[2] is None and values[1] is not None and values[0] == pytest.approx(7 / 8)
    assert fit_many(df.where("false"), [Fit(2)]) == [None] and silhouettes(df, [None]) == [None]
    assert fit_many(df.where(vector_to_array("vector")[0] + vector_to_array("vector")[1] == 0), [Fit(2, "cosine")]) == [None]


def test_fits_find_the_groups(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 4)) * 0.1 + np.repeat(np.eye(4) * 4, 50, axis=0)
    df = spark.createDataFrame([(i, f"u{i}", Vectors.dense(v)) for i, v in enumerate(x)], ["id", "url", "vector"]).repartition(3)
    for model in fit_many(df, [Fit(4, "euclidean", s) for s in range(5)] + [Fit(4, "cosine", s) for s in range(5)]):
        clusters = [r.cluster_id for r in assign_clusters(model, df).orderBy("id").collect()]
        assert len(set(clusters)) == 4 and all(len(set(clusters[i:i + 50])) == 1 for i in range(0, 200, 50))
    assert len({r.cluster_id for r in cluster_urls(df, 4).collect()}) == 4

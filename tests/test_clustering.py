import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pathloom import assign_clusters, attach_labels, cluster_urls, fit_clusters, plane_coordinates, profile_fit, timing_summary
from pathloom.functions.vectors import nearest_centre


@pytest.fixture(scope="module")
def features(spark):
    draw = np.random.default_rng(1)
    points = draw.normal(size=(120, 5)) * 0.3 + np.repeat(np.eye(4, 5) * 4, 30, axis=0)
    rows = [(i, f"u{i}", Vectors.dense(p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, ["id", "url", "vector"]).coalesce(1).cache()
    df.count()
    yield df
    df.unpersist()


@pytest.mark.parametrize("algorithm", ["kmeans", "bisecting_kmeans"])
@pytest.mark.parametrize("distance_measure", ["euclidean", "cosine"])
def test_clusters_are_repeatable_and_find_the_groups(features, algorithm, distance_measure):
    runs = [cluster_urls(features, 4, distance_measure, algorithm=algorithm, seed=3).orderBy("id").collect() for _ in "ab"]
    assert runs[0] == runs[1]
    clusters = [r.cluster_id for r in runs[0]]
    assert len(set(clusters)) == 4
    assert all(len(set(clusters[i : i + 30])) == 1 for i in range(0, 120, 30))


@pytest.mark.parametrize("distance_measure", ["euclidean", "cosine"])
def test_every_url_is_in_its_nearest_cluster(features, distance_measure):
    model = fit_clusters(features, 7, distance_measure)
    centres = F.array(*[
        F.struct(F.lit(i).alias("cluster_id"), F.array(*map(F.lit, map(float, c))).alias("centre"))
        for i, c in enumerate(model.clusterCenters())
    ])
    nearest = nearest_centre(vector_to_array("vector"), centres, distance_measure)
    assert assign_clusters(model, features).where(F.col("cluster_id") != nearest).count() == 0


def test_cosine_refuses_zero_vectors(spark):
    rows = spark.createDataFrame([(i, "u", Vectors.dense(i % 2, 0.0)) for i in range(6)], ["id", "url", "vector"])
    with pytest.raises(Exception, match="zero-length"):
        fit_clusters(rows, 2, "cosine")


def test_assigning_works_on_a_stream(spark, features, tmp_path):
    model = fit_clusters(features, 4)
    features.write.parquet(str(tmp_path / "in"))
    stream = assign_clusters(model, spark.readStream.schema(features.schema).parquet(str(tmp_path / "in")))
    query = (
        stream.select("id", "cluster_id").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120


def test_coordinates(spark, features):
    labels = spark.range(100).select("id", F.concat(F.lit("l"), F.floor(F.col("id") / 30)).alias("label"))
    clustered = cluster_urls(features, 4)
    rows = plane_coordinates(attach_labels(clustered, labels)).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(100))
    assert rows[0].asDict().keys() == {"x", "y", "id", "url", "label", "cluster_id"}
    points = np.array([r.vector.toArray() for r in features.orderBy("id").limit(100).collect()])
    values, axes = np.linalg.eigh(np.cov(points.T))
    axes = axes[:, ::-1][:, :2]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose([(r.x, r.y) for r in rows], points @ axes)


@pytest.mark.parametrize("algorithm", ["kmeans", "bisecting_kmeans"])
def test_timings(features, algorithm):
    timings = profile_fit(features, 3, algorithm=algorithm, runs=2)
    rows = timings.collect()
    assert [(r.algorithm, r.n_rows, r.run) for r in rows] == [(algorithm, 120, 1), (algorithm, 120, 2)]
    summary = timing_summary(timings).first()
    assert summary.mean_millis == np.mean([r.millis for r in rows])
    assert summary.std_millis == pytest.approx(np.std([r.millis for r in rows], ddof=1))


def test_one_timing_has_no_deviation(spark):
    timings = spark.createDataFrame([("kmeans", 5, 1, 7)], "algorithm string, n_rows long, run int, millis long")
    assert tuple(timing_summary(timings).first()) == ("kmeans", 5, 1, 7.0, None)

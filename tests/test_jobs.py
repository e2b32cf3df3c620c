import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pathloom import Trial, UrlStore, cluster_urls, grid_trials, random_trials, read_labels, read_urls, word_vectors
from pathloom.operators.features import share_vectors
from pathloom.plans import jobs
from pathloom.plans import search as search_module
from pathloom.plans.search import run_trial
from pathloom.schemas import REJECTS
from pathloom.sources.tables import VersionedTable, quarantine, require_unique_ids


def test_csv_sources(spark, tmp_path):
    (tmp_path / "urls.csv").write_text('id,url\n1,http://a.b.c/d\n2,"http://a.b.c/d,e"\nx,http://z\n')
    (tmp_path / "labels.csv").write_text("id,label\n1,home\n2,3\n")
    urls = read_urls(spark, str(tmp_path / "urls.csv"))
    assert urls.dtypes == [("id", "bigint"), ("url", "string")]
    assert [tuple(r) for r in urls.collect()] == [(1, "http://a.b.c/d"), (2, "http://a.b.c/d,e"), (None, "http://z")]
    assert len(read_urls(spark, str(tmp_path / "urls.csv"), "DROPMALFORMED").collect()) == 2
    marked = read_urls(spark, str(tmp_path / "urls.csv"), corrupt_column="bad")
    assert [r.bad for r in marked.collect()] == [None, None, "x,http://z"]
    assert [tuple(r) for r in read_labels(spark, str(tmp_path / "labels.csv")).collect()] == [(1, "home"), (2, "3")]


def test_unique_ids(spark):
    urls = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "id long, url string")
    with pytest.raises(ValueError, match="id 1 has 2 rows"):
        require_unique_ids(urls)
    assert require_unique_ids(urls.where("url <> 'c'")).count() == 2


def test_slices_are_replaced_one_by_one(spark, tmp_path):
    store = UrlStore(str(tmp_path))
    table = spark.createDataFrame([("w", Vectors.dense(1.0))], ["word", "vector"])
    store.write_word_vectors(table, 2)
    store.write_word_vectors(table.union(table), 3)
    store.write_word_vectors(table.limit(1), 3)
    assert store.read_word_vectors(spark, 2).count() == 1
    assert store.read_word_vectors(spark, 3).collect() == table.collect()
    clusters = spark.createDataFrame([(1, "u", 0)], "id long, url string, cluster_id int")
    store.write_clustered_urls(clusters, "kmeans")
    store.write_clustered_urls(clusters.withColumn("cluster_id", F.lit(4)), "bisecting_kmeans")
    assert store.read_clustered_urls(spark, "kmeans").drop("vector").collect() == clusters.collect()
    assert store.read_clustered_urls(spark, "bisecting_kmeans").first().cluster_id == 4


def test_random_trials():
    trials = random_trials(200, seed=4)
    assert trials == random_trials(200, seed=4) and trials != random_trials(200, seed=5)
    assert {t.k for t in trials} == set(range(4, 21))
    assert {t.window_size for t in trials} == {2, 3, 4, 5}
    assert {t.distance_measure for t in trials} == {"euclidean", "cosine"}
    assert all(0.5 <= t.s <= 5 for t in trials)


def test_grid():
    trials = grid_trials([4, 5], ["cosine"], [2, 3], [1.0])
    assert len(trials) == len(set(trials)) == 4 and Trial(5, "cosine", 3, 1.0) in trials


def test_labels_are_read_by_name(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("source,label,id\nx,home,1\ny,,2\nz,shop,no\n")
    assert [tuple(r) for r in read_labels(spark, str(tmp_path / "labels.csv")).collect()] == [(1, "home"), (2, None), (None, "shop")]
    marked = read_labels(spark, str(tmp_path / "labels.csv"), corrupt_column="bad")
    assert [r.bad for r in marked.collect()] == [None, None, "z,shop,no"]
    (tmp_path / "other.csv").write_text("id,name\n1,home\n")
    with pytest.raises(ValueError, match="no column label"):
        read_labels(spark, str(tmp_path / "other.csv"))


def test_an_empty_table_replaces_a_slice(spark, tmp_path):
    store = UrlStore(str(tmp_path))
    table = spark.createDataFrame([("w", Vectors.dense(1.0))], ["word", "vector"])
    for size in (2, 3):
        store.write_word_vectors(table, size)
    store.write_word_vectors(table.limit(0), 3)
    assert store.read_word_vectors(spark, 3).count() == 0 and store.read_word_vectors(spark, 2).count() == 1


def test_repeated_ids_stop_the_job(spark, tmp_path):
    (tmp_path / "urls.csv").write_text("id,url\n1,http://a.b.c/d\n1,http://a.b.c/e\n")
    with pytest.raises(ValueError, match="id 1 has 2 rows"):
        jobs.split_urls(spark, UrlStore(str(tmp_path)), str(tmp_path / "urls.csv"))


def test_zero_vectors_are_in_no_cosine_cluster(spark):
    rows = [(i, f"u{i}", Vectors.dense(0, 0) if i < 2 else Vectors.dense(i % 2, 1 - i % 2)) for i in range(12)]
    features = spark.createDataFrame(rows, ["id", "url", "vector"]).cache()
    clustered = cluster_urls(features, 2, "cosine").collect()
    assert sorted(r.id for r in clustered) == list(range(2, 12)) and len({r.cluster_id for r in clustered}) == 2
    score, model = run_trial(features, Trial(2, "cosine", 2, 1.0), "kmeans")
    assert score == pytest.approx(1) and model is not None


def test_a_large_model_is_trained_in_blocks(spark):
    split = spark.createDataFrame([(["a", "b", "c"],)], "split_url array<string>")
    vectors = word_vectors(split, 2, 10, model_values=29)
    assert {r.word: len(r.vector) for r in vectors.collect()} == {"a": 10, "b": 10, "c": 10}


def test_unscorable_trials(spark):
    rows = [(i, f"u{i}", Vectors.dense(0, 0) if i == 0 else Vectors.dense(1, 1)) for i in range(6)]
    features = spark.createDataFrame(rows, ["id", "url", "vector"]).cache()
    assert run_trial(features.where("id = 0"), Trial(4, "cosine", 2, 1.0), "kmeans") == (None, None)
    same = features.where("id > 0")
    assert run_trial(same, Trial(4, "euclidean", 2, 1.0), "bisecting_kmeans") == (None, None)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    draw = random.Random(0)
    topics = ["sport/ball", "news/world", "shop/cart"]
    lines = [f"{i},http://www.{'blog.' * (i % 4 == 0)}example.com/{topics[i % 3]}/{draw.randint(1, 4)}?page={draw.randint(1, 3)}"
             for i in range(90)]
    (root / "urls.csv").write_text("\n".join(["id,url", *lines, "90,http://example.com/unique"]))
    (root / "labels.csv").write_text("\n".join(["id,label", *[f"{i},{topics[i % 3]}" for i in range(0, 91, 2)]]))
    store = UrlStore(str(root / "tables"))
    jobs.split_urls(spark, store, str(root / "urls.csv"))
    jobs.rank_terms(spark, store, min_count=5, max_ratio=1.1)
    jobs.train_word_vectors(spark, store, [2, 3], vector_size=8, num_partitions=1)
    return store


def test_prepared_tables(spark, store):
    assert store.read_split_urls(spark).count() == 91
    ranked = store.read_ranked_urls(spark)
    assert ranked.count() == 90
    words = {w for r in ranked.collect() for w in r.split_url}
    for size in (2, 3):
        assert {r.word for r in store.read_word_vectors(spark, size).collect()} == words


@pytest.mark.parametrize("algorithm", ["kmeans", "bisecting_kmeans"])
def test_cluster_and_evaluate(spark, store, algorithm):
    jobs.cluster_urls(spark, store, 6, "cosine", 1.5, 2, algorithm=algorithm)
    clustered = store.read_clustered_urls(spark, algorithm)
    assert clustered.columns == ["id", "url", "cluster_id", "vector"] and clustered.count() == 90
    labels_csv = store.root.replace("tables", "labels.csv")
    scores = jobs.evaluate_clusters(spark, store, labels_csv, algorithm).first()
    assert 0 <= scores.v_measure <= 1
    assert jobs.plane_coordinates(spark, store, labels_csv, algorithm).count() == 45
    summary = jobs.profile_clusters(spark, store, 3, "euclidean", 1.5, 2, algorithm=algorithm, runs=1).first()
    assert (summary.algorithm, summary.n_rows, summary.runs) == (algorithm, 90, 1)


@pytest.mark.parametrize("parallelism", [1, 2])
def test_search_keeps_the_best(spark, store, parallelism):
    trials = grid_trials([4, 5], ["euclidean"], [2, 3], [1.0])
    result = jobs.search_clusters_stored(spark, store, trials, parallelism=parallelism)
    rows = result.trials.orderBy("trial").collect()
    assert [Trial(r.k, r.distance_measure, r.window_size, r.s) for r in rows] == trials
    assert result.best_score == max(r.score for r in rows) and -1 <= result.best_score <= 1
    assert result.best == trials[[r.score for r in rows].index(result.best_score)]
    stored = store.read_clustered_urls(spark, "kmeans")
    assert stored.count() == 90 and stored.select("cluster_id").distinct().count() <= result.best.k


def test_search_uses_the_given_score(spark, store):
    trials = grid_trials([4, 6], ["cosine"], [2], [1.0])
    result = jobs.search_clusters_stored(
        spark, store, trials, algorithm="bisecting_kmeans",
        score=lambda clustered: 1 / clustered.select("cluster_id").distinct().count(),
    )
    assert result.best.k == 4
    assert store.read_clustered_urls(spark, "bisecting_kmeans").select("cluster_id").distinct().count() == 4


def test_low_scores_count_too(spark, store):
    trials = grid_trials([4, 6], ["euclidean"], [2], [1.0, 2.0])
    result = jobs.search_clusters_stored(spark, store, trials, score=lambda clustered: -5.0 - clustered.count())
    assert result.best == trials[0] and result.best_score == -95 and result.clustered.count() == 90
    unscored = jobs.search_clusters_stored(spark, store, trials, score=lambda clustered: float("nan"))
    assert unscored.best is None


def test_one_broadcast_per_window_size(spark, store, monkeypatch):
    made = []
    monkeypatch.setattr("pathloom.plans.search.share_vectors", lambda vectors: made.append(share_vectors(vectors)) or made[-1])
    trials = grid_trials([4], ["euclidean"], [2, 3], [1.0, 1.5, 2.0])
    jobs.search_clusters_stored(spark, store, trials)
    assert len(made) == 2


@pytest.mark.parametrize("algorithm", ["kmeans", "bisecting_kmeans"])
def test_a_stopped_search_goes_on(spark, store, monkeypatch, tmp_path, algorithm):
    """Only trials of feature sets that were not finished are run again, and the result is the same as without the stop."""
    trials = grid_trials([3, 4], ["euclidean", "cosine"], [2, 3], [1.0, 2.0])
    ledger = str(tmp_path / "ledger")
    search = lambda **more: jobs.search_clusters_stored(spark, store, trials, algorithm=algorithm, ledger=ledger, **more)
    means = search_module.pattern_means
    calls = []

    def counted(*args, **more):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the driver is lost")
        return means(*args, **more)

    monkeypatch.setattr(search_module, "pattern_means", counted)
    with pytest.raises(RuntimeError, match="lost"):
        search()
    calls[:] = [1] * 10
    resumed = search()
    assert len(calls) == 12
    calls[:] = [1] * 10
    again = search()
    assert len(calls) == 10
    monkeypatch.undo()
    whole = jobs.search_clusters_stored(spark, store, trials, algorithm=algorithm)
    rows = lambda result: [(r.trial, r.k, r.s, None if r.score is None else round(r.score, 9)) for r in result.trials.orderBy("trial").collect()]
    assert rows(resumed) == rows(whole) == rows(again)
    assert resumed.best == whole.best == again.best
    clusters = lambda result: sorted((r.id, r.cluster_id) for r in result.clustered.collect())
    assert clusters(resumed) == clusters(whole) == clusters(again)
    # Other seeds, tables or iterations are other trials.
    calls[:] = [1] * 10
    monkeypatch.setattr(search_module, "pattern_means", counted)
    search(seed=2)
    assert len(calls) == 14


def test_a_failed_write_leaves_the_rows_before(spark, tmp_path):
    store = UrlStore(str(tmp_path))
    table = spark.createDataFrame([(1, "u", 0), (2, "v", 1)], "id long, url string, cluster_id int")
    with pytest.raises(FileNotFoundError):
        store.read_clustered_urls(spark, "kmeans")
    store.write_clustered_urls(table, "kmeans")
    broken = table.union(table).withColumn("cluster_id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("cluster_id")))
    with pytest.raises(Exception, match="lost"):
        store.write_clustered_urls(broken, "kmeans")
    rows = lambda: sorted((r.id, r.cluster_id) for r in store.read_clustered_urls(spark, "kmeans").collect())
    assert rows() == [(1, 0), (2, 1)]
    store.write_clustered_urls(table.where("id = 2"), "kmeans")
    assert rows() == [(2, 1)]
    assert store.table(spark, "clustered_urls/algorithm=kmeans").empty_old_versions() == 1 and rows() == [(2, 1)]


def test_a_table_can_replace_itself(spark, tmp_path):
    store = UrlStore(str(tmp_path))
    store.write_split_urls(spark.createDataFrame([(1, "u", ["a"])], "id long, url string, split_url array<string>"))
    store.write_split_urls(store.read_split_urls(spark).withColumn("id", F.col("id") + 1))
    assert [r.id for r in store.read_split_urls(spark).collect()] == [2]


def test_quarantine_parts_all_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,url\n1,http://a\n2,"http://b,c"\nx,http://z\n3,\n,http://n\n4,http://d\n')
    (tmp_path / "in" / "b.csv").write_text("id,url\n4,http://e\n5,http://f\n6,u,more\n")
    found = quarantine(spark, str(tmp_path / "in"))
    assert sorted(tuple(r) for r in found.rows.collect()) == [(1, "http://a"), (2, "http://b,c"), (5, "http://f")]
    rejects = sorted((r.file.rpartition("/")[2], r.line, r.reason) for r in found.rejects.collect())
    assert rejects == [("a.csv", ",http://n", "no id"), ("a.csv", "3,", "no url"), ("a.csv", "4,http://d", "id repeats"), ("a.csv", "x,http://z", "malformed"),
                       ("b.csv", "4,http://e", "id repeats"), ("b.csv", "6,u,more", "malformed")]
    store = UrlStore(str(tmp_path / "tables"))
    jobs.split_urls(spark, store, str(tmp_path / "in"), rejects=str(tmp_path / "rejects"))
    assert store.read_split_urls(spark).count() == 3
    assert VersionedTable(spark, str(tmp_path / "rejects"), REJECTS).read().count() == 6


def test_label_files_may_differ_in_their_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,label\n1,x\n2,y\n")
    (tmp_path / "in" / "b.csv").write_text("more,label,id\nq,z,3\n")
    (tmp_path / "in" / "c d.csv").write_text("id,label\n")
    assert sorted(tuple(r) for r in read_labels(spark, str(tmp_path / "in")).collect()) == [(1, "x"), (2, "y"), (3, "z")]
    (tmp_path / "in" / "e.csv").write_text("id,other\n1,x\n")
    with pytest.raises(ValueError, match="e.csv has no column label, only id, other"):
        read_labels(spark, str(tmp_path / "in"))

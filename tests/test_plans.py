"""The plans read only what they need and move only what they must."""

import os

import pytest
from pyspark.sql import functions as F

from pathloom import evaluate_clusters, explode_terms, split_urls, top_terms
from pathloom.operators.vocabulary import max_word_count, word_counts
from pathloom.scale import fits_broadcast, shared_dir
from pathloom.sources.tables import UrlStore
from tests.plans import explained

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture
def split(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    return split_urls(pages.select(F.col("page_id").alias("id"), "url"))


def test_only_the_url_is_read(split):
    assert "ReadSchema: struct<url:string>" in explained(word_counts(explode_terms(split)))


def test_counting_urls_reads_no_column_and_splits_nothing(split):
    plan = explained(max_word_count(split))
    assert "ReadSchema: struct<>" in plan and "split(" not in plan


def test_top_terms_need_no_global_sort(split):
    plan = explained(top_terms(split, 5))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_slices_are_pruned(spark, tmp_path):
    store = UrlStore(str(tmp_path))
    vectors = spark.createDataFrame([("w", 1.0)], "word string, vector double")
    for size in (2, 3):
        store.write_word_vectors(vectors, size)
    assert "PartitionFilters: [isnotnull(window_size" in explained(store.read_word_vectors(spark, 3))


def test_evaluation_reads_no_vectors_and_narrows_the_clusters_first(spark, tmp_path):
    clusters = spark.range(5000).select("id", (F.col("id") % 3).cast("int").alias("cluster_id"), F.lit("v").alias("vector"))
    clusters.write.parquet(str(tmp_path / "clusters"))
    spark.range(20).select("id", F.lit("a").alias("label")).write.parquet(str(tmp_path / "labels"))
    scored = evaluate_clusters(spark.read.parquet(str(tmp_path / "clusters")), spark.read.parquet(str(tmp_path / "labels")))
    plan = explained(scored)
    assert "vector" not in plan
    assert "BroadcastHashJoin [id" in plan and "LeftSemi" in plan


def test_broadcast_is_measured(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("word"))
    assert fits_broadcast(df, "word") and not fits_broadcast(df, "word", limit=50_000)
    assert not fits_broadcast(df, "word", payload=F.length("word") * 100_000)
    assert fits_broadcast(df.limit(0), "word", limit=0)


def test_checkpoints_go_where_the_session_says(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

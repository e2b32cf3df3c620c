"""Headline timings; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores. Each number is the median of three
runs after a warm-up (one run for ``compared`` and ``*_wide``). ``queries`` holds the operators on the given tables; under ``*_large``, on
``pages`` repeated to about a million URLs; and under ``*_wide``, on these URLs with half as many different terms, so that the vocabulary and
the word vectors are beyond what a task may hold at a time. ``compared`` holds plainer forms of the same.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import time
from urllib.parse import urlsplit

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pathloom import cluster_urls, split_urls, v_measure, vocabulary
from pathloom.operators.features import (
    join_word_vectors, mean_vectors, standardize, url_features, url_means, vector_size_of, weighted_coefficients,
)
from pathloom.operators.patterns import cluster_urls_by_pattern, features_by_pattern, pattern_means, term_patterns
from pathloom.operators.terms import explode_terms
from pathloom.operators.vocabulary import frequency_filter, rank_terms, word_counts
from pathloom.plans.search import grid_trials, run_trial, search_clusters
from pathloom.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
LARGE_ROWS = int(os.environ.get("BENCH_LARGE_ROWS", 1_000_000))
RUNS = 3

HEADLINE = [
    "split_url", "explode_terms", "word_counts", "vocabulary_rank", "top_terms", "ranked_terms", "weighted_coefficients",
    "mean_vectors_in_tasks", "standardize", "url_features", "word_vectors_of_urls", "kmeans", "bisecting_kmeans",
    "assign_to_centres", "silhouette_euclidean", "silhouette_cosine", "align_labels", "encode_labels", "v_measure",
    "evaluate_clusters", "plane_coordinates", "plane_coordinates_full_width", "timing_summary", "ranked_terms_shuffled", "mean_vectors_by_pieces",
    "mean_vectors_beyond", "features_by_pattern", "kmeans_many",
]


def session(scratch: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_seconds(job, runs: int = RUNS) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        job()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def repeated_urls(spark: SparkSession, path: str) -> DataFrame:
    """``pages`` repeated with a number of the copy as one more path term, stored outside of the timings."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url")
    n = pages.count()
    copies = pages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(LARGE_ROWS // n, 1) - 1))))
    numbered = F.regexp_replace("url", r"/(\d+)", F.concat(F.lit("/"), F.col("copy").cast("string"), F.lit("/$1")))
    urls = copies.select((F.col("page_id") + F.col("copy") * n).alias("id"), numbered.alias("url"))
    urls.repartition(2 * int(CPUS)).write.parquet(path)
    return spark.read.parquet(path)


def hashed_vectors(words: DataFrame) -> DataFrame:
    vector = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.hash("word", i) / 2e9)
    return words.select("word", array_to_vector(vector).alias("vector"))


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@F.udf(ArrayType(StringType()))
def split_in_python(url):
    parts = urlsplit(url)
    named = [piece for piece in re.split("[&=]", parts.query) if piece]
    pieces = parts.netloc.split(".")[:-2] + re.split("[-/ +]", parts.path)
    return [piece for piece in pieces if piece] + (["?", *named] if named else [])


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="run-")
    spark = session(scratch)
    queries = {name: median_seconds(lambda name=name: run(QUERIES[name](spark, SF_DIR))) for name in HEADLINE}

    urls = repeated_urls(spark, f"{scratch}/urls")
    split = stored(split_urls(urls), f"{scratch}/split")
    ranked = stored(rank_terms(split), f"{scratch}/ranked")
    words = vocabulary(split)
    vectors = stored(hashed_vectors(words), f"{scratch}/vectors")
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("source", "lang")
    many = documents.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(LARGE_ROWS // documents.count(), 1)))))
    assigned = stored(many, f"{scratch}/assigned")

    counts = word_counts(explode_terms(split))
    one_task = F.row_number().over(Window.orderBy(F.desc("count"), "word"))
    joined = lambda: join_word_vectors(weighted_coefficients(ranked, 3.0), vectors)

    queries["split_url_large"] = median_seconds(lambda: run(split_urls(urls)))
    queries["vocabulary_rank_large"] = median_seconds(lambda: run(vocabulary(split)))
    queries["ranked_terms_large"] = median_seconds(lambda: run(rank_terms(split)))
    queries["ranked_terms_in_tasks_large"] = median_seconds(lambda: run(rank_terms(split, unique_ids=True)))
    queries["mean_vectors_large"] = median_seconds(lambda: run(url_means(ranked, vectors, 3.0)))
    queries["v_measure_large"] = median_seconds(lambda: run(v_measure(assigned, "source", "lang")))

    queries["features_large"] = median_seconds(lambda: run(url_features(ranked, vectors, 3.0)), 1)
    queries["features_by_pattern_large"] = median_seconds(lambda: run(features_by_pattern(ranked, vectors, 3.0)), 1)
    queries["kmeans_by_pattern_large"] = median_seconds(lambda: run(cluster_urls_by_pattern(ranked, vectors, 3.0, 10)), 1)
    trials = grid_trials([4, 6, 8, 10, 12], ["euclidean"], [5], [1.0, 1.5, 2.0, 2.5])
    queries["search_20_trials_large"] = median_seconds(lambda: search_clusters(ranked, lambda _: vectors, trials), 1)

    def one_by_one() -> None:
        counted = term_patterns(ranked).persist()
        for s in (1.0, 1.5, 2.0, 2.5):
            means = pattern_means(counted, vectors, s).persist()
            for trial in trials[:5]:
                run_trial(standardize(means, weight="urls"), trial, "kmeans", weight="urls")
            means.unpersist()
        counted.unpersist()

    many_words = LARGE_ROWS // 2
    rare = F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(many_words)).cast("string"))
    wide = stored(split.select("id", "url", F.concat("split_url", F.array(rare)).alias("split_url")), f"{scratch}/wide")
    wide_ranked = stored(rank_terms(wide, 1, 2.0, unique_ids=True), f"{scratch}/wide_ranked")
    wide_vectors = stored(hashed_vectors(wide_ranked.select(F.explode("split_url").alias("word")).distinct()), f"{scratch}/wide_vectors")
    queries["vocabulary_rank_wide"] = median_seconds(lambda: run(vocabulary(wide, 1, 2.0)), 1)
    queries["ranked_terms_wide"] = median_seconds(lambda: run(rank_terms(wide, 1, 2.0, broadcast_bytes=0)), 1)
    queries["mean_vectors_wide"] = median_seconds(lambda: run(url_means(wide_ranked, wide_vectors, 3.0)), 1)
    embeddings = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    copies = F.explode(F.sequence(F.lit(1), F.lit(max(LARGE_ROWS // embeddings.count(), 1)))).alias("copy")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.hash("vec_id", "copy", i) / 1e11)
    points = stored(embeddings.select("vec_id", "embedding", copies).select(
        F.xxhash64("vec_id", "copy").alias("id"), F.lit("").alias("url"), array_to_vector(moved).alias("vector")), f"{scratch}/points").persist()
    queries["kmeans_wide"] = median_seconds(lambda: run(cluster_urls(points, 10)), 1)
    wide_joined = lambda: join_word_vectors(weighted_coefficients(wide_ranked, 3.0), wide_vectors)
    plainer = {
        "mean_vectors_wide_sum_per_dimension": lambda: run(mean_vectors(wide_joined(), 100)),
        "split_url_large_python_udf": lambda: run(urls.select("id", "url", split_in_python("url"))),
        "vocabulary_rank_large_one_task_window": lambda: run(
            frequency_filter(counts, split).withColumn("word_frequency_order", one_task)),
        "mean_vectors_large_sum_per_dimension": lambda: run(mean_vectors(joined(), vector_size_of(vectors))),
        "kmeans_large_per_url": lambda: run(cluster_urls(url_features(ranked, vectors, 3.0).persist(), 10)),
        "search_20_trials_large_one_by_one": one_by_one,
        "v_measure_large_collected": lambda: assigned.select("source", "lang").toPandas().value_counts(),
    }
    compared = {name: median_seconds(job, runs=1) for name, job in plainer.items()}
    print(json.dumps({
        "metric": "total of the headline queries", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "compared": compared, "large_rows": urls.count(), "wide_words": wide_vectors.count(), "cpus": int(CPUS), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

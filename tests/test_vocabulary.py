import random

import pytest
from pyspark.sql import functions as F

from pathloom import explode_terms, rank_terms, split_urls, top_terms, vocabulary
from pathloom.operators.vocabulary import dropped_urls, max_word_count, word_counts
from pathloom.scale import join_skewed, number_rows
from tests.plans import explained

SCHEMA = "id long, url string, split_url array<string>"


def split_table(spark, *term_lists):
    return spark.createDataFrame([(i, f"u{i}", list(terms)) for i, terms in enumerate(term_lists)], SCHEMA)


def test_ties_go_by_word(spark):
    split = split_table(spark, "aaab", "bccd", "", "", "", "", "", "")
    rows = vocabulary(split, min_count=2, max_ratio=1.0).orderBy("word_frequency_order").collect()
    assert [tuple(r) for r in rows] == [("a", 3, 1), ("b", 2, 2), ("c", 2, 3)]


def test_upper_bound_is_exclusive(spark):
    split = split_table(spark, *["ab"] * 7, "a", "c", "c")
    assert max_word_count(split, 0.8).first().max_count == 8
    kept = {r.word: r.word_frequency_order for r in vocabulary(split, min_count=1, max_ratio=0.8).collect()}
    assert kept == {"b": 1, "c": 2}


def test_ranked_urls(spark):
    split = split_table(spark, ["x", "b", "rare", "x"], ["b", "x", "b"], ["unique"], ["a", "a"], *[[]] * 4)
    rows = rank_terms(split, min_count=2, max_ratio=1.0).orderBy("id").collect()
    assert [(r.id, r.split_url, r.word_frequency_orders) for r in rows] == [
        (0, ["x", "b", "x"], [2, 1, 2]),
        (1, ["b", "x", "b"], [1, 2, 1]),
        (3, ["a", "a"], [3, 3]),
    ]
    dropped = dropped_urls(split, rank_terms(split, min_count=2, max_ratio=1.0))
    assert sorted(r.id for r in dropped.collect()) == [2, 4, 5, 6, 7]


def test_copies_count_but_give_one_row(spark):
    split = split_table(spark, "ab").unionAll(split_table(spark, "ab")).unionAll(split_table(spark, "ab"))
    ranked = rank_terms(split, min_count=3, max_ratio=2.0).collect()
    assert [(r.split_url, r.word_frequency_orders) for r in ranked] == [(["a", "b"], [1, 2])]


def skewed_split(spark, n=3000):
    """A third of all terms is one word, which the upper bound removes; one more word is nearly as frequent."""
    draw = random.Random(7)
    return split_table(
        spark, *[["www"] * 2 + ["en"] * (i % 3 > 0) + [f"w{int(draw.paretovariate(0.7))}" for _ in range(3)] for i in range(n)]
    )


def test_join_beyond_the_broadcast_bound_gives_the_same_rows(spark):
    split = skewed_split(spark).cache()
    broadcast = rank_terms(split, 3, 1.5)
    shuffled = rank_terms(split, 3, 1.5, broadcast_bytes=0)
    assert sorted(map(tuple, broadcast.collect())) == sorted(map(tuple, shuffled.collect()))
    assert "www" not in {w for r in broadcast.collect() for w in r.split_url}
    split.unpersist()


def test_unique_ids_give_the_same_rows_without_a_shuffle(spark, tmp_path):
    skewed_split(spark).write.parquet(str(tmp_path / "split"))
    split = spark.read.parquet(str(tmp_path / "split"))
    ranked = rank_terms(split, 3, 1.5, unique_ids=True)
    assert "Exchange" not in explained(ranked)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, rank_terms(split, 3, 1.5).collect()))
    shuffled = rank_terms(split, 3, 1.5, unique_ids=True, broadcast_bytes=0)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, shuffled.collect()))


def test_few_hot_keys_and_many_others(spark):
    split = skewed_split(spark).cache()
    expected = rank_terms(split, 3, 1.5)
    shuffled = rank_terms(split, 3, 1.5, hot_keys=2, broadcast_bytes=0)
    assert sorted(map(tuple, expected.collect())) == sorted(map(tuple, shuffled.collect()))
    split.unpersist()


@pytest.mark.parametrize("one_task_rows", [0, 100_000])
def test_ranking_matches_brute_force(spark, one_task_rows):
    split = skewed_split(spark)
    counts = {}
    for row in split.collect():
        for word in row.split_url:
            counts[word] = counts.get(word, 0) + 1
    kept = sorted((-n, w) for w, n in counts.items() if 3 <= n < int(3000 * 1.5))
    expected = [(w, -n, rank) for rank, (n, w) in enumerate(kept, 1)]
    assert sorted(map(tuple, vocabulary(split, 3, 1.5, one_task_rows=one_task_rows).collect()), key=lambda r: r[2]) == expected
    assert [tuple(r) for r in top_terms(split, 5, 3, 1.5).collect()] == [r[:2] for r in expected[:5]]


def test_number_rows_over_many_partitions(spark):
    df = spark.range(10_000).select(F.hash("id").alias("h"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = number_rows(df, [F.desc("h"), F.asc("id")], "n", one_task_rows=0).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r.n for r in sorted(rows, key=lambda r: (-r.h, r.id))] == list(range(1, 10_001))


def test_no_rows(spark):
    none = split_table(spark, "", "")
    assert vocabulary(none).count() == 0
    assert rank_terms(none).count() == rank_terms(none, unique_ids=True).count() == 0
    assert number_rows(none, [F.asc("id")], "n", one_task_rows=0).count() == 2
    assert number_rows(none.limit(0), [F.asc("id")], "n", one_task_rows=-1).count() == 0


def test_ranks_are_attached_without_moving_the_terms(spark, tmp_path):
    skewed_split(spark, 50).write.parquet(str(tmp_path / "split"))
    ranked = rank_terms(spark.read.parquet(str(tmp_path / "split")), 2, 3.0)
    ranked.collect()
    text = explained(ranked)
    # One shuffle by id and url, shared by the removal of copies and the regrouping; none by word.
    assert text.count("hashpartitioning(id") == 1
    assert "hashpartitioning(word" not in text


def test_no_sort_and_one_shuffle_of_the_urls(spark, tmp_path):
    skewed_split(spark, 50).write.parquet(str(tmp_path / "split"))
    text = explained(rank_terms(spark.read.parquet(str(tmp_path / "split")), 2, 3.0))
    assert "SortAggregate" not in text and "Sort [" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("kind", ["int", "long", "string"])
@pytest.mark.parametrize("unique_ids", [False, True])
def test_ids_of_any_type_in_both_forms(spark, kind, unique_ids):
    split = split_table(spark, "ab", "abc", "", "bbd").withColumn("id", F.col("id").cast(kind))
    split = split if unique_ids else split.union(split)
    small = rank_terms(split, 2, 2.0, unique_ids=unique_ids)
    large = rank_terms(split, 2, 2.0, unique_ids=unique_ids, broadcast_bytes=0, hot_keys=1, one_task_rows=0)
    assert [f.simpleString() for f in small.schema] == [f.simpleString() for f in large.schema]
    assert small.schema["id"].dataType == split.schema["id"].dataType
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) != []


def test_hot_keys_are_broadcast_only_if_they_fit(spark, monkeypatch):
    monkeypatch.setattr("pathloom.scale.HOT_BYTES", 2_000)
    facts = spark.range(2000).select((F.col("id") % 97).cast("string").alias("word"), "id")
    words = spark.range(90).select(F.col("id").cast("string").alias("word"), F.repeat(F.lit("x"), 300).alias("long"))
    joined = join_skewed(facts, words, "word", payload=F.length("long"), broadcast_bytes=0)
    assert joined.count() == facts.where("cast(word as int) < 90").count()


def test_word_counts_combine_before_the_shuffle(spark):
    assert "partial_count" in explained(word_counts(explode_terms(split_table(spark, "ab"))))

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pathloom import PythonWeight, url_features, weighted_coefficients, zipf_coefficient
from pathloom.operators.features import (
    join_word_vectors, mean_vectors, pair_terms, pieces_for, scale_word_vectors, share_vectors, standardize, url_means,
)
from tests.plans import explained

RANKED = "id long, url string, split_url array<string>, word_frequency_orders array<long>"


def ranked_table(spark, *rows):
    return spark.createDataFrame([(i, f"u{i}", list(w), list(o)) for i, (w, o) in enumerate(rows)], RANKED)


def vector_table(spark, **vectors):
    return spark.createDataFrame([(w, Vectors.dense(v)) for w, v in vectors.items()], ["word", "vector"])


def coefficients_of(df):
    return [r.coefficients for r in df.orderBy("id").collect()]


def test_zipf(spark):
    df = ranked_table(spark, ("abc", [1, 2, 4]), ("", []))
    assert coefficients_of(weighted_coefficients(df, 2)) == [[1, 0.25, 0.0625], []]
    assert spark.range(1, 3).select(zipf_coefficient(F.col("id"), 0.5).alias("z")).collect()[1].z == pytest.approx(2 ** -0.5)


@pytest.mark.parametrize("weight", [lambda i: i + 1, PythonWeight(lambda i: i + 1)])
def test_position_weight(spark, weight):
    df = ranked_table(spark, ("abc", [1, 2, 4]), ("", []), ("c", [4]))
    assert coefficients_of(weighted_coefficients(df, 2, weight)) == [[1, 0.5, 0.1875], [], [0.0625]]


def test_pairs(spark):
    rows = pair_terms(weighted_coefficients(ranked_table(spark, ("ab", [1, 2])), 1)).collect()
    assert [tuple(p) for p in rows[0].split_urls_and_coefficients] == [("a", 1.0), ("b", 0.5)]


def test_scaled_vectors(spark):
    df = weighted_coefficients(ranked_table(spark, ("ab", [1, 2])), 1)
    rows = scale_word_vectors(join_word_vectors(df, vector_table(spark, a=[1, 2], b=[3, 6]))).orderBy("pos").collect()
    assert [(r.word, r.weighted_word_vector, r.coefficient) for r in rows] == [("a", [1, 2], 1), ("b", [1.5, 3], 0.5)]


def test_weighted_mean(spark):
    terms = spark.createDataFrame(
        [(1, "u", 1, "b", 1.5, [3.0, 6.0]), (1, "u", 0, "a", 0.5, [1.0, 2.0]), (2, "v", 0, "a", 0.0, [1.0, 2.0])],
        "id long, url string, pos int, word string, coefficient double, vector array<double>",
    )
    rows = mean_vectors(terms, 2).orderBy("id").collect()
    assert (rows[0].split_url, rows[0].coefficients, rows[0].vector) == (["a", "b"], [0.5, 1.5], [2.5, 5.0])
    assert rows[1].vector is None


def test_standardize_divides_without_centring(spark):
    df = spark.createDataFrame([(1, Vectors.dense(1, 5)), (2, Vectors.dense(3, 5))], ["id", "vector"])
    rows = standardize(df).orderBy("id").collect()
    assert np.allclose([r.vector.toArray() for r in rows], [[math.sqrt(0.5), 0], [3 * math.sqrt(0.5), 0]])


def random_tables(spark, n=400, words=60, size=7):
    draw = random.Random(3)
    lists = [draw.choices(range(words + 5), k=draw.randint(0, 9)) for _ in range(n)]
    rows = [([f"w{t}" for t in terms], [t + 1 for t in terms]) for terms in lists]
    # The last five words have no vector.
    vectors = {f"w{t}": [draw.gauss(0, 1) for _ in range(size)] for t in range(words)}
    return ranked_table(spark, *rows), vector_table(spark, **vectors), rows, vectors


@pytest.mark.parametrize("broadcast_bytes", [0, 2**27])
@pytest.mark.parametrize("weight", [None, lambda i: 1 - i])
def test_means_match_brute_force(spark, monkeypatch, broadcast_bytes, weight):
    monkeypatch.setattr("pathloom.operators.features._TERMS_AT_ONCE", 7)
    ranked, vectors, rows, table = random_tables(spark)
    means = url_means(ranked, vectors, 1.3, weight, broadcast_bytes=broadcast_bytes)
    found = {r.id: r for r in means.collect()}
    expected = {}
    for i, (words, orders) in enumerate(rows):
        kept = [(w, (weight(p) if weight else 1) / o**1.3, table[w]) for p, (w, o) in enumerate(zip(words, orders)) if w in table]
        total = sum(c for _, c, _ in kept)
        if kept and total != 0:
            expected[i] = ([w for w, _, _ in kept], sum(c * np.array(v) for _, c, v in kept) / total, [c for _, c, _ in kept])
    assert found.keys() == expected.keys()
    for i, (words, mean, coefs) in expected.items():
        assert found[i].split_url == words
        assert np.allclose(found[i].coefficients, coefs)
        assert np.allclose(found[i].vector.toArray(), mean)


def test_features_are_standardized(spark):
    ranked, vectors, _, _ = random_tables(spark)
    features = url_features(ranked, vectors, 2.0)
    assert features.columns == ["id", "url", "split_url", "coefficients", "vector"]
    values = np.array([r.v for r in features.select(vector_to_array("vector").alias("v")).collect()])
    assert np.allclose(values.std(axis=0, ddof=1), 1)


def test_features_need_no_shuffle(spark):
    ranked, vectors, _, _ = random_tables(spark)
    plan = explained(url_means(ranked, vectors, 2.0))
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_no_word_vectors(spark):
    ranked, vectors, _, _ = random_tables(spark, 5)
    assert url_means(ranked, vectors.limit(0), 2.0).count() == 0


@pytest.mark.parametrize("kind", ["int", "long", "string"])
@pytest.mark.parametrize("hot_keys", [0, 20, None])
@pytest.mark.parametrize("weight", [None, lambda i: F.when(i % 2 == 0, i + 1)])
def test_results_do_not_depend_on_size(spark, kind, hot_keys, weight):
    """Any id type, null coefficients, repeated rows and unknown words: equal schema and rows in both forms."""
    ranked, vectors, _, _ = random_tables(spark, 80)
    ranked = ranked.withColumn("id", F.col("id").cast(kind))
    ranked = ranked.union(ranked.limit(7)).cache()
    small = url_means(ranked, vectors, 1.3, weight)
    large = url_means(ranked, vectors, 1.3, weight, broadcast_bytes=0, hot_keys=hot_keys)
    assert [f.simpleString() for f in small.schema] == [f.simpleString() for f in large.schema]
    key = lambda r: (str(r.id), r.url)
    a, b = sorted(small.collect(), key=key), sorted(large.collect(), key=key)
    assert len(a) > 70
    assert [(r.id, r.url, r.split_url, r.coefficients) for r in a] == [(r.id, r.url, r.split_url, r.coefficients) for r in b]
    assert np.allclose([r.vector.toArray() for r in a], [r.vector.toArray() for r in b])


def test_vectors_are_shared_until_destroyed(spark):
    ranked, vectors, _, _ = random_tables(spark, 30)
    shared = share_vectors(vectors)
    first, second = (url_means(ranked, shared, s).count() for s in (1.0, 2.0))
    assert first == second == url_means(ranked, vectors, 1.0).count()
    shared.destroy()
    assert share_vectors(vectors, 10) is None


@pytest.mark.parametrize("pieces", [1, 3, 8])
@pytest.mark.parametrize("weight", [None, lambda i: 1 - i])
def test_pieces_give_the_same_rows(spark, pieces, weight):
    ranked, vectors, _, _ = random_tables(spark)
    plain = {r.id: r for r in url_means(ranked, vectors, 1.3, weight).collect()}
    found = {r.id: r for r in url_means(ranked, vectors, 1.3, weight, pieces=pieces).collect()}
    assert found.keys() == plain.keys()
    for i, row in found.items():
        assert (row.url, row.split_url) == (plain[i].url, plain[i].split_url)
        assert np.allclose(row.coefficients, plain[i].coefficients) and np.allclose(row.vector.toArray(), plain[i].vector.toArray())


def test_pieces_of_odd_rows(spark):
    """Null lists and coefficients, terms without a vector, more pieces than words, no rows."""
    ranked = spark.createDataFrame([(1, "a", ["x", None, "z"], [1, 2, 3]), (2, "b", None, None), (3, "c", [], []), (4, "d", ["z"], [1]), (5, "e", ["x", "y"], [None, 2])], RANKED)
    vectors = vector_table(spark, x=[1.0, 2.0], y=[3.0, 4.0])
    rows = lambda **more: sorted((r.id, r.split_url, r.coefficients, r.vector.toArray().tolist()) for r in url_means(ranked, vectors, 1.0, **more).collect())
    assert rows(pieces=7) == rows() == rows(pieces=1) and [r[0] for r in rows()] == [1, 5]
    assert url_means(ranked.where("false"), vectors, 1.0, pieces=2).collect() == []


def test_number_of_pieces(spark):
    ranked, vectors, _, _ = random_tables(spark)
    size = 60 * (64 + 7 * 8) + sum(len(f"w{t}") for t in range(60))
    assert [pieces_for(vectors, b) for b in (size, size - 1, size // 3)] == [1, 2, 4]
    plan = explained(url_means(ranked, vectors, 1.3, broadcast_bytes=size // 3))
    assert "Exchange" not in plan

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, k, every=100):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in whole:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block", [(10_000, 10_000), (90, 2)])
def test_against_brute_force(spark, shard_rows, block):
    random = np.random.default_rng(3)
    centres = random.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] * random.uniform(0.2, 3) + 0.2 * random.normal(size=16)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # equal vectors: ties go by id
    rows += [(1000, None), (1100, [1.0, float("nan")] * 8), (1200, [1.0, None] * 8), (1300, [float("inf")] * 16), (1400, []), (1500, [0.0] * 16), (None, [1.0] * 16)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    found = mtree.top_k_inner_products(docs, 10, shard_rows=shard_rows, query_block=block)
    assert sorted(map(tuple, found.collect())) == expected(rows, 10)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5), st.integers(-3, 3)), min_size=1, max_size=80), st.integers(1, 5))
def test_tree_finds_the_best(points, k):
    vectors = np.array(points, np.int64)
    ids = np.arange(len(points)) * 3
    found = mtree._search_shard(ids, vectors, ids[:5], vectors[:5], k)
    for i in range(min(5, len(points))):
        own = found[found.query_id == ids[i]]
        want = sorted((-int(vectors[j] @ vectors[i]), int(ids[j])) for j in range(len(points)) if j != i)[:k]
        assert sorted(zip(-own.score, own.vec_id)) == want


def test_bounds_save_distances():
    random = np.random.default_rng(1)
    points = np.concatenate([random.normal(size=(4000, 8)) * 0.05 + c for c in random.normal(size=(20, 8)) * 3])
    tree, seen = mtree.MTree(points, 16), []
    query = points[5]

    def offer(rows, reach):
        seen.extend(rows)
        return np.sort(np.linalg.norm(points[seen] - query, axis=1))[:10][-1] if len(seen) >= 10 else np.inf

    tree.search(query, offer, 1e-9)
    exact = np.argsort(np.linalg.norm(points - query, axis=1), kind="stable")[:10]
    assert set(exact) <= set(seen) and len(seen) < len(points) / 4


def test_few_rows_and_none(spark):
    assert mtree.top_k_inner_products(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(100, [1.0], 0)], SCHEMA)
    assert mtree.top_k_inner_products(one).collect() == []
    two = spark.createDataFrame([(100, [1.0], 0), (100, [1.0], 0), (7, [-1.0, 5.0], 0)], SCHEMA)
    assert [tuple(r) for r in mtree.top_k_inner_products(two).collect()] == [(100, 1, 7, -1024 * 1024)]


def test_large_components_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        mtree.top_k_inner_products(spark.createDataFrame([(100, [1e9], 0)], SCHEMA))


def test_large_components_that_fit_64_bits(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.integers(-500_000, 500_000, 4).astype(float).tolist()) for i in range(300)] + [(400, [1_000_000.0, 0.0, -2.0, 1.0])]
    found = mtree.top_k_inner_products(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), 10)
    assert sorted(map(tuple, found.collect())) == expected(rows, 10)

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import pivots
from pathloom.llm.pivots import PivotSearch, cluster_vectors
from tests.llm.conftest import rows_of

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
SCHEMA = "vec_id long, embedding array<float>"


def slow_clusters(rows, k=8, rounds=10, width=64):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == width and all(e is not None and math.isfinite(e) for e in x):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(e))) for e in x]))
    digest = lambda v: hashlib.sha256(f"3:{'' if v is None else v}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((distance(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own) if c == i]
            if members:
                centroids[i] = [sum(e) // len(members) for e in zip(*members)]
    last = [near(v) for _, v in kept]
    inertia = lambda c: sum(d for d, i in last if c is None or i == c)
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((v, c, d, inertia(c), inertia(None), name(c)) for (v, _), (d, c) in zip(kept, last)), key=repr)


def random_rows(n, seed, width=64, spread=0.2, groups=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (groups, width))
    return [(i, [float(x) for x in np.float32(centres[i % groups] + draw.normal(0, spread, width))]) for i in range(n)]


@pytest.mark.parametrize("seed, spread", [(1, 0.05), (2, 0.5), (3, 3.0)])
def test_against_slow_form(spark, seed, spread):
    rows = random_rows(90, seed, spread=spread)
    assert rows_of(cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)), *COLUMNS) == slow_clusters(rows)


def test_odd_rows(spark):
    rows = random_rows(20, 4)
    first = rows[0][1]
    rows += [(0, first), (0, first), (7, rows[3][1]), (None, rows[1][1]), (None, None), (30, None), (31, []), (32, first[:63]), (33, first + [1.0]),
             (34, [None] * 64), (35, [math.nan] + first[1:]), (36, first[:63] + [math.inf]), (37, first[:63] + [-math.inf]), (38, [0.0] * 64), (39, [-0.0] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit(name) for name in ("v", "x", "cluster", "n", "sums", "exact", "to_pivots", "_hash", "distance")})
    assert rows_of(cluster_vectors(df), *COLUMNS) == slow_clusters(rows)


def test_ties_and_empty_clusters(spark):
    """Copies as starting centroids: the smaller number wins, and the other ones stay empty and where they are."""
    pick = random.Random(1)
    rows = [(i, [float(pick.randrange(2))] * 64) for i in range(40)]
    assert rows_of(cluster_vectors(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == slow_clusters(rows)


def test_few_vectors_and_other_widths(spark):
    rows = random_rows(5, 6)
    assert rows_of(cluster_vectors(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == slow_clusters(rows)
    rows = random_rows(30, 7, width=3)
    found = cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=4, rounds=3, width=3, pivots=2)
    assert rows_of(found, *COLUMNS) == slow_clusters(rows, 4, 3, 3)


def test_nothing(spark):
    found = cluster_vectors(spark.createDataFrame([(1, [1.0])], SCHEMA))
    assert found.columns == list(COLUMNS) and found.collect() == []
    assert cluster_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_components(spark):
    rows = random_rows(20, 8)
    rows += [(90 + i, [float(sign * (2 ** 18 + i))] * 64) for i, sign in enumerate((1, -1, 1, -1, 1))]
    assert rows_of(cluster_vectors(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == slow_clusters(rows)
    with pytest.raises(Exception, match="would not fit 64 bits"):
        cluster_vectors(spark.createDataFrame([(1, [2e6] * 64)], SCHEMA)).collect()


def test_distances_as_python_integers():
    points = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert pivots.squared_distances(points, np.array([0, 0])).tolist() == [2 << 80, 25]
    assert pivots.squared_distances(points[1:], np.array([0, 0])).dtype == np.int64


def test_bounds_rule_out_and_never_wrongly():
    draw = np.random.default_rng(5)
    centres = draw.integers(-4000, 4000, (8, 64))
    points = centres[draw.integers(0, 8, 4000)] + draw.integers(-60, 60, (4000, 64))
    fixed = points[draw.integers(0, 4000, 8)]
    stored = np.column_stack([np.sqrt(pivots.squared_distances(points, p)) for p in fixed])
    search = PivotSearch(fixed, centres)
    exact = np.column_stack([pivots.squared_distances(points, c) for c in centres])
    assert (search.bounds(stored) <= np.sqrt(exact)).all()
    cluster, distance, tried = search.nearest(points, stored)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    # Vectors in clusters: seldom more than one exact distance each.
    assert len(points) <= tried < 1.2 * len(points)

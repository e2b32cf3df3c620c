import pytest
from pyspark.sql import functions as F

from pathloom.llm import mixing

from .conftest import DOC_SCHEMA, rows_of, words


def expected_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [n for n in names if n not in fixed]
        rate = (total - sum(fixed.values())) / sum(weight[n] for n in rest) if rest else 0
        above = [n for n in rest if weight[n] * rate > cap * sizes[n]]
        if not above:
            return fixed | {n: weight[n] * rate for n in rest}
        fixed |= {n: cap * sizes[n] for n in above}


def test_targets_and_words(spark, odd_docs, odd_rows):
    found = [r.asDict() for r in mixing.mix(odd_docs, group_rows=2).collect()]
    assert len(found) == len(odd_rows)
    source = {}
    for doc_id, text, _, name, _ in odd_rows:
        size = len((text or "").split())
        source[name] = source.get(name, 0) + size
        row = next(r for r in found if r["doc_id"] == doc_id and r["size"] == size)
        row["source"] = name
    targets = expected_targets(source)
    for row in found:
        if "source" in row:
            assert row["source_size"] == source[row["source"]]
            assert row["target"] == pytest.approx(targets[row["source"]])
        assert 0 <= row["taken"] <= 2 * row["size"] and row["taken"] == row["copies"] * row["size"]


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, words(1 + (i * 37) % 300, i), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(900)]
    rows += [(10_000 + i, "same words every time", "en", "hot", 0) for i in range(700)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    mixed = mixing.mix(docs, group_rows=16)
    sums = mixed.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(sums) == len({r[3] for r in rows})
    for row in sums:
        assert abs(row.taken - row.target) <= max(30, 0.01 * row.target)
    assert rows_of(mixed, "doc_id", "copies") == rows_of(mixing.mix(docs.repartition(7), group_rows=16), "doc_id", "copies")


def test_rates_are_exponential_in_size(spark):
    """With a target below the source, longer documents are thinned out more, as the tilt is exponential in their words."""
    rows = [(i, words(10 if i % 2 else 100, i), "en", "a", 0) for i in range(400)] + [(500 + i, words(300, i), "en", "b", 0) for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOC_SCHEMA), weights=(1, 50), share=0.9)
    rate = {r["size"]: r["rate"] for r in mixed.filter("doc_id < 500").groupBy("size").agg(F.avg("copies").alias("rate")).collect()}
    assert 0 < rate[100] < rate[10] < 1
    assert rate[10] ** 10 == pytest.approx(rate[100], abs=0.05)


def test_repeated_rows_and_columns(spark, odd_docs):
    repeated = mixing.repeat_mixed(odd_docs)
    assert repeated.columns == odd_docs.columns
    copies = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(odd_docs).collect()}
    assert repeated.count() == sum(r.copies for r in mixing.mix(odd_docs).collect())
    assert copies[(5, 0)] == 1


def test_empty(no_docs):
    assert mixing.mix(no_docs).collect() == []
    assert mixing.repeat_mixed(no_docs).collect() == []


def test_rates_solve_the_dual(spark):
    """The tilt of each source against bisection over its documents, one by one."""
    import math
    import random

    pick = random.Random(9)
    sizes = {n: [pick.randint(1, 400) for _ in range(50 + 40 * n)] for n in range(5)}
    part = {0: 0.3, 1: 0.9, 2: 1.0, 3: 1.6, 4: 2.0}
    cells = spark.createDataFrame([(n, s, 1) for n, own in sizes.items() for s in own], "source_no long, size long, n long").groupBy("source_no", "size").agg(
        F.sum("n").alias("n"))
    targets = spark.createDataFrame([(n, sum(own), part[n] * sum(own)) for n, own in sizes.items()], "source_no long, source_size long, target double")
    found = {r.source_no: r for r in mixing.balance(cells, targets).collect()}
    for n, own in sizes.items():
        mean = sum(own) / len(own)
        assert found[n].mean_size == pytest.approx(mean)
        words_at = lambda theta: sum(s * min(2.0, math.exp(min(theta * s / mean, math.log(2)))) for s in own)  # noqa: B023
        assert words_at(found[n].theta) == pytest.approx(part[n] * sum(own), rel=1e-6)
        if part[n] < 2:
            low, high = -1e4, 1e4
            for _ in range(200):
                middle = (low + high) / 2
                low, high = (middle, high) if words_at(middle) < part[n] * sum(own) else (low, middle)
            assert found[n].theta == pytest.approx(low, rel=1e-3, abs=1e-4)


def test_rounding_makes_up_for_longer_documents():
    """Copies by size against the same rule with fractions, one size after the other."""
    import random
    from fractions import Fraction

    import pandas as pd

    pick = random.Random(2)
    rows = [(1, s, pick.randint(1, 9), pick.randint(0, 2 * 10**9)) for s in pick.sample(range(1, 500), 60)]
    table = pd.DataFrame(rows, columns=["source_no", "size", "n", "rate"])
    copies = dict(
        mixing._whole_copies(2.0)(table)[["size", "copies"]].itertuples(index=False, name=None))
    owed = Fraction(0)
    for _, size, n, rate in sorted(rows, key=lambda r: -r[1]):
        owed += Fraction(rate, 10**9) * n * size
        k = min(max((owed / size + Fraction(1, 2)).__floor__(), 0), 2 * n)
        owed -= k * size
        assert copies[size] == k

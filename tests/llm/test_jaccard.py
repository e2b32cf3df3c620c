import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import jaccard
from pathloom.llm.components import components

from .conftest import DOC_SCHEMA, words
from .test_text import shingles


def brute_force(rows, percent=80):
    """Component of each id by comparing all pairs."""
    sets = [(i, shingles(t or "")) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i, _ in sets}


def family(seed, copies, size, edits):
    """Near copies of one text with random edits, some beyond the threshold."""
    pick = random.Random(seed)
    base = words(size, seed, 10_000).split()
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(pick.randrange(edits + 1)):
            text[pick.randrange(size)] = f"edit{pick.random()}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [3, 512])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    passage = words(60, 99)
    texts = [t for seed in range(6) for t in family(seed, 12, 40 + 30 * seed, 6)]
    texts += [f"{words(20, 200 + i)} {passage} {words(i, 300 + i)}" for i in range(25)]
    texts += ["a b c", "A  b\tc", "a b c d", "", "   ", None, *["the same text five times over"] * 5]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA).repartition(4)
    found = jaccard.similar_documents(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_force(rows)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t or "")) for i, t in rows}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_force(rows).values()))


def test_odd_rows(odd_docs, odd_rows):
    found = jaccard.similar_documents(odd_docs).collect()
    assert len(found) == len(odd_rows)
    expected = brute_force([(i, t) for i, t, *_ in odd_rows if i is not None])
    for row in found:
        assert row.component_id == (None if row.doc_id is None else expected[row.doc_id])
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 0 and ids.count(1) == 1 and ids.count(None) == 2


def test_repeated_row_that_is_kept(spark):
    docs = spark.createDataFrame([(1, "x y z", None, None, None)] * 3 + [(2, "other", None, None, None)], DOC_SCHEMA)
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 2]


def test_empty(no_docs):
    assert jaccard.similar_documents(no_docs).collect() == []
    assert jaccard.keep_one(no_docs).collect() == []


def test_classes_count_all_sets(spark):
    pick = np.random.default_rng(3)
    common = pick.integers(0, 2**64, 1, np.uint64)
    sets = [np.unique(np.concatenate([pick.integers(0, 2**64, i % 9, np.uint64), common])) for i in range(700)]
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, set binary").repartition(5)
    counts = np.zeros(1 << jaccard.SLOT_BITS, np.int64)
    for s in sets:
        for value in s.tolist():
            counts[value >> (64 - jaccard.SLOT_BITS)] += 1
    found = jaccard.frequency_classes(rows)
    assert found.tolist() == [int(c).bit_length() for c in counts] and found.max() == 10
    # The shingle that all sets share is the last of their order.
    assert not any(common[0] in jaccard.prefix(s, found, 80) for s in sets if len(s) > 1)
    assert jaccard.frequency_classes(rows.limit(0)).max() == 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=20), st.integers(0, 2**32))
def test_prefixes_of_linked_sets_meet(sets, seed):
    sets = [np.array(sorted(x << (64 - jaccard.SLOT_BITS) for x in s), np.uint64) for s in sets]
    classes = np.random.default_rng(seed).integers(0, 6, 1 << jaccard.SLOT_BITS).astype(np.uint8)
    for x, y in combinations(sets, 2):
        if jaccard.links(len(x), len(y), len(np.intersect1d(x, y)), 80):
            assert set(jaccard.prefix(x, classes, 80).tolist()) & set(jaccard.prefix(y, classes, 80).tolist())


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=2, max_size=30), st.integers(2, 8))
def test_the_tree_loses_no_pair(sets, leaf):
    sets = [np.array(sorted(s), np.uint64) for s in sets]
    tree = jaccard.CountTree(jaccard.count_vectors(sets, 8), leaf)
    for place in range(len(sets)):
        found = {int(x) for near in tree.candidates(tree.counts[place], 80, lambda a, b: False) for x in near}
        for other in range(len(sets)):
            x, y = sets[tree.order[place]], sets[tree.order[other]]
            if jaccard.links(len(x), len(y), len(np.intersect1d(x, y)), 80):
                assert other in found


def test_components_of_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    shuffled = [(7, 3), (3, 9), (9, 7), (1, 1), (20, 21), (21, 20)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + shuffled, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3, 20: 20, 21: 20}

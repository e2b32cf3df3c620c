import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.operators import word_blocks
from pathloom.operators.word_blocks import blocks_for, cell_pairs, numbered_words, shares_for, train_cell, word_vectors_in_blocks
from pathloom.operators.word_vectors import word_vectors

SCHEMA = "split_url array<string>"


def planted(spark, groups=4, own=15, rows=900):
    """Rows of words of one group each; the first word of a group is frequent."""
    draw = random.Random(3)
    table = []
    for _ in range(rows):
        g = draw.randrange(groups)
        table.append(([f"g{g}w{min(draw.randrange(own), draw.randrange(own))}" for _ in range(draw.randint(2, 8))],))
    return spark.createDataFrame(table, SCHEMA).repartition(3)


def nearest_groups(vectors):
    names, x = zip(*[(r.word, r.vector.toArray()) for r in vectors.collect()])
    x = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    return [names[i][:2] == names[j][:2] for i, j in enumerate(near.argmax(axis=1))], names


def test_words_of_a_group_are_near_each_other(spark):
    corpus = planted(spark)
    same, names = nearest_groups(word_vectors_in_blocks(corpus, 3, 16, blocks=3))
    assert sorted(names) == sorted(r.word for r in corpus.select(F.explode("split_url").alias("word")).distinct().collect())
    assert np.mean(same) > 0.95


def test_large_models_are_trained_in_blocks(spark):
    corpus = planted(spark, rows=300)
    vectors = word_vectors(corpus, 2, 8, model_values=100)
    assert vectors.columns == ["word", "vector"] and len(vectors.first().vector) == 8
    assert vectors.count() == corpus.select(F.explode("split_url")).distinct().count()


def test_pairs_are_those_of_the_windows(spark):
    rows = [["a", "b", "c", "a"], ["b"], [], ["c", "d", None, "e"], None, ["a", "b", "c", "a"]]
    split = spark.createDataFrame([(r,) for r in rows], SCHEMA).repartition(2)
    for blocks in (1, 2, 3):
        words = numbered_words(split, blocks)
        name = {(r.block, r.place): r.word for r in words.collect()}
        found = Counter()
        for r in cell_pairs(split, words, blocks, 2).collect():
            for first, second in np.frombuffer(r.pairs, np.int32).reshape(-1, 2).tolist():
                found[name[r.block, first], name[(r.block + r.stratum) % blocks, second]] += 1
        expected = Counter()
        for row in rows:
            known = [w for w in row or [] if w is not None]
            expected.update((v, w) for i, v in enumerate(known) for j, w in enumerate(known) if i != j and abs(i - j) <= 2)
        assert found == expected


def test_blocks_deal_words_by_rank(spark):
    split = spark.createDataFrame([(["a"] * 5 + ["b"] * 4 + ["c"] * 3 + ["d"],)], SCHEMA)
    rows = {r.word: (r["count"], r.block, r.place) for r in numbered_words(split, 2).collect()}
    assert rows == {"a": (5, 0, 0), "b": (4, 1, 0), "c": (3, 0, 1), "d": (1, 1, 1)}
    assert blocks_for(10, 100) == 1 and blocks_for(3_000_000, 100) > 10


def test_more_blocks_than_words_and_no_words(spark):
    split = spark.createDataFrame([(["a", "b", "a"],)], SCHEMA)
    assert {r.word for r in word_vectors_in_blocks(split, 2, 4, blocks=5, epochs=1).collect()} == {"a", "b"}
    assert word_vectors_in_blocks(split.where("false"), 2, 4, blocks=2, epochs=1).collect() == []


def test_repeats(spark):
    corpus = planted(spark, rows=200).coalesce(1)
    runs = [{r.word: r.vector.toArray().tolist() for r in word_vectors_in_blocks(corpus, 2, 6, blocks=2, epochs=2).collect()} for _ in "ab"]
    assert runs[0] == runs[1]


def plain_training(inputs, outputs, chances, pairs, draw, rate=word_blocks.RATE):
    """Pair by pair, word by word."""
    size = inputs.shape[1] - 1
    for start in range(0, len(pairs), word_blocks.BATCH):
        batch = pairs[start:start + word_blocks.BATCH]
        drawn = np.searchsorted(chances, draw.random((len(batch), word_blocks.NEGATIVES)) * chances[-1])
        steps = [np.zeros((len(m), size)) for m in (inputs, outputs)]
        touched = [np.zeros(len(m), bool) for m in (inputs, outputs)]
        for (centre, near), negative in zip(batch, drawn):
            for other, wanted in [(near, 1), *((min(o, len(outputs) - 1), 0) for o in negative)]:
                score = 1 / (1 + np.exp(-float(inputs[centre, :size] @ outputs[other, :size])))
                error = 0 if other == near and not wanted else score - wanted
                steps[0][centre] += error * outputs[other, :size]
                steps[1][other] += error * inputs[centre, :size]
                touched[0][centre] = touched[1][other] = True
        for matrix, total, some in zip((inputs, outputs), steps, touched):
            matrix[some, size] += (total[some] ** 2).mean(axis=1)
            matrix[some, :size] -= rate * total[some] / np.sqrt(matrix[some, size, None] + 1e-8)


@pytest.mark.parametrize("words", [(5, 9), (200, 7), (300, 200)])
def test_training_is_that_of_a_plain_loop(words):
    draw = np.random.default_rng(4)
    start = [((draw.random((n, 7)) - 0.5) * [*[1] * 6, 0]).astype(np.float32) for n in words]
    pairs = np.column_stack([draw.integers(0, n, 600) for n in words]).astype(np.int32)
    chances = np.cumsum(draw.random(words[1]))
    got, want = [m.copy() for m in start], [m.astype(np.float64) for m in start]
    train_cell(*got, chances, pairs, np.random.default_rng(5))
    plain_training(*want, chances, pairs, np.random.default_rng(5))
    for a, b in zip(got, want):
        assert np.allclose(a, b, atol=1e-4)


def test_cells_of_many_pairs_are_dealt_to_tasks(spark, monkeypatch):
    corpus = planted(spark, rows=4000)
    monkeypatch.setattr(word_blocks, "CHUNK_PAIRS", 200)
    dealt = []
    stratum = word_blocks._stratum
    monkeypatch.setattr(word_blocks, "_stratum", lambda *args: dealt.append(args[6]) or stratum(*args))
    vectors = word_vectors_in_blocks(corpus, 3, 16, blocks=2, share_bytes=30_000)
    same, names = nearest_groups(vectors)
    assert min(dealt) >= 4 and len(names) == corpus.select(F.explode("split_url")).distinct().count()
    assert np.mean(same) > 0.95


def test_shares_go_by_pairs(spark):
    pairs = spark.createDataFrame([(0, 0, b"x" * 800), (0, 0, b"y" * 900), (1, 0, b"z" * 100)], "stratum int, block int, pairs binary")
    assert [shares_for(pairs, 1, 1, 1, size) for size in (10_000, 1_700, 800)] == [1, 1, 3]  # of 1,700 bytes
    assert shares_for(pairs, 1_000_000, 100, 1, 800) == 1 and shares_for(pairs.where("false"), 1, 1, 1) == 1


def test_means_of_the_shares_that_moved_a_word():
    rows = [([[1, 1], [4, 4], [9, 9]], [1, 0, 0]), ([[3, 5], [6, 2], [9, 9]], [1, 1, 0]), ([[7, 7], [8, 8], [9, 9]], [0, 1, 0])]
    values = [np.array(m, np.float32).tobytes() for m, _ in rows], [np.array(moved, bool).tobytes() for _, moved in rows]
    batch = pa.RecordBatch.from_pydict({"block": pa.array([2] * 3, pa.int32()), "inputs": values[0], "outputs": values[0], "inputs_moved": values[1], "outputs_moved": values[1]})
    (found,) = word_blocks._means(1)(iter([batch]))
    for name in ("inputs", "outputs"):
        assert np.frombuffer(found[name][0].as_py(), np.float32).reshape(-1, 2).tolist() == [[2, 3], [7, 5], [9, 9]]

import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import toxicity
from pathloom.llm.folds import held_out

from .conftest import DOC_SCHEMA, words

BAD = {"en": ["vile", "rotten"], "fr": ["zutanc", "zutard", "zutois", "zuteux", "zutin"]}
LABELS = "doc_id long, toxic int"


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        pick = random.Random(i)
        lang = pick.choice(["en", "fr"])
        text = words(pick.randint(5, 200), i).replace("w", "le" if lang == "fr" else "th").split()
        toxic = i % 5 == 0
        for _ in range(pick.randint(1, 3) if toxic else 0):
            text.insert(pick.randrange(len(text)), pick.choice([str, str.upper, lambda w: w + "%%,"])(pick.choice(BAD[lang])))
        rows.append((i, " ".join(text), lang, None, None))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = corpus(900)
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def model(data):
    docs, labels = data
    return toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))), sample=400)


def test_held_out_accuracy(data, model):
    docs, labels = data
    rows = docs.join(labels, "doc_id").filter(held_out(F.col("doc_id"))).select("toxic", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert len(rows) > 100
    assert all(0 <= r.s <= 1 for r in rows)
    wrong = sum((r.s >= toxicity.THRESHOLD) != bool(r.toxic) for r in rows)
    assert wrong <= 0.03 * len(rows)


def test_unseen_forms_of_a_stem(spark, model):
    texts = [(1, words(50, 5) + " zutement " + words(50, 6)), (2, words(100, 7))]
    rows = {r.i: r.s for r in spark.createDataFrame(texts, "i long, text string").select("i", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert rows[1] > rows[2]


def test_words_and_language_do_not_depend_on_the_batch(spark, data, model):
    docs = data[0].filter("doc_id < 40")
    one = {r.doc_id: r.s for r in docs.repartition(1).select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    many = {r.doc_id: r.s for r in docs.repartition(9).select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert one == pytest.approx(many, abs=1e-5)


def test_odd_rows(spark, odd_docs, model):
    kept = toxicity.keep_clean(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() > 0
    scores = odd_docs.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scores)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (99, 1)], LABELS)
    assert toxicity.fit(odd_docs, labels).weights.shape == (24,)


def test_no_rows(spark, no_docs):
    nothing = toxicity.fit(no_docs, spark.createDataFrame([], LABELS))
    assert toxicity.keep_clean(no_docs, nothing).collect() == []
    docs = spark.createDataFrame([(1, "a b", None, None, None)], DOC_SCHEMA)
    assert 0 <= docs.select(toxicity.score(nothing, F.col("text"))).first()[0] <= 1


def test_thresholds_do_not_depend_on_the_share_of_a_label_in_the_sample(spark):
    # One text in ten is toxic; a word stands in most toxic texts and in a fifth of the clean ones, which are more.
    rows, labels = [], []
    for i in range(4000):
        pick = random.Random(i)
        toxic = i % 10 == 0
        rows.append((i, words(30, i) + (" vile" if pick.random() < (0.6 if toxic else 0.2) else ""), "en", None, None))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, DOC_SCHEMA).repartition(4).cache(), spark.createDataFrame(labels, LABELS)
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").select(docs["*"]).filter("text like '%vile'")
    for sample in (4000, 400):
        assert toxicity.keep_clean(clean, toxicity.fit(docs, labels, sample=sample)).count() > 0.9 * clean.count()


def test_the_sample_is_not_cut():
    assert toxicity.SAMPLE >= 3000


def test_scores_against_slow_loops(model):
    """Every window of every text by itself: sums of embeddings, filters, the largest response, the logistic layer."""
    import math

    import numpy as np
    import pyarrow as pa

    rows, _ = corpus(25)
    texts = [text for _, text, *_ in rows] + ["", "one", "vile rotten", "%% 12"]
    found = model.score(pa.array(texts))
    for text, score in zip(texts, found):
        hashes, _ = toxicity.hashed_words(pa.array([text]))
        known = [model.rows(h) for h in hashes]
        edge = model.embeddings[1] * (1 + len(toxicity.STARTS))
        # Two edges behind the text stand for the words that a window lacks there.
        vectors = [sum(model.embeddings[r] for r in own) for own in known]
        last = max(toxicity.WIDTHS) - 1
        padded = vectors + [edge] * last
        pooled = []
        for taps, bias in zip(model.filters, model.biases):
            width = len(taps)
            windows = [sum(padded[at + j] @ taps[j] for j in range(width)) + bias for at in range(len(padded) - width + 1)]
            pooled += [max(0.0, *(w[f] for w in windows)) if windows else 0.0 for f in range(toxicity.FILTERS)]
        logit = float(np.dot(pooled, model.weights)) + model.bias
        likely = [sum(model.languages[n][own[0]] for own in known) for n in range(len(model.languages))]
        shift = model.shifts[int(np.argmax(likely))]
        assert score == pytest.approx(1 / (1 + math.exp(-(logit + shift))), rel=1e-3, abs=1e-5)

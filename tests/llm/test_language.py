import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import language
from pathloom.llm.folds import held_out

from .conftest import DOC_SCHEMA

SYLLABLES = {"aa": "ba ko mi tu ra ne".split(), "bb": "strom krk vlt zdn prst hlb".split(), "cc": "été çà oeu lle ique ment".split()}


def text(lang, seed, size=60):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices(SYLLABLES[lang], k=pick.randint(1, 3))) for _ in range(size)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(lang, i, 5 + i % 80), lang, None, None) for i, lang in enumerate(list(SYLLABLES) * 80)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs.filter(~held_out(F.col("doc_id"))), sample=60)


def test_held_out_accuracy(docs, model):
    rows = docs.select("lang", held_out(F.col("doc_id")).alias("out"), language.predict(model, F.col("text")).alias("p")).filter("out").collect()
    assert len(rows) > 30
    assert sum(r.lang == r.p.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.p.score <= 1 for r in rows)
    assert sum(r.p.rejected for r in rows) == 0


def test_what_is_far_off_is_rejected(spark, docs, model):
    far = [(1, "жщю яэ ыфв пшгн " * 30, None), (2, "1234 5678 !!", None), (3, None, None), (4, "", None), (5, text("aa", 999), None)]
    rows = {r.doc_id: r.p for r in spark.createDataFrame(far, "doc_id long, text string, lang string").select(
        "doc_id", language.predict(model, F.col("text")).alias("p")).collect()}
    assert rows[1].rejected and rows[1].lang in SYLLABLES
    assert all(rows[i].lang == "und" and rows[i].score == 0 and rows[i].rejected for i in (2, 3, 4))
    assert rows[5].lang == "aa" and not rows[5].rejected


def test_copies_count_alike_and_fits_repeat(docs, model):
    again = language.fit(docs.filter(~held_out(F.col("doc_id"))).repartition(3), sample=60)
    assert again.languages == model.languages
    assert abs(again.centroids - model.centroids).max() < 1e-5


def test_odd_rows(odd_docs, model):
    kept = language.keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept.collect())
    own = language.fit(odd_docs)
    assert set(own.languages) == {"en", "fr", "de", "ja"} or set(own.languages) == {"en", "fr", "ja", "de"}


def test_no_rows(no_docs, odd_docs):
    nothing = language.fit(no_docs)
    assert nothing.languages == []
    rows = odd_docs.select(language.predict(nothing, F.col("text")).alias("p")).collect()
    assert all(r.p.lang == "und" and r.p.rejected for r in rows)
    assert language.keep_known(no_docs, nothing).collect() == []


def test_usual_cosines_come_from_all_texts():
    # The later half of the ids is of another kind; its short pieces must count too.
    import pandas as pd

    texts = [text("aa", i) for i in range(320)] + [text("aa", i) + " 日本語の文" * 200 for i in range(320)]
    seen = []
    work = language._fit_language(pd.Series(1.0, range(language.FEATURES)).to_numpy("f4"), 1, 1)
    counted = language.count_ngrams
    try:
        language.count_ngrams = lambda pieces: seen.extend(pieces) or counted(pieces)
        work(("aa",), pd.DataFrame({"doc_id": range(640), "text": texts}))
    finally:
        language.count_ngrams = counted
    assert sum(len(piece) == 64 for piece in seen) == 640
    assert sum("日" in piece for piece in seen if len(piece) == 64) > 200


def test_cosines_against_slow_loops():
    """Weights, cosines and the rejection of every text by itself."""
    import math

    import numpy as np

    from pathloom.llm import language

    draw = np.random.default_rng(4)
    idf = draw.random(language.FEATURES).astype(np.float32)
    centroids = draw.random((6, language.FEATURES)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    usual = draw.random((6, language._LENGTHS)) * 1.2
    model = language.LanguageModel(idf, ["a", "a", "b", "b", "c", "c"], centroids, usual)
    texts = ["the cat sat on the mat", "Été à la plage", "x", "", "12 !", "日本語", "the " * 300]
    names, scores, rejected = model.predict(texts)
    for text, name, score, far in zip(texts, names, scores, rejected):
        (counts, letters), = language.count_ngrams([text])
        weights = [math.sqrt(n) * float(w) for n, w in zip(counts[0], idf)]
        length = math.sqrt(sum(w * w for w in weights))
        cosines = [sum(w * float(c) for w, c in zip(weights, centre)) / max(length, 1e-9) for centre in centroids]
        best = max(range(6), key=cosines.__getitem__)
        if not any(ch.isalpha() for ch in text):
            assert (name, score, far) == ("und", 0.0, True)
            continue
        assert name == model.languages[best] and score == pytest.approx(min(max(cosines[best], 0), 1), rel=1e-4)
        at = min(int(math.log2(counts.sum() + 1)), language._LENGTHS - 1)
        assert far == (score < language.NEAR * usual[best][at])

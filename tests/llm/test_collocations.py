import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import collocations
from pathloom.llm.collocations import BidirectionalIndex
from tests.llm.conftest import rows_of


def slow_words(text):
    """Lists of words, one for each piece."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def slow_collocations(rows, least, longest=3, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in slow_words(text):
            totals[lang or "und"] += len(piece)
            for n in range(1, longest + 1):
                counts.update((lang or "und", tuple(piece[i:i + n])) for i in range(len(piece) - n + 1))
    candidates = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    out = []
    for (lang, words), a in candidates.items():
        covered = any(other == lang and len(longer) > len(words) and 100 * f >= 50 * a
                      and any(longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1))
                      for (other, longer), f in candidates.items())
        if not covered:
            cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    ranked = []
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(*r, place) for place, r in enumerate(own, 1)]
    return sorted(ranked, key=repr)


COLUMNS = ("lang", "phrase", "a", "l", "r", "n", "score", "rank")


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 4))
def test_index_finds_all_phrases(ids, depth):
    text = np.array([*ids, 0, 0])
    index = BidirectionalIndex(text, max(depth, 1))
    found = index.single_words()
    for length in range(1, depth + 1):
        if length > 1:
            found = (index.to_the_right if length % 2 == 0 else index.to_the_left)(found)
        expected = Counter(tuple(ids[i:i + length]) for i in range(len(ids) - length + 1) if all(ids[i:i + length]))
        assert {tuple(w): n for w, n in zip(found.words.tolist(), found.counts.tolist())} == expected


def test_both_ways_agree():
    """Extended to the right, then to the left, gives the same intervals as the other way round."""
    draw = np.random.default_rng(1)
    text = np.append(draw.integers(0, 6, 400), [0, 0])
    index = BidirectionalIndex(text, 3)
    one = index.to_the_left(index.to_the_right(index.single_words()))
    other = index.to_the_right(index.to_the_left(index.single_words()))
    rows = lambda p: sorted(zip(p.words.tolist(), p.counts.tolist(), p.start.tolist(), p.mirrored.tolist()))
    assert rows(one) == rows(other)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from("abÄ .,\n\t\r\x0b\xa0!Z🙂"), max_size=20), max_size=6))
def test_words(texts):
    array = pa.array(["x. y", *texts], pa.string()).slice(1)
    words, closes = collocations._words(array)
    found, piece = [], []
    for word, last in zip(words.to_pylist(), closes.tolist()):
        piece.append(word)
        if last:
            found.append(piece)
            piece = []
    assert found == [p for text in texts for p in slow_words(text) if p] and not piece


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Éa", "the", "THE", "x-y"]
    rows = []
    for i in range(150):
        text = "".join(pick.choice(words) + pick.choice([" "] * 8 + [", ", ".\n", "\t", "  "]) for _ in range(pick.randrange(80)))
        rows.append((pick.choice(["en", "en", "en", "de", None]), f"{text} new york city {text[:30]} of the the the of" if i % 3 else text))
    return rows


@pytest.mark.parametrize("shard_words", [50, 1 << 20])
def test_against_slow_form(spark, texts, shard_words):
    df = spark.createDataFrame(texts, "lang string, text string").repartition(4)
    found = collocations.collocations(df, shard_words=shard_words)
    assert rows_of(found, *COLUMNS) == slow_collocations(texts, 10)


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths(spark, texts, longest):
    found = collocations.collocations(spark.createDataFrame(texts, "lang string, text string"), least_count=5, words=longest, top=7)
    assert rows_of(found, *COLUMNS) == slow_collocations(texts, 5, longest, 7)


def test_all_of_them(spark, texts):
    df = spark.createDataFrame(texts, "lang string, text string")
    assert rows_of(collocations.collocations(df, least_count=2, top=None), *COLUMNS) == slow_collocations(texts, 2, top=10**6)


def test_full_filter_changes_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "_screen", lambda *args: (np.full(1 << 24, 255, np.uint8), np.uint64(59)))
    df = spark.createDataFrame(texts, "lang string, text string")
    assert rows_of(collocations.collocations(df), *COLUMNS) == slow_collocations(texts, 10)


def test_odd_rows(spark, odd_docs, odd_rows):
    df = odd_docs.withColumns({name: F.lit(name) for name in ("phrase", "f", "words", "a", "l", "r", "n", "rank", "_part", "_k", "block")})
    rows = [(lang, text) for _, text, lang, *_ in odd_rows]
    assert rows_of(collocations.collocations(df, least_count=3), *COLUMNS) == slow_collocations(rows, 3)


def test_one_language_named_und(spark):
    rows = [("und", "a b"), (None, "a b"), ("und", "a b a b")]
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least_count=4), *COLUMNS) == slow_collocations(rows, 4)


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3_000_000_000_007), ("en", "b", 1, 2_999_999_999_999), ("en", "a b", 2, 2_900_000_000_001)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    row = collocations.ranked_phrases(counts, totals, 3, 10).first()
    assert row["score"] == 1_000_000 * 2_900_000_000_001**2 // (3_000_000_000_007 * 2_999_999_999_999)


def test_nothing(spark, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []

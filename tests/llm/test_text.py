import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import text
from pathloom.llm.text import NO_LETTER, shingle_sets, word_hashes

LOWER = {i: i + 32 for i in range(65, 91)}


def split(value):
    return re.findall(r"[^\x20\x09-\x0D]+", value.translate(LOWER))


def shingles(value):
    w = split(value)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


texts = st.lists(st.text(st.sampled_from("aAbBé🙂.'  \t\n\x0b\x1c\xa0"), max_size=40), max_size=12)


@settings(deadline=None)
@given(texts)
def test_words_of_all_texts_are_hashed_in_order(values):
    hashes, first = word_hashes(pa.array(values, pa.string()))
    expected = [w for v in values for w in split(v)]
    assert len(hashes) == len(expected)
    assert np.diff(first).tolist() == [len(split(v)) for v in values]
    by_word = {}
    for h, w in zip(hashes.tolist(), expected):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(deadline=None)
@given(texts)
def test_sets_of_shingles(values):
    for value, found in zip(values, shingle_sets(pa.array(values, pa.string()))):
        assert len(found) == len(shingles(value))
        assert (np.diff(found.astype(object)) > 0).all() if len(found) > 1 else True


def test_hashes_do_not_depend_on_place_or_segment(monkeypatch):
    value = "the quick brown fox jumps over the lazy dog " * 50
    whole = word_hashes(pa.array([value]))[0]
    monkeypatch.setattr(text, "SEGMENT", 64)
    assert (word_hashes(pa.array(["zz", value, ""]))[0][1:] == whole).all()
    assert (word_hashes(pa.array(["zz", value]).slice(1))[0] == whole).all()


def test_first_bytes_and_letters():
    hashes, _ = word_hashes(pa.array(["Idiot%%% idiot! idiots id"]), NO_LETTER, (4,))
    assert hashes[0, 0] == hashes[1, 0] != hashes[2, 0]
    assert hashes[0, 1] == hashes[2, 1] != hashes[3, 1]

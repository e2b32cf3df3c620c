import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm.packing import HarmonicPacker, WordTokenizer, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "<|endoftext|> foo<|startoftext|>!! x", "Don't DON'T it's. we'll,", "\x1cabc\x1fd e", "É́cole École, ΑΣ. ΣΑΣ! İstanbul. ß ẞ",
    "á, 12,5. 3rd. x² ①, ½!", "    \xa0x\x85y　z", "日本語。テスト、です!", "'s 's. a's! ''' x'", "", "🙂🙂 ok🙂.",
    "mixed123abc... 7.", "ﬁne ŉx. ǅ! Ǆ, ǈ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_tokenizer(tokenizer):
    mine = WordTokenizer(PATH, 2)
    for text, ids in zip(ODD, mine.encode(pa.array(ODD))):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def forgetful():
    return WordTokenizer(PATH, 2, known_bytes=50)


@settings(deadline=None, max_examples=300)
@given(texts=st.lists(st.text(max_size=30) | st.text(st.sampled_from("aÉİσΣ'’\u0301 !|<>🙂1²\u2028\x1c"), max_size=12), max_size=5))
def test_ids_of_any_text(tokenizer, forgetful, texts):
    mine = forgetful
    for text, ids in zip(texts, mine.encode(pa.array(texts, pa.string()))):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


@settings(deadline=None)
@given(st.lists(st.integers(1, 300), max_size=120))
def test_packer(lengths):
    packer = HarmonicPacker(64, 8)
    pieces = [p for i, n in enumerate(lengths) for p in packer.add(i, n)] + packer.finish()
    by_document, by_sequence = {}, {}
    for document, start, length, sequence, offset in pieces:
        assert length > 0
        by_document.setdefault(document, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by_document[i]):
            assert start == at
            at += length
        assert at == n
    short = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
        short += 64 - at if at & (at - 1) else 0
    # What is left open are gaps that no whole document was needed for.
    assert short <= 64 * 9


def test_fixed_number_of_documents_per_bin():
    packer = HarmonicPacker(60, 10)
    assert packer.add("a", 25) == []
    first = packer.add("b", 21)
    assert [p[:3] for p in first] == [("a", 0, 25), ("b", 0, 21)] and first[0][3] == first[1][3]


def test_rows(spark, odd_docs, odd_rows, tokenizer):
    found = [r.asDict() for r in pack(odd_docs.repartition(3), PATH).collect()]
    wanted = sorted((i if i is not None else -1, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in odd_rows)
    total = {}
    for row in found:
        assert row["length"] <= 4096
    assert sum(r["length"] for r in found) == sum(n for _, n in wanted)
    texts = {i: t for i, t, *_ in odd_rows}
    for row in found:
        if row["doc_id"] is not None:
            ids = np.array(tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
            assert row["doc_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(ids[row["start"]:row["start"] + row["length"]].tobytes())
        total.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for places in total.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0


def test_empty(no_docs):
    assert pack(no_docs, PATH).collect() == []

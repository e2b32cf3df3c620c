"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Every worker packs the documents of its own partition, so nothing is shuffled. A document longer than the capacity gives whole
sequences; what remains is of class ``i`` if it is at most 1/i of the capacity and more than 1/(i+1). A bin of class
``i`` takes ``i`` documents, whatever they are, and is then closed. The room that closed bins leave is filled with pieces cut from the
documents that arrive while there is more room than a document needs. What is left at the end of a partition is cut into
sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pathloom.llm.text import bound_batches, plain, releasing, row_groups

CAPACITY = 4096
# Classes of documents below 1/CLASSES of the capacity are one class.
CLASSES = 64
# A worker keeps the ids of all different parts of words it has met, and starts anew beyond so many bytes (some five million parts).
KNOWN_BYTES = 64 << 20
_BYTES_AT_ONCE = 2 << 20
_LEARNED_AT_ONCE = 1 << 13
_PART_BITS = 38
# Latin letters whose normal form and lower case are one letter, so that no mark of theirs joins the punctuation behind.
_LAST_LETTER = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$"
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class HarmonicPacker:
    """Places lengths in sequences. ``add`` and ``finish`` return pieces ``(document, start, length, sequence, offset)``."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.sequences = capacity, classes, 0
        self.open: dict[int, list[tuple]] = {}  # class -> documents of its open bin
        self.room: deque = deque()  # (sequence, offset, length) left in closed bins
        self.free = 0

    def _sequence(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, offset, out = self._sequence(), 0, []
        for document, start, length in pieces:
            out.append((document, start, length, sequence, offset))
            offset += length
        if offset < self.capacity:
            self.room.append([sequence, offset, self.capacity - offset])
            self.free += self.capacity - offset
        return out

    def add(self, document, length: int) -> list[tuple]:
        out, start = [], 0
        while length - start >= self.capacity:
            out.append((document, start, self.capacity, self._sequence(), 0))
            start += self.capacity
        rest = length - start
        if not rest:
            return out
        if self.free >= rest:
            return out + self._fill(document, start, length)
        kind = min(self.classes, self.capacity // rest)
        bin_ = self.open.setdefault(kind, [])
        bin_.append((document, start, rest))
        if len(bin_) == kind:
            out += self._close(self.open.pop(kind))
        return out

    def _fill(self, document, start: int, stop: int) -> list[tuple]:
        out = []
        while start < stop:
            slot = self.room[0]
            length = min(slot[2], stop - start)
            out.append((document, start, length, slot[0], slot[1]))
            start, self.free = start + length, self.free - length
            slot[1], slot[2] = slot[1] + length, slot[2] - length
            if not slot[2]:
                self.room.popleft()
        return out

    def finish(self) -> list[tuple]:
        out, rest = [], deque(piece for bin_ in self.open.values() for piece in bin_)
        self.open = {}
        while rest and self.room:
            document, start, length = rest.popleft()
            now = min(length, self.free)
            out += self._fill(document, start, start + now)
            if now < length:
                rest.appendleft((document, start + now, length - now))
        total = sum(length for _, _, length in rest)
        while total:
            size = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= size
            sequence, offset = self._sequence(), 0
            while offset < size:
                document, start, length = rest.popleft()
                now = min(length, size - offset)
                out.append((document, start, now, sequence, offset))
                offset += now
                if now < length:
                    rest.appendleft((document, start + now, length - now))
        return out


class WordTokenizer:
    """Ids of a text as bytes of little-endian 32-bit numbers.

    The vocabulary drops white space, never joins across it, lowers case and parts letters from punctuation. So a word is cut into what
    ends with a letter and the ASCII punctuation behind it, and each different part is tokenized once and looked up from then on.
    """

    def __init__(self, path: str, end_id: int, known_bytes: int = KNOWN_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known_bytes = Tokenizer.from_file(path), known_bytes
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], "<u4").tobytes()
        self._forget()

    def _forget(self) -> None:
        """The known parts are one array of texts; the ids of part ``i`` are those from ``starts[i]`` to ``starts[i + 1]``. Parts are found by
        their hashes, which are sorted beside their places."""
        self.parts, self.ids, self.starts = pa.array([""]), np.empty(0, self.kind), np.zeros(2, np.int64)
        self.hashes, self.place_of = np.array([hash("")]), np.zeros(1, np.int32)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Of texts without nulls, each with the end id."""
        lists = pc.ascii_split_whitespace(texts)
        encoded = lists.flatten().dictionary_encode()
        parts = _parts(encoded.dictionary).dictionary_encode()
        place = self._places(parts.dictionary)
        # The ids of a text are gathered by the places of its words, two parts each.
        sizes, starts = np.diff(self.starts)[place], self.starts[place]
        at = parts.indices.to_numpy().reshape(-1, 2)[encoded.indices.to_numpy()].ravel()
        each = sizes[at]
        ends = np.append(0, np.cumsum(each))
        ids = self.ids[np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])].astype("<u4")
        bounds = ends[2 * np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
        return [ids[i:j].tobytes() + self.end for i, j in zip(bounds, bounds[1:])]

    def _places(self, names: pa.Array) -> np.ndarray:
        """Where the different ``names`` stand among the known parts; new ones are learned."""
        texts = names.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(hash, texts), np.int64, len(texts))
        found = self.place_of[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)].astype(np.int64)
        # A part that shares its hash with another one counts as new, so that no hash decides.
        new = pc.not_equal(self.parts.take(pa.array(found)), names).to_numpy(zero_copy_only=False)
        if new.any():
            known = self.parts.nbytes + self.ids.nbytes + self.starts.nbytes + self.hashes.nbytes + self.place_of.nbytes
            if len(self.parts) > 1 and known > self.known_bytes:
                self._forget()
                return self._places(names)
            found[new] = self._learn([texts[n] for n in np.flatnonzero(new)], hashes[new])
        return found

    def _learn(self, names: list[str], hashes: np.ndarray) -> np.ndarray:
        """The places of new parts, which are learned few at a time, as the tokenizer's own result is large."""
        return np.concatenate([self._learned(names[i:i + _LEARNED_AT_ONCE], hashes[i:i + _LEARNED_AT_ONCE])
                               for i in range(0, len(names), _LEARNED_AT_ONCE)])

    def _learned(self, names: list[str], hashes: np.ndarray) -> np.ndarray:
        alone = np.fromiter(map(str.isalpha, names), bool, len(names))
        letters = [name for name, one in zip(names, alone) if one]
        code = self.tokenizer.encode(" ".join(letters), add_special_tokens=False)
        owner = np.array(code.word_ids, np.int64)
        if len(letters) == (owner[-1] + 1 if len(owner) else 0):
            ids, ends = np.array(code.ids, self.kind), np.searchsorted(owner, np.arange(1, len(letters) + 1))
        else:  # a normal form of a letter is more than one word
            alone[:] = False
            letters, ids, ends = [], np.empty(0, self.kind), np.empty(0, np.int64)
        rest = [name for name, one in zip(names, alone) if not one]
        codes = [code.ids for code in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        each = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, codes), np.int64, len(codes))])
        place = np.empty(len(names), np.int64)
        place[np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])] = len(self.parts) + np.arange(len(names))
        self.parts = pa.concat_arrays([self.parts, pa.array(letters + rest, pa.string())])
        self.ids = np.concatenate([self.ids, ids, np.fromiter(chain.from_iterable(codes), self.kind)])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(each))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.place_of = np.insert(self.hashes, at, hashes[order]), np.insert(self.place_of, at, place[order])
        return place


def _parts(words: pa.StringArray) -> pa.StringArray:
    """Every word as two texts in lower case: up to its last Latin letter, and the punctuation behind. A word that ends otherwise is not cut."""
    heads = pc.utf8_rtrim(words, string.punctuation)
    cut = pc.and_(pc.match_substring_regex(heads, _LAST_LETTER), pc.invert(pc.match_substring(words, "<|")))
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    split = np.empty(2 * len(words) + 1, np.int32)
    split[0::2] = offsets
    split[1::2] = np.where(cut.to_numpy(zero_copy_only=False), offsets[:-1] + pc.binary_length(heads).to_numpy(), offsets[1:])
    return pc.ascii_lower(pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(split), words.buffers()[2]))


_tokenizers: dict[tuple, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """Pack ``docs (doc_id, text)``; other columns are ignored.

    The ids of a document are those of its text, then ``end_id``; a null or empty text has only that. Each id lies in
    exactly one piece. Rows that repeat are packed once each. Returns one row per piece: ``doc_id, start`` (ids of the
    document before it), ``length, ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers), ``doc_tokens,
    sequence_id, offset`` (place in the sequence, without gaps). A sequence holds ``capacity`` ids or, at the end of a
    partition, a power of two. An empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer_path, end_id) not in _tokenizers:
            _tokenizers[tokenizer_path, end_id] = WordTokenizer(tokenizer_path, end_id)
        tokenizer = _tokenizers[tokenizer_path, end_id]
        base = TaskContext.get().partitionId() << _PART_BITS
        packer = HarmonicPacker(capacity, classes)
        waiting: dict[int, list] = {}  # number of a document -> [id, ids, tokens not placed yet]
        number = 0

        def rows(pieces: list[tuple]) -> Iterator[tuple]:
            for document, start, length, sequence, offset in pieces:
                entry = waiting[document]
                doc_id, ids, left = entry
                yield (doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), len(ids) // 4, base + sequence, offset)
                entry[2] = left - length
                if entry[2] == 0:
                    del waiting[document]

        def table(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            found: list[tuple] = []
            doc_ids, texts = batch.column(0).to_pylist(), plain(batch.column(1))
            for start, stop in row_groups(texts, _BYTES_AT_ONCE):
                for doc_id, ids in zip(doc_ids[start:stop], tokenizer.encode(texts.slice(start, stop - start))):
                    waiting[number] = [doc_id, ids, len(ids) // 4]
                    found += rows(packer.add(number, len(ids) // 4))
                    number += 1
            yield table(found)
        yield table(list(rows(packer.finish())))

    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(releasing(work), SCHEMA)

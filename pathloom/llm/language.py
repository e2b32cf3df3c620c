"""Language identification by the nearest centroid.

A text becomes a vector of hashed character n-grams, weighted by TF-IDF and scaled to length 1. Each language has a few centroids,
found by spherical k-means over its labelled texts. A text has the language of the centroid with the highest cosine; it
is rejected if that cosine is far below what texts of its length reach.

Document frequencies cover all labelled texts. The centroids are fitted to a bounded sample, ``sample`` texts per
language, and the usual cosines come from all texts of that sample and a piece of each at every length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.folds import sample_by
from pathloom.llm.text import bound_batches, plain, release_memory, releasing

FEATURES = 4096
CENTROIDS = 4
SAMPLE = 1500
UNKNOWN = "und"
# A cosine below this part of the lowest usual cosine at that length is too far off.
NEAR = 0.6
_LENGTHS = 24
_BLOCK_TEXTS = 64
_BLOCK_CHARS = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, chars = [], 0
    for text in texts:
        block.append(text)
        chars += len(text)
        if len(block) == _BLOCK_TEXTS or chars > _BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def count_ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of ``(counts of each text's hashed bigrams and trigrams, number of letters)``. Runs of other characters than letters are one gap."""
    for block in _blocks(texts):
        lowered = [" " + text.lower() + " " for text in block]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat(np.arange(len(block)), [len(text) for text in lowered])
        letter = _is_letter()[codes]
        letters = np.bincount(owner, letter, len(block))
        kept = letter | np.append(True, letter[:-1]) | np.append(True, owner[1:] != owner[:-1])
        codes, owner = np.where(letter, codes, 32)[kept].astype(np.uint64), owner[kept]
        counts = np.zeros(len(block) * FEATURES, np.float32)
        two = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0xFF51AFD7ED558CCD) + codes[2:] * np.uint64(0x165667B19E3779F9)
        for grams, n in ((two, 2), (three, 3)):
            same = owner[n - 1:] == owner[:len(owner) - n + 1]
            slot = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)
            counts += np.bincount((owner[n - 1:] * FEATURES + slot.astype(np.int64))[same], minlength=len(counts))
        yield counts.reshape(len(block), FEATURES), letters


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES), np.float32))
    usual: np.ndarray = field(default_factory=lambda: np.zeros((0, _LENGTHS)))  # lowest usual cosine by centroid and length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.sqrt(counts) * self.idf
        return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether the text is rejected, for each text."""
        names, scores, rejected = [], [], []
        for counts, letters in count_ngrams(texts):
            if not self.languages:
                names += [UNKNOWN] * len(counts)
                scores.append(np.zeros(len(counts)))
                rejected.append(np.ones(len(counts), bool))
                continue
            cosine = self.vectors(counts) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0).astype(float)
            none = letters == 0
            far = top < NEAR * self.usual[best, _length(counts)]
            names += [UNKNOWN if n else self.languages[b] for n, b in zip(none, best)]
            scores.append(np.where(none, 0.0, top))
            rejected.append(none | far)
        return names, np.concatenate(scores or [np.empty(0)]), np.concatenate(rejected or [np.empty(0, bool)])


def _length(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(int), _LENGTHS - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, texts = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        for counts, _ in count_ngrams(plain(batch.column(0)).to_pylist()):
            found[:-1] += (counts > 0).sum(axis=0)
            texts += len(counts)
    found[-1] = texts
    yield pa.RecordBatch.from_pydict({"feature": pa.array(range(FEATURES + 1), pa.int32()), "texts": found})


def _fit_language(idf: np.ndarray, k: int, seed: int):
    def work(key, table):
        import pandas as pd  # workers that only predict do without it

        texts = table.sort_values("doc_id")["text"].tolist()
        model = LanguageModel(idf)
        x = np.concatenate([model.vectors(counts) for counts, _ in count_ngrams(texts)])
        random = np.random.default_rng(seed)
        centres = x[random.permutation(len(x))[:k]]
        for _ in range(15):
            nearest = (x @ centres.T).argmax(axis=1)
            sums = np.array([x[nearest == i].sum(axis=0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        # Pieces of all texts show which cosines are usual at each length.
        seen: list[list[float]] = [[] for _ in range(_LENGTHS)]
        for size in (None, 8, 16, 32, 64, 128, 256, 512, 1024, 4096):
            pieces = texts
            if size:
                starts = [int(random.integers(0, max(1, len(text) - size))) for text in texts]
                pieces = [text[start:start + size] for text, start in zip(texts, starts)]
            for counts, letters in count_ngrams(pieces):
                top = (model.vectors(counts) @ centres.T).max(axis=1)
                for length, cosine, any_letter in zip(_length(counts), top, letters):
                    if any_letter:
                        seen[length].append(float(cosine))
        usual = np.array([np.quantile(s, 0.002) if len(s) >= 30 else np.nan for s in seen])
        known = np.flatnonzero(~np.isnan(usual))
        # Lengths that were not seen take the value of the next shorter one; the shortest texts are never too far off.
        usual = np.array([usual[known[known <= i][-1]] if (known <= i).any() else 0.0 for i in range(_LENGTHS)])
        usual[:4] = 0.0
        return pd.DataFrame({"lang": [key[0]] * len(centres), "centroid": [c.astype("<f4").tobytes() for c in centres],
                             "usual": [usual.tolist()] * len(centres)})

    return work


def fit(docs: DataFrame, *, centroids: int = CENTROIDS, sample: int = SAMPLE, seed: int = 1) -> LanguageModel:
    """Learn from all rows of ``docs (doc_id, text, lang)`` with text and language. Without such rows the model knows no language
    and rejects every text."""
    bound_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null and text != ''")
    rows = known.select("text").mapInArrow(releasing(_frequencies), "feature int, texts long").groupBy("feature").agg(F.sum("texts")).collect()
    found = np.zeros(FEATURES + 1)
    for feature, texts in rows:
        found[feature] = texts
    idf = np.log((found[-1] + 1) / (found[:-1] + 1)).astype(np.float32) + np.float32(0.05)
    parts = sample_by(known, "lang", "doc_id", sample).groupBy("lang").applyInPandas(
        _fit_language(idf, centroids, seed), "lang string, centroid binary, usual array<double>").orderBy("lang", "centroid").collect()
    if not parts:
        return LanguageModel(idf)
    return LanguageModel(idf, [p.lang for p in parts], np.array([np.frombuffer(p.centroid, "<f4") for p in parts]),
                         np.array([p.usual for p in parts]))


def predict(model: LanguageModel, text: Column) -> Column:
    """``lang, score, rejected`` of a text. A null text or one without a letter is ``und`` with score 0, and rejected."""

    @F.arrow_udf("lang string, score double, rejected boolean")
    def work(column: pa.Array) -> pa.Array:
        names, scores, rejected = model.predict(plain(column).to_pylist())
        release_memory()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                                          names=["lang", "score", "rejected"])

    return work(text)


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose text the model doesn't reject, with all their columns."""
    return docs.filter(~predict(model, F.col("text"))["rejected"])

"""Toxic texts by a convolutional classifier over hashed word embeddings, trained in numpy.

Words of letters (case and punctuation ignored) are hashed, whole and by their first bytes, so that forms of one stem share
a part. The hashes seen in training have embeddings, which add up to that of the word; all others are neutral. Filters over one,
two and three words are max-pooled over the whole text and a logistic layer weighs them. A threshold for each language, guessed from
the words themselves, is calibrated on labelled texts kept out of training; scores are shifted so that it lies at ``THRESHOLD``.

The labelled sample is bounded: ``sample`` texts of either label. In calibration each text stands for as many as there are labelled
ones of its label for one in the sample, so that thresholds do not depend on how much of either label the sample holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.folds import count_by, sample_by
from pathloom.llm.text import NO_LETTER, bound_batches, plain, release_memory, row_groups, word_hashes

THRESHOLD = 0.3
SAMPLE = 3000
# Hashes with an embedding, the most frequent ones of the sample.
WORDS = 60_000
STARTS = (4, 6)
DIMENSIONS = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 4
LEAST_STEPS = 200
BATCH = 64
RATE = 0.08
# Bytes of text.
_SCORED_AT_ONCE = 1 << 18


_EDGE = np.ones((1, 1 + len(STARTS)), np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of every word, whole and of its first bytes, and for each text the number of words before it."""
    hashes, first = word_hashes(column, NO_LETTER, STARTS)
    return (hashes >> np.uint64(32)).astype(np.uint32), first


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted hashes with an embedding; row 0 of the embeddings is any other word, row 1 the edge of a text
    embeddings: np.ndarray
    filters: list[np.ndarray]  # by width: (width, dimensions, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: np.ndarray  # (language, embedding row): log-probability of a word
    shifts: np.ndarray  # by language, added to the logit

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(hashes.shape, np.int32)
        place = np.searchsorted(self.words, hashes)
        place[place == len(self.words)] = 0
        return np.where(self.words[place] == hashes, place + 2, 0).astype(np.int32)

    def pooled(self, rows: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Pooled filters of each text, with the convolutions, the words with edges, and where each text starts among them.

        :param rows: embedding rows of each different word; the first one is the edge of a text.
        :param words: the words of all texts, as indices of ``rows``.
        """
        last = max(WIDTHS) - 1
        sizes = np.diff(first)
        starts = first[:-1] + last * np.arange(len(sizes))
        padded = np.zeros(len(words) + last * len(sizes) + last, np.int64)
        padded[np.arange(len(words)) + last * np.repeat(np.arange(len(sizes)), sizes)] = words
        total = len(padded) - last
        embedded = self.embeddings[rows].sum(axis=1)
        maps = []
        for taps, bias in zip(self.filters, self.biases):
            parts = embedded @ taps  # (width, word, filter): each word is multiplied once, however often it occurs
            z = parts[0][padded[:total]]
            for j in range(1, len(taps)):
                z += parts[j][padded[j:total + j]]
            z = np.maximum(z + bias, 0)
            for j in range(1, len(taps)):  # windows that would reach into the next text
                z[starts + sizes + last - j] = 0
            maps.append(z)
        pooled = np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in maps], axis=1) if len(sizes) else np.zeros((0, len(self.weights)))
        return pooled, maps, padded, starts

    def guess(self, rows: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most likely language of each text by its known words."""
        of_word = self.languages[:, rows[:, 0]]
        sums = np.zeros(len(words) + 1)
        best, language = np.full(len(first) - 1, -np.inf), np.zeros(len(first) - 1, np.int64)
        for n, own in enumerate(of_word):
            np.cumsum(own[words], out=sums[1:])
            likely = sums[first[1:]] - sums[first[:-1]]
            language[likely > best] = n
            best = np.maximum(best, likely)
        return language

    def logits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, places, words = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
        rows = np.concatenate([_EDGE, self.rows(hashes[places])])
        pooled = self.pooled(rows, words + 1, first)[0]
        return pooled @ self.weights + self.bias, self.guess(rows, words + 1, first)

    def score(self, column: pa.Array) -> np.ndarray:
        column, scores = plain(column), []
        for start, stop in row_groups(column, _SCORED_AT_ONCE):
            logits, language = self.logits(*hashed_words(column.slice(start, stop - start)))
            scores.append(_sigmoid(logits + self.shifts[language]))
        return np.concatenate(scores or [np.empty(0)])


def _train(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], seed: int, stands_for: tuple[float, float]) -> ToxicityModel:
    """``stands_for``: how many labelled texts a clean and a toxic text of the sample stand for."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(texts))
    held = order[:max(1, len(order) // 5)]
    fitted = order[len(held):]
    uniques = [np.unique(texts[i]) for i in fitted]
    words, seen = np.unique(np.concatenate(uniques or [np.empty(0, np.uint32)]), return_counts=True)
    often = np.sort(np.argsort(-seen, kind="stable")[:WORDS])
    often = often[seen[often] >= 3]
    words, seen = words[often], seen[often]
    own = np.concatenate([np.empty(0, np.uint32), *(u for u, i in zip(uniques, fitted) if toxic[i])])
    own = own[np.isin(own, words)]
    in_toxic = np.bincount(np.searchsorted(words, own), minlength=len(words))

    names = sorted({lang for lang in langs if lang is not None}) or [""]
    model = ToxicityModel(
        words, random.normal(0, 0.05, (len(words) + 2, DIMENSIONS)).astype(np.float32),
        [random.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], random.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0,
        np.zeros((len(names), len(words) + 2)), np.zeros(len(names)),
    )
    model.embeddings[0] = 0
    # Training starts from what the counts alone say: the first dimension holds log-odds, and one filter looks at it.
    many, few = toxic[fitted].sum() + 1, (~toxic[fitted]).sum() + 1
    odds = np.log((in_toxic + 0.5) / many) - np.log((seen - in_toxic + 0.5) / few)
    model.embeddings[2:, 0] = np.clip(odds - 1, 0, 4) / 4
    model.filters[0][0, :, 0] = 0
    model.filters[0][0, 0, 0] = model.weights[0] = 1

    rows = [model.rows(text) for text in texts]
    for n, name in enumerate(names):
        count = np.ones(len(words) + 2)
        for i in fitted:
            if langs[i] == name:
                count += np.bincount(rows[i][:, 0], minlength=len(count))
        model.languages[n] = np.log(count / count.sum())
        model.languages[n, :2] = 0

    parameters = [model.embeddings, *model.filters, *model.biases, model.weights]
    squares = [np.full_like(p, 1e-3) for p in parameters]
    bias_square = 1e-3
    positive = toxic[fitted].mean() if len(fitted) else 0.5
    importance = np.where(toxic, 0.5 / max(positive, 1e-3), 0.5 / max(1 - positive, 1e-3))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(fitted)))) if len(fitted) else 0):
        fitted = random.permutation(fitted)
        for at in range(0, len(fitted), BATCH):
            batch = fitted[at:at + BATCH]
            first = np.append(0, np.cumsum([len(rows[i]) for i in batch]))
            own = np.concatenate([_EDGE, *(rows[i] for i in batch)])
            pooled, maps, padded, starts = model.pooled(own, np.arange(1, len(own)), first)
            error = (_sigmoid(pooled @ model.weights + model.bias) - toxic[batch]) * importance[batch] / len(batch)
            into_pool = (error[:, None] * model.weights) * (pooled > 0)
            gradients = [np.zeros_like(p) for p in parameters]
            gradients[-1][:] = error @ pooled
            ends = np.append(starts[1:], len(maps[0]))
            for n, (width, taps) in enumerate(zip(WIDTHS, model.filters)):
                top = np.array([maps[n][a:b].argmax(axis=0) + a for a, b in zip(starts, ends)])
                d = into_pool[:, n * FILTERS:(n + 1) * FILTERS]
                gradients[1 + len(WIDTHS) + n][:] = d.sum(axis=0)
                for j in range(width):
                    at_word = own[padded[top + j]]  # (text, filter, rows of the word)
                    gradients[1 + n][j] = np.einsum("bf,bfd->df", d, model.embeddings[at_word].sum(axis=2))
                    each = np.broadcast_to((d[:, :, None] * taps[j].T)[:, :, None, :], (*at_word.shape, DIMENSIONS))
                    np.add.at(gradients[0], at_word.ravel(), each.reshape(-1, DIMENSIONS))
            gradients[0][0] = 0  # words that were not seen often stay neutral
            for p, g, s in zip(parameters, gradients, squares):
                s += g * g
                p -= RATE * g / np.sqrt(s)
            bias_square += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(bias_square)

    model.shifts = _calibrated(model, [texts[i] for i in held], toxic[held], len(names), stands_for)
    return model


def _calibrated(model: ToxicityModel, texts: list[np.ndarray], toxic: np.ndarray, languages: int, stands_for: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Per language the shift that puts its best threshold (fewest errors among all that the texts stand for, in the middle of the gap) at
    ``THRESHOLD``."""
    logits, language = model.logits(np.concatenate([np.empty((0, 1 + len(STARTS)), np.uint32), *texts]), np.append(0, np.cumsum([len(t) for t in texts])).astype(int))

    def best(x: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(x)
        x, y = x[order], y[order]
        wrong = stands_for[1] * np.append(0, np.cumsum(y)) + stands_for[0] * np.append(np.cumsum(~y[::-1])[::-1], 0)
        # No threshold parts equal scores. Of equally good places the middle one.
        wrong = np.where(np.concatenate([[True], x[1:] > x[:-1], [True]]), wrong, np.inf)
        places = np.flatnonzero(wrong == wrong.min())
        i = places[len(places) // 2]
        return float(x[0] - 1 if i == 0 else x[-1] + 1 if i == len(x) else (x[i - 1] + x[i]) / 2)

    at = np.log(THRESHOLD / (1 - THRESHOLD))
    y = toxic.astype(bool)
    whole = best(logits, y) if y.any() and not y.all() else 0.0
    shifts = np.full(languages, at - whole)
    for n in range(languages):
        own = language == n
        # Few texts of a language move its threshold only part of the way.
        if y[own].sum() >= 5 and (~y[own]).sum() >= 5:
            trust = own.sum() / (own.sum() + 100)
            shifts[n] = at - (trust * best(logits[own], y[own]) + (1 - trust) * whole)
    return shifts


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = 1) -> ToxicityModel:
    """Learn from about ``sample`` texts of either label.

    :param docs: ``doc_id, text, lang``.
    :param labels: ``doc_id, toxic`` (0 or 1; null rows are left out; of several labels of one document the highest counts).
    Without labels the model scores every text alike.
    """
    bound_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").filter("toxic is not null and doc_id is not null")
    counts = count_by(known, "toxic")
    chosen = sample_by(known, "toxic", "doc_id", sample, counts).groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic"))

    @F.arrow_udf("binary")
    def hashed(column: pa.Array) -> pa.Array:
        column = plain(column)
        out = []
        for start, stop in row_groups(column):
            hashes, first = hashed_words(column.slice(start, stop - start))
            out += [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        return pa.array(out, pa.binary())

    # Both sides are bounded by the sample: its labels are broadcast and its texts come back as hashes.
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "lang", "_toxic", hashed("text").alias("_words")).toArrow()
    order = pc.sort_indices(rows["doc_id"]).to_pylist()
    # The texts stay where they came; only their order is made.
    words = [np.frombuffer(rows["_words"][i].as_buffer(), np.uint32).reshape(-1, 1 + len(STARTS)) for i in order]
    toxic, langs = np.array(rows["_toxic"].to_pylist(), bool)[order], np.array(rows["lang"].to_pylist(), object)[order].tolist()
    stands_for = tuple(
        sum(own) / max(1, sum(min(sample, n) for n in own)) for own in ([n for value, n in counts.items() if (value > 0) == toxic] for toxic in (False, True)))
    model = _train(words, toxic, langs, seed, stands_for)
    del rows, words
    release_memory()
    return model


def score(model: ToxicityModel, text: Column) -> Column:
    """How likely a text is toxic, 0 to 1; a null text scores like an empty one."""

    @F.arrow_udf("double")
    def work(column: pa.Array) -> pa.Array:
        found = pa.array(model.score(column), pa.float64())
        release_memory()
        return found

    return work(text)


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that score below ``THRESHOLD``, with all their columns."""
    return docs.filter(score(model, F.col("text")) < THRESHOLD)

"""Phrases whose words stand together more often than apart, counted through FM-indexes of shards.

Texts are cut into pieces and words, and the words of one language fill shards of ``SHARD_WORDS``. A shard is a text of word ids with
0 behind every piece; two FM-indexes, of the text and of its mirror image, hold an interval for each phrase. A phrase is extended to the
right by the words in its part of the mirrored BWT and to the left by those in its part of the other one, which gives all
phrases of a bounded length with their counts; the pieces' ends are no words, so no phrase crosses them.

Counts of shards are summed twice. First as hashes, packed by bucket, 4 bytes for a phrase that a shard has once: hashes whose sum stays below
the least count rule out all rare phrases, and those that are left set the bits of a filter of fixed size. Then each shard gives the phrases
that the filter lets pass as texts, and their sums are exact. A full filter would rule out less and change no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.joins import left_join
from pathloom.llm.text import bound_batches, mix, plain, release_memory, row_groups, word_hashes
from pathloom.scale import cut_lineage, number_rows

LEAST_COUNT = 10
WORDS = 3
TOP = 2000
# Percent of a phrase's count with which a longer phrase takes its place.
COVERED = 50
SCALE = 1_000_000
UNKNOWN = "und"
SHARD_WORDS = 1 << 19
# Bits of the filter: 16 MB, whatever the size of the corpus.
FILTER_BITS = 27
# Bytes of packed hashes that one task sums.
BUCKET_BYTES = 16 << 20
_RANK_GROUPS = 32

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_NO_GAP = np.zeros(256, bool)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for every i, ``sizes[i]`` of them."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _HalfIndex:
    """BWT of a text whose suffixes are sorted by their first ``depth`` ids, with the number of an id before any row."""

    def __init__(self, text: np.ndarray, ids: int, depth: int):
        key = text
        for _ in range(depth - 1):
            following = np.append(key[1:], 0)
            span = int(following.max()) + 1
            if ids * span >= 1 << 62:
                following, span = np.unique(following, return_inverse=True)[1], len(text) + 1
            key = text * span + following
        order = np.argsort(key, kind="stable")
        self.bwt = text[order - 1]
        self.rows = len(text)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=ids)))
        self._places = np.sort(self.bwt.astype(np.int64) * self.rows + np.arange(self.rows))

    def extended(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases with rows ``start`` to ``start + size``: every extension by a word in front, as number of the phrase, word, count,
        first row, and the number of rows of the phrase whose id in front is smaller."""
        ids = len(self.first) - 1
        key = np.repeat(np.arange(len(start)), size) * np.int64(ids) + self.bwt[_ranges(start, size)]
        key.sort()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        counts = np.diff(np.append(heads, len(key)))
        phrase, word = np.divmod(key[heads], ids)
        smaller = heads - (np.cumsum(size) - size)[phrase]
        before = np.searchsorted(self._places, word * self.rows + start[phrase]) - self.first[word]
        words = word > 0
        return phrase[words], word[words], counts[words], (self.first[word] + before)[words], smaller[words]


@dataclass
class Phrases:
    """Phrases of one length: ``words`` (a row of ids each), ``counts``, and their first rows in both indexes."""

    words: np.ndarray
    counts: np.ndarray
    start: np.ndarray
    mirrored: np.ndarray

    def only(self, chosen: np.ndarray) -> Phrases:
        return Phrases(self.words[chosen], self.counts[chosen], self.start[chosen], self.mirrored[chosen])


class BidirectionalIndex:
    """FM-indexes of a text of word ids (0 stands behind every piece) and of its mirror image, for phrases up to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int = WORDS):
        ids = int(text.max(initial=0)) + 1
        self.forward = _HalfIndex(text, ids, depth)
        # The mirror image keeps a 0 at its end.
        self.mirror = _HalfIndex(np.append(text[-2::-1], 0).astype(text.dtype), ids, depth)

    def single_words(self) -> Phrases:
        counts = np.diff(self.forward.first)[1:]
        words = np.flatnonzero(counts) + 1
        return Phrases(words[:, None], counts[words - 1], self.forward.first[words], self.mirror.first[words])

    def to_the_right(self, phrases: Phrases) -> Phrases:
        phrase, word, counts, mirrored, smaller = self.mirror.extended(phrases.mirrored, phrases.counts)
        return Phrases(np.column_stack([phrases.words[phrase], word]), counts, phrases.start[phrase] + smaller, mirrored)

    def to_the_left(self, phrases: Phrases) -> Phrases:
        phrase, word, counts, start, smaller = self.forward.extended(phrases.start, phrases.counts)
        return Phrases(np.column_stack([word, phrases.words[phrase]]), counts, start, phrases.mirrored[phrase] + smaller)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in lower case, and for each whether its piece ends with it."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    inside = ~_GAP[data]
    filled = np.diff(offsets) > 0
    starts_text, marks = np.zeros(len(data) + 1, bool), _BREAK[data]
    starts_text[(offsets[:-1] - offsets[0])[filled]] = starts_text[len(data)] = True
    begins = np.flatnonzero(inside & (starts_text[:-1] | ~np.append(False, inside[:-1])[:len(data)]))
    ends = np.flatnonzero(inside & (starts_text[1:] | ~np.append(inside[1:], False)[:len(data)]))
    # A piece ends with a word if a break or the end of a text stands between its last byte and the next word.
    marks |= starts_text[1:]
    before = np.append(0, np.cumsum(marks))
    closes = np.append(before[begins[1:]] > before[ends[:-1]], True)[:len(ends)]
    sizes = ends - begins + 1
    kept = data[inside]
    places = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(places), pa.py_buffer(kept)), closes


class _Shards:
    """Words that wait for their language's next shard."""

    def __init__(self, least: int):
        self.least, self.waiting, self.sizes = least, {}, {}

    def add(self, lang: str, texts: pa.Array) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        for start, stop in row_groups(texts):
            words, closes = _words(texts.slice(start, stop - start))
            self.waiting.setdefault(lang, []).append((words, closes))
            self.sizes[lang] = self.sizes.get(lang, 0) + len(words)
            if self.sizes[lang] >= self.least:
                yield self._taken(lang)

    def rest(self) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        for lang in list(self.waiting):
            yield self._taken(lang)

    def _taken(self, lang: str) -> tuple[str, pa.Array, np.ndarray]:
        parts = self.waiting.pop(lang)
        del self.sizes[lang]
        return lang, pa.concat_arrays([words for words, _ in parts]), np.concatenate([closes for _, closes in parts])


def _seed(lang: str) -> np.uint64:
    return word_hashes(pa.array([f"language {lang}"]), _NO_GAP)[0][0]


class _Shard:
    """One shard: its dictionary, its index, and hashes of its phrases."""

    def __init__(self, lang: str, words: pa.Array, closes: np.ndarray, depth: int):
        self.lang, self.depth, self.n = lang, depth, len(words)
        encoded = words.dictionary_encode()
        self.dictionary = encoded.dictionary
        hashes = word_hashes(self.dictionary, _NO_GAP)[0]
        # A break byte is no part of any word, so every word is one run of bytes here.
        self.hashes = np.append(np.uint64(0), hashes)
        at = np.arange(self.n) + np.append(0, np.cumsum(closes)[:-1]) if self.n else np.empty(0, np.int64)
        text = np.zeros(self.n + int(closes.sum()) + 1, np.int64)
        text[at] = encoded.indices.to_numpy() + 1
        self.index = BidirectionalIndex(text, depth)
        self.seed = _seed(lang)

    def hashed(self, phrases: Phrases) -> np.ndarray:
        """64-bit hashes of phrases, the same in every shard."""
        sums = np.full(len(phrases.counts), self.seed)
        for place, words in enumerate(phrases.words.T):
            sums = mix(sums + self.hashes[words] * _ODD[place % 3])
        return sums

    def phrases(self, passing=None) -> Iterator[tuple[Phrases, np.ndarray]]:
        """Phrases by length with their hashes. ``passing`` tells of hashes which may be frequent; only those are given and extended,
        as no part of a frequent phrase is rare."""
        found = self.index.single_words()
        for length in range(1, self.depth + 1):
            if length > 1:
                found = (self.index.to_the_right if length % 2 == 0 else self.index.to_the_left)(found)
            hashes = self.hashed(found)
            if passing is not None:
                kept = passing(hashes)
                found, hashes = found.only(kept), hashes[kept]
            yield found, hashes

    def texts(self, phrases: Phrases) -> pa.Array:
        columns = [self.dictionary.take(pa.array(words - 1)) for words in phrases.words.T]
        return pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]


def _shards(batches: Iterator[pa.RecordBatch], depth: int, least: int) -> Iterator[_Shard]:
    """:param batches: ``lang, text``."""
    shards = _Shards(least)
    for batch in batches:
        langs, texts = pc.fill_null(batch.column(0).cast(pa.string()), UNKNOWN), plain(batch.column(1))
        for lang in pc.unique(langs).to_pylist():
            for taken in shards.add(lang, texts.filter(pc.equal(langs, lang))):
                yield _Shard(*taken, depth)
                release_memory()
    for taken in shards.rest():
        yield _Shard(*taken, depth)
        release_memory()


def _screen(docs: DataFrame, least_count: int, depth: int, shard_words: int) -> tuple[np.ndarray, np.uint64]:
    """The filter: bits of the hashes that may belong to phrases with ``least_count`` or more occurrences, and the shift that gives the
    bucket of a hash."""
    # About 4 bytes for each of up to ``depth`` phrases that begin with a word of five letters and a space.
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(5, (4 * depth * size // 6 // BUCKET_BYTES).bit_length())
    shift, low = np.uint64(64 - bits), np.uint64(0xFFFFFFFF)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, depth, shard_words):
            parts = [(hashes, phrases.counts) for phrases, hashes in shard.phrases()]
            hashes, counts = (np.concatenate(each) for each in zip(*parts))
            del parts
            bucket = (hashes >> shift).astype(np.int64)
            # Phrases that a shard has once need no count. Larger counts than the least one say no more than it.
            once = counts == 1
            low_part = (hashes & low).astype(np.uint32)
            counts = np.minimum(counts, least_count).astype(np.uint8)
            many = np.argsort(bucket[~once], kind="stable")
            few = np.argsort(bucket[once], kind="stable")
            edges = [np.searchsorted(bucket[part][order], np.arange((1 << bits) + 1)) for part, order in ((~once, many), (once, few))]
            many_hashes, many_counts, few_hashes = low_part[~once][many], counts[~once][many], low_part[once][few]
            cut = [pa.array([values[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
                   for values, edge in ((few_hashes, edges[1]), (many_hashes, edges[0]), (many_counts, edges[0]))]
            table = pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits, dtype=np.int32)), *cut], names=["bucket", "once", "often", "counts"])
            yield table.filter(pa.array((np.diff(edges[0]) > 0) | (np.diff(edges[1]) > 0)))

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, once, often, counts = int(key[0].as_py()), [], [], []
        for batch in batches:
            for target, column, kind in ((once, "once", np.uint32), (often, "often", np.uint32), (counts, "counts", np.uint8)):
                target += [np.frombuffer(value.as_buffer(), kind) for value in batch[column]]
        # Hashes are sorted with their counts below, so that one sort sums them.
        entries = np.concatenate([np.concatenate(once).astype(np.uint64) << np.uint64(8) | np.uint64(1),
                                  np.concatenate(often).astype(np.uint64) << np.uint64(8) | np.concatenate(counts)])
        del once, often, counts
        entries.sort()
        hashes = entries >> np.uint64(8)
        heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[:len(hashes)])
        sums = np.add.reduceat((entries & np.uint64(255)).astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
        frequent = hashes[heads[sums >= least_count]]
        bits_set = np.unique(_filter_bits(frequent | np.uint64(bucket) << shift, shift))
        yield pa.RecordBatch.from_arrays([pa.array(bits_set >> 20, pa.int32()), pa.array(bits_set & 0xFFFFF, pa.int32())], names=["block", "bit"])
        release_memory()

    columns = docs.selectExpr("cast(lang as string) lang", "cast(text as string) text")
    blobs = columns.mapInArrow(packed, "bucket int, once binary, often binary, counts binary")
    found = blobs.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(summed, "block int, bit int")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bitmap per block and task."""
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = batch["block"].to_numpy(), batch["bit"].to_numpy()
            for number in np.unique(block).tolist():
                maps.setdefault(number, np.zeros(1 << 20, bool))[bit[block == number]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(maps), pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], names=["block", "map"])

    # Bits meet in the blocks of the filter; what comes to the driver is the filter, 16 MB at most.
    maps = found.distinct().repartition("block").mapInArrow(blocks, "block int, map binary").toArrow()
    whole = np.zeros((1 << FILTER_BITS - 20, 1 << 17), np.uint8)
    for block, bitmap in zip(maps["block"].to_pylist(), maps["map"]):
        whole[block] |= np.frombuffer(bitmap.as_buffer(), np.uint8)
    return whole.ravel(), shift


def _filter_bits(hashes: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The place in the filter: from the bits of the hash that the sums have kept."""
    kept = (hashes >> shift) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
    return (mix(kept) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def phrase_counts(docs: DataFrame, least_count: int = LEAST_COUNT, depth: int = WORDS, *, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables of ``docs (lang, text)``: ``lang, phrase, words, f`` of all phrases of up to ``depth`` words with ``least_count``
    occurrences or more, and ``lang, n`` of all words. Counts are exact."""
    spark = docs.sparkSession
    bound_batches(spark)
    bitmap, shift = _screen(docs, least_count, depth, shard_words)
    shared = spark.sparkContext.broadcast(bitmap)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "words", "f"]

        def passing(hashes: np.ndarray) -> np.ndarray:
            bit = _filter_bits(hashes, shift)
            return (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)

        for shard in _shards(batches, depth, shard_words):
            yield pa.RecordBatch.from_arrays([pa.array([shard.lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([shard.n], pa.int64())], names=names)
            for phrases, _ in shard.phrases(passing):
                m = len(phrases.counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.lang]).take(pa.array(np.zeros(m, np.int64))), shard.texts(phrases),
                     pa.array(np.full(m, phrases.words.shape[1], np.int32)), pa.array(phrases.counts.astype(np.int64))], names=names)

    columns = docs.selectExpr("cast(lang as string) lang", "cast(text as string) text")
    rows = columns.mapInArrow(counted, "lang string, phrase string, words int, f long")
    sums = cut_lineage(rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("words") == 0) | (F.col("f") >= least_count)))
    shared.destroy()
    totals = sums.filter("words = 0").select("lang", F.col("f").alias("n"))
    return sums.filter("words > 0"), totals


def _key(phrase: Column) -> Column:
    return F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", phrase)


def _numbered(scored: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` within each language, for any number of phrases: numbered over all languages, less the phrases of those before."""
    numbered = cut_lineage(number_rows(scored, [F.asc("lang"), *order], "_at"))
    before = numbered.groupBy("lang").agg((F.min("_at") - 1).alias("_before"))
    return left_join(numbered, before, "lang").withColumn("rank", F.col("_at") - F.col("_before")).drop("_at", "_before")


def ranked_phrases(counts: DataFrame, totals: DataFrame, words: int, top: int | None) -> DataFrame:
    """Scores and ranks from the tables of :func:`phrase_counts`; see :func:`collocations`."""
    known = counts.select(_key(F.col("phrase")).alias("_part"), F.col("f").alias("_f"))
    longer = counts.filter("words > 1").withColumn("_words", F.split("phrase", " "))

    def joined(first: Column | int, size: Column | int) -> Column:
        return F.array_join(F.slice("_words", first, size), " ")

    # A phrase that a much longer one covers is also covered by one of a single word more, as counts only fall with length.
    inner = longer.filter("words > 2").select("lang", "f", F.explode(F.array(
        joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("_inner"))
    most = inner.groupBy(_key(F.col("_inner")).alias("_part")).agg(F.max("f").alias("_longest"))
    kept = left_join(longer.withColumn("_part", _key(F.col("phrase"))), most, "_part").filter(
        F.col("_longest").isNull() | (100 * F.col("_longest") < COVERED * F.col("f"))).drop("_part", "_longest")

    cuts = kept.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = left_join(cuts.withColumn("_part", _key(joined(F.lit(1), F.col("_k")))), known, "_part").withColumn("l", F.col("_f")).drop("_part", "_f")
    cuts = left_join(cuts.withColumn("_part", _key(joined(F.col("_k") + 1, F.col("words") - F.col("_k")))), known, "_part").withColumn("r", F.col("_f"))
    score = F.expr(f"cast((cast(f as decimal(19,0)) * cast(f as decimal(19,0)) * {SCALE}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "_k", F.col("f").alias("a"), "l", "r")).alias("_cut"))
    scored = lowest.select("lang", "phrase", "_cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is None:
        return left_join(_numbered(scored, order), totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    # The first of a language are among the first of its groups, so that no task sees more than so many of each.
    group = F.pmod(F.xxhash64("phrase"), F.lit(_RANK_GROUPS))
    in_group = F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))
    first = scored.withColumn("_group", group).withColumn("_place", in_group).filter(F.col("_place") <= top).drop("_group", "_place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return left_join(ranked, totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, *, least_count: int = LEAST_COUNT, words: int = WORDS, top: int | None = TOP,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best phrases of 2 to ``words`` words of each language of ``docs (lang, text)``; other columns are ignored.

    A-Z are lowered. Texts break into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs; every other character
    belongs to a word. A null text is empty, a null language is ``und``. Rows that repeat count each. A phrase needs ``least_count``
    occurrences. Of all its cuts into two parts the one with the lowest ``floor(SCALE * a * a / (l * r))`` counts, the first of equal ones;
    a, l and r are the occurrences of the phrase and of the parts. A phrase inside a longer one that has at least ``COVERED`` percent of its
    occurrences is left out. Returns ``lang, rank, phrase, a, l, r, n, score``, by score, then occurrences, then phrase, the first ``top``
    of a language (None: all). No documents, or none with a frequent phrase, give no rows.

    Products are decimals of 38 digits, which are exact for up to 10**15 occurrences.
    """
    return ranked_phrases(*phrase_counts(docs, least_count, words, shard_words=shard_words), words, top)

"""The ranked vocabulary, and URLs reduced to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pathloom.functions.lookup import known_terms
from pathloom.operators.terms import explode_terms
from pathloom.scale import BROADCAST_BYTES, HOT_KEYS, ONE_TASK_ROWS, fits_broadcast, join_skewed, number_rows

MIN_COUNT = 10
MAX_RATIO = 0.8


def max_word_count(split: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row ``max_count``: the number of URLs times ``max_ratio``, truncated."""
    return split.agg((F.count(F.lit(1)).cast("double") * F.lit(float(max_ratio))).cast("long").alias("max_count"))


def word_counts(terms: DataFrame) -> DataFrame:
    """``word, count`` over all occurrences, combined on the map side before the shuffle."""
    return terms.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def frequency_filter(counts: DataFrame, split: DataFrame, min_count: int = MIN_COUNT,
                     max_ratio: float = MAX_RATIO) -> DataFrame:
    """Words seen at least ``min_count`` times and less often than the upper bound of :func:`max_word_count`."""
    return counts.where((F.col("count") >= min_count) & (F.col("count") < max_word_count(split, max_ratio).scalar()))


def top_terms(split: DataFrame, k: int, min_count: int = MIN_COUNT, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The ``k`` most frequent words of the vocabulary, without ranking all of it."""
    counts = word_counts(explode_terms(split))
    return frequency_filter(counts, split, min_count, max_ratio).orderBy(F.desc("count"), "word").limit(k)


def _common_words(split: DataFrame, min_count: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``word, count, position`` of all words with at least ``min_count`` occurrences, the most frequent first."""
    counts = word_counts(explode_terms(split)).where(F.col("count") >= min_count)
    return number_rows(counts, [F.desc("count"), F.asc("word")], "position", one_task_rows)


def _rank(common: DataFrame, split: DataFrame, max_ratio: float) -> DataFrame:
    # Words over the upper bound take the first positions, so ranks follow from positions by their number.
    bound = max_word_count(split, max_ratio).scalar()
    too_frequent = common.where(F.col("count") >= bound).agg(F.count(F.lit(1))).scalar()
    return common.where(F.col("count") < bound).select(
        "word", "count", (F.col("position") - too_frequent).alias("word_frequency_order")
    )


def vocabulary(split: DataFrame, min_count: int = MIN_COUNT, max_ratio: float = MAX_RATIO, *,
               one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``word, count, word_frequency_order`` of the kept words; order 1 is the most frequent, ties go by word."""
    return _rank(_common_words(split, min_count, one_task_rows), split, max_ratio)


def prune_terms(terms: DataFrame, words: DataFrame, *, hot: DataFrame | None = None, hot_keys: int = HOT_KEYS,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Terms that are in the vocabulary ``words``, with their ``word_frequency_order``."""
    ranks = words.select("word", "word_frequency_order")
    return join_skewed(terms, ranks, "word", hot=hot, hot_keys=hot_keys, broadcast_bytes=broadcast_bytes)


def regroup_terms(ranked_terms: DataFrame) -> DataFrame:
    """Back to one row per URL: ``id, url, split_url, word_frequency_orders``, both arrays in position order.

    A group is one URL, so its set is as large as the URL has terms; terms of copies of the URL are equal and count once.
    """
    in_order = F.array_sort(F.collect_set(F.struct("pos", "word", "word_frequency_order")))
    return (
        ranked_terms.groupBy("id", "url")
        .agg(in_order.alias("_terms"))
        .select(
            "id",
            "url",
            F.col("_terms.word").alias("split_url"),
            F.col("_terms.word_frequency_order").alias("word_frequency_orders"),
        )
    )


def _rank_in_tasks(split: DataFrame, ranks: DataFrame) -> DataFrame:
    """:func:`prune_terms` and :func:`regroup_terms` for a vocabulary that fits every task and URLs that need no
    combining: each Arrow batch of URLs looks its terms up in the word list, so nothing is spread out or shuffled."""
    table = ranks.toArrow()
    orders = np.array(table["word_frequency_order"].combine_chunks())
    places = {word: place for place, word in enumerate(table["word"].to_pylist())}
    shared = split.sparkSession.sparkContext.broadcast((places, orders))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, order_of = shared.value
        for batch in batches:
            known = known_terms(batch["split_url"], places)
            at = pa.array(known.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(at),
                    batch["url"].take(at),
                    known.regroup(batch["split_url"].flatten().filter(known.found)),
                    known.regroup(pa.array(order_of[known.word_at])),
                ],
                names=["id", "url", "split_url", "word_frequency_orders"],
            )

    rows = split.select("id", "url", "split_url")
    orders_field = StructField("word_frequency_orders", ArrayType(LongType()))
    return rows.mapInArrow(rank, StructType([*rows.schema.fields, orders_field]))


def _one_of_copies(ranked: DataFrame) -> DataFrame:
    """One row per ``id, url``. Copies have equal arrays, so a set of them has one member and combines before the shuffle."""
    arrays = F.collect_set(F.struct("split_url", "word_frequency_orders"))
    return ranked.groupBy("id", "url").agg(F.array_min(arrays).alias("_one")).select("id", "url", "_one.*")


def rank_terms(split: DataFrame, min_count: int = MIN_COUNT, max_ratio: float = MAX_RATIO, *, unique_ids: bool = False,
               hot_keys: int = HOT_KEYS, one_task_rows: int = ONE_TASK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Reduce every URL of ``id, url, split_url`` to its vocabulary words and attach their frequency orders.

    URLs that keep no word are left out. Copies of one ``id, url`` count in the frequencies but give one row. ``id`` may be of
    any type and keeps it. Ranks are attached where the URLs are if the vocabulary fits; then only the removal of copies
    shuffles.

    :param unique_ids: promises that no ``id, url`` has copies. Then, if the vocabulary fits, no shuffle is needed.
    :param hot_keys: words whose terms are not shuffled if the vocabulary doesn't fit.
    :param one_task_rows: how many words may be numbered by one task.
    """
    common = _common_words(split, min_count, one_task_rows)
    words = _rank(common, split, max_ratio)
    if fits_broadcast(words, "word", limit=broadcast_bytes):
        ranked = _rank_in_tasks(split, words.select("word", "word_frequency_order"))
        return ranked if unique_ids else _one_of_copies(ranked)
    # Includes the words that are too frequent to keep: they are no part of the result but would crowd the shuffle.
    hot = common.where(F.col("position") <= hot_keys)
    terms = explode_terms(split)
    return regroup_terms(prune_terms(terms, words, hot=hot, hot_keys=hot_keys, broadcast_bytes=broadcast_bytes))


def dropped_urls(split: DataFrame, ranked: DataFrame) -> DataFrame:
    """``id, url`` of the URLs that kept no word."""
    kept = ranked.select(F.col("id").alias("_id"), F.col("url").alias("_url"))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
    return split.select("id", "url").join(kept, same, "left_anti")

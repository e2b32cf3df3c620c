"""Word vectors, trained by Spark ML's skip-gram model, or in blocks of words where its model would not fit the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.word_blocks import blocks_for, word_vectors_in_blocks

VECTOR_SIZE = 100
WINDOW_SIZES = range(2, 6)
# Rows are trained on in so many parts, whatever the size of the cluster, as the vectors depend on it.
TRAINING_PARTITIONS = 8
# Words times their size. Spark ML keeps the model in one array on the driver and in each task, so larger ones are trained in blocks.
MODEL_VALUES = 2**28


def word_vectors(split: DataFrame, window_size: int, vector_size: int = VECTOR_SIZE, *,
                 num_partitions: int = TRAINING_PARTITIONS, max_iter: int = 1, seed: int = 1,
                 model_values: int = MODEL_VALUES, words: int | None = None) -> DataFrame:
    """``word, vector`` of every word in the term arrays ``split_url``.

    :param num_partitions: training partitions. One partition and a fixed row order give the same vectors each time, but
        then a single task trains on all rows.
    :param model_values: largest number of words times ``vector_size`` that Spark ML trains, whose model lives on the driver. A larger
        vocabulary is trained in blocks of words (:mod:`pathloom.operators.word_blocks`).
    :param words: number of different words, if it is known.
    """
    words = count_words(split) if words is None else words
    if words * vector_size > model_values:
        return word_vectors_in_blocks(split, window_size, vector_size, blocks=max(2, blocks_for(words, vector_size)), seed=seed)
    estimator = Word2Vec(windowSize=window_size, vectorSize=vector_size, minCount=0, maxIter=max_iter, seed=seed,
                         numPartitions=num_partitions, inputCol="split_url", outputCol="url_vector")
    return estimator.fit(split.select("split_url")).getVectors()


def count_words(split: DataFrame) -> int:
    """The number of different words in the term arrays."""
    return split.select(F.explode("split_url").alias("word")).distinct().count()


def word_vectors_by_window(split: DataFrame, window_sizes: Iterable[int] = WINDOW_SIZES,
                           vector_size: int = VECTOR_SIZE, **training) -> DataFrame:
    """``window_size, word, vector``: one training per window size over a corpus that is read once."""
    corpus = split.select("split_url").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        words = count_words(corpus)
        tables = [
            word_vectors(corpus, size, vector_size, words=words, **training).select(F.lit(size).alias("window_size"), "word", "vector")
            for size in window_sizes
        ]
    finally:
        corpus.unpersist()
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result

"""Skip-gram word vectors whose two matrices are split into blocks of words, for vocabularies of any size.

Words are dealt to ``blocks`` blocks by their frequency rank, so that frequent words are spread. Every pair of a word and a word near it belongs to the cell of
their two blocks. Cells that share no block are trained at the same time, each by one task that holds the input vectors of one block and the output
vectors of another; such a set of cells is a stratum, and between two strata the blocks of output vectors move on by one. An epoch is one pass over all
strata, and no task or driver holds more than two blocks. Negative samples are drawn from the block at hand by ``count ** 0.75``; steps are those of Adagrad
with one rate per word. A cell of many pairs is dealt to several tasks, which start from the same two blocks; afterwards a word's vector is the mean
of those tasks that moved it. The number of tasks goes by the pairs alone, so that a cluster of any size trains the same vectors.
The pairs are stored once, by stratum; blocks are checkpointed after each stratum, so a lost executor repeats one stratum at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.scale import cut_lineage, number_rows, shared_dir
from pathloom.schemas import WORD_VECTORS

NEGATIVES = 5
RATE = 0.2
EPOCHS = 5
BATCH = 256
# Bytes of one block's matrix.
BLOCK_BYTES = 64 << 20
# Bytes of the pairs that one task trains, unless its two blocks are so large that moving them would take longer.
SHARE_BYTES = 8 << 20
# Pairs are dealt to tasks in chunks of at most so many.
CHUNK_PAIRS = 1 << 14
# Up to so many words, products with a whole block are faster than picking rows.
FEW_WORDS = 128


def blocks_for(words: int, vector_size: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-4 * words * (vector_size + 1) // block_bytes))


def numbered_words(split: DataFrame, blocks: int) -> DataFrame:
    """``word, count, block, place``: the words of the term arrays, dealt to blocks by rank."""
    counts = split.select(F.explode("split_url").alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    numbered = number_rows(counts, [F.desc("count"), F.asc("word")], "_rank")
    at = F.col("_rank") - 1
    return cut_lineage(numbered.select("word", "count", (at % blocks).cast("int").alias("block"), F.floor(at / blocks).cast("int").alias("place")))


def cell_pairs(split: DataFrame, words: DataFrame, blocks: int, window_size: int) -> DataFrame:
    """``stratum, block, pairs``: the places of all pairs of words at most ``window_size`` apart in a row, packed as 32-bit numbers by cell. ``block`` is
    that of the first word, and ``block + stratum`` that of the second one, counted round."""
    rows = cut_lineage(split.select("split_url")).withColumn("_row", F.monotonically_increasing_id())
    terms = rows.select("_row", F.posexplode("split_url").alias("pos", "word"))
    # Words meet their numbers by a join that Spark splits where a word is frequent; a row's words come together again by its number.
    placed = terms.join(words.select("word", "block", "place"), "word").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("pos", "block", "place"))).alias("_"))
    arrays = placed.select(F.col("_.block").alias("block"), F.col("_.place").alias("place"))
    chunk = CHUNK_PAIRS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["block"]
            sizes = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            block, place = lists.flatten().to_numpy(), batch["place"].flatten().to_numpy()
            cells, pairs = [], []
            for apart in range(1, window_size + 1):
                near = np.flatnonzero(row[apart:] == row[:-apart]) if len(row) > apart else np.empty(0, int)
                for first, second in ((near, near + apart), (near + apart, near)):
                    stratum = (block[second] - block[first]) % blocks
                    cells.append(stratum.astype(np.int64) * blocks + block[first])
                    pairs.append(np.column_stack([place[first], place[second]]).astype(np.int32))
            cell, pair = np.concatenate(cells), np.concatenate(pairs)
            order = np.argsort(cell, kind="stable")
            cell, pair = cell[order], pair[order]
            starts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.arange(len(cell)) % chunk == 0))
            packed = [p.tobytes() for p in np.split(pair, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array((cell[starts] // blocks).astype(np.int32)), pa.array((cell[starts] % blocks).astype(np.int32)), pa.array(packed, pa.binary())],
                names=["stratum", "block", "pairs"])

    return arrays.mapInArrow(pack, "stratum int, block int, pairs binary")


def _sums(at: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places of ``at`` and the sum of ``gradient`` at each."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    return places[starts], np.add.reduceat(gradient[order], starts, axis=0)


def train_cell(inputs: np.ndarray, outputs: np.ndarray, chances: np.ndarray, pairs: np.ndarray, draw: np.random.Generator, rate: float = RATE) -> None:
    """Skip-gram with negative samples over ``pairs`` (place in ``inputs``, place in ``outputs``), in place. The last column of both matrices holds
    the squares of the steps so far. ``chances``: running sum of how likely each output word is drawn."""
    size, words = inputs.shape[1] - 1, len(outputs)
    few = max(len(inputs), words) <= FEW_WORDS
    for start in range(0, len(pairs), BATCH):
        centre, near = pairs[start:start + BATCH].T
        n = len(centre)
        other = np.empty((n, NEGATIVES + 1), np.int64)
        other[:, 0] = near
        np.minimum(np.searchsorted(chances, draw.random((n, NEGATIVES)) * chances[-1]), words - 1, out=other[:, 1:])
        x = inputs[centre, :size]
        y = outputs[:, :size] if few else outputs[other, :size]
        score = np.take_along_axis(x @ y.T, other, 1) if few else np.matmul(y, x[:, :, None])[:, :, 0]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        error[:, 0] -= 1
        # A drawn word that is the near one says nothing.
        error[:, 1:] *= other[:, 1:] != near[:, None]
        if few:
            errors = np.bincount((other + np.arange(n)[:, None] * words).ravel(), error.ravel(), n * words).reshape(n, words).astype(np.float32)
            own = centre == np.arange(len(inputs))[:, None]
            moved, drawn = np.flatnonzero(own.any(axis=1)), np.flatnonzero(np.bincount(other.ravel(), minlength=words))
            totals = (moved, (own.astype(np.float32) @ (errors @ y))[moved]), (drawn, (errors.T @ x)[drawn])
        else:
            totals = _sums(centre, np.matmul(error[:, None], y)[:, 0]), _sums(other.ravel(), (error[:, :, None] * x[:, None]).reshape(-1, size))
        for matrix, (places, total) in zip((inputs, outputs), totals):
            rows = matrix[places]
            rows[:, size] += (total * total).mean(axis=1)
            rows[:, :size] -= rate * total / np.sqrt(rows[:, size, None] + 1e-8)
            matrix[places] = rows


def _matrix(value: bytes, size: int) -> np.ndarray:
    return np.frombuffer(value, np.float32).reshape(-1, size + 1).copy()


def _stratum(pairs: DataFrame, inputs: DataFrame, outputs: DataFrame, weights: DataFrame, stratum: int, blocks: int, shares: int, size: int, seed: int) -> DataFrame:
    """``block, inputs, other, outputs`` after the cells of one stratum have been trained, each by ``shares`` tasks."""
    partner = F.pmod(F.col("block") + stratum, F.lit(blocks))
    moved = outputs.join(weights, "other").withColumn("block", F.pmod(F.col("other") - stratum, F.lit(blocks)))
    none = F.lit(None).cast("binary")
    models = inputs.join(moved, "block").select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("part"),
                                               "inputs", "outputs", "chances", none.alias("pairs"))
    cells = pairs.where(F.col("stratum") == stratum).select("block", F.pmod(F.xxhash64("pairs"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("part"),
                                                           none.alias("inputs"), none.alias("outputs"), none.alias("chances"), "pairs")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a cell's share follow each other, its matrices first; one cell's matrices are held at a time.
        key, own, other, before = None, None, None, None

        def done() -> pa.RecordBatch:
            values = [own, other, *(matrix[:, size] != squares for matrix, squares in zip((own, other), before))]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]],
                                              names=["block", "share", "inputs", "outputs", "inputs_moved", "outputs_moved"])

        for batch in batches:
            for block, share, part, a, b, c, p in zip(*[batch[name] for name in ("block", "share", "part", "inputs", "outputs", "chances", "pairs")]):
                if part.as_py() == 0:
                    if key is not None:
                        yield done()
                    key, own, other = (block.as_py(), share.as_py()), _matrix(a.as_buffer(), size), _matrix(b.as_buffer(), size)
                    before = own[:, size].copy(), other[:, size].copy()
                    chances = np.frombuffer(c.as_buffer(), np.float64)
                    draw = np.random.default_rng([seed, stratum, *key])
                else:
                    cell = np.frombuffer(p.as_buffer(), np.int32).reshape(-1, 2)
                    train_cell(own, other, chances, cell[draw.permutation(len(cell))], draw)
        if key is not None:
            yield done()

    # Chunks of pairs go by their hash, so that a run over the same chunks repeats.
    rows = models.unionByName(cells).repartitionById(blocks * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions(
        "block", "share", "part", F.xxhash64("pairs"))
    trained = rows.mapInArrow(train, "block int, share int, inputs binary, outputs binary, inputs_moved binary, outputs_moved binary")
    if shares > 1:
        trained = trained.repartitionById(blocks, "block").sortWithinPartitions("block", "share").mapInArrow(
            _means(size), "block int, inputs binary, outputs binary")
    return trained.select("block", "inputs", "outputs").withColumn("other", partner)


def _means(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of a cell from those of its shares: each word's row is the mean of the shares that moved it."""
        block, sums, counts = None, [], []

        def done() -> pa.RecordBatch:
            means = [total / np.maximum(count, 1)[:, None] for total, count in zip(sums, counts)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([m.astype(np.float32).tobytes()], pa.binary()) for m in means]],
                                              names=["block", "inputs", "outputs"])

        for batch in batches:
            for number, *values in zip(*[batch[name] for name in ("block", "inputs", "outputs", "inputs_moved", "outputs_moved")]):
                matrices = [_matrix(v.as_buffer(), size) for v in values[:2]]
                moved = [np.frombuffer(v.as_buffer(), np.bool_) for v in values[2:]]
                if number.as_py() != block:
                    if block is not None:
                        yield done()
                    block, sums, counts = number.as_py(), matrices, [m.astype(np.float32) for m in moved]
                    continue
                for total, count, matrix, now in zip(sums, counts, matrices, moved):
                    # A row that no share has moved yet is the one all have begun with.
                    first, more = now & (count == 0), now & (count > 0)
                    total[first] = matrix[first]
                    total[more] += matrix[more]
                    count += now
        if block is not None:
            yield done()

    return work


def shares_for(pairs: DataFrame, words: int, vector_size: int, blocks: int, share_bytes: int = SHARE_BYTES) -> int:
    """So many tasks to a cell that none trains more than ``share_bytes`` of pairs, or four times its blocks if they are larger."""
    largest = pairs.groupBy("stratum", "block").agg(F.sum(F.octet_length("pairs")).alias("bytes")).agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    return max(1, -(-largest // max(share_bytes, 8 * 4 * (vector_size + 1) * -(-words // blocks))))


def word_vectors_in_blocks(split: DataFrame, window_size: int, vector_size: int, *, blocks: int, epochs: int = EPOCHS, seed: int = 1,
                           share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``word, vector`` of every word in the term arrays ``split_url``; null words count for nothing. The same rows in the same partitions give the same
    vectors. An empty table gives an empty one."""
    spark = split.sparkSession
    n = split.select(F.explode("split_url").alias("word")).where("word is not null").distinct().count()
    if not n:
        return spark.createDataFrame([], WORD_VECTORS)
    blocks = min(blocks, n)
    words = numbered_words(split, blocks)
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    cell_pairs(split, words, blocks, window_size).write.partitionBy("stratum").parquet(path)
    # As many rows as there are blocks, each with the words of one: their names and counts in the order of their places.
    members = cut_lineage(words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "word", "count"))).alias("words")))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"]):
                n = np.asarray(counts.values.to_numpy(), np.float64)
                first = np.zeros((len(n), vector_size + 1), np.float32)
                first[:, :-1] = (np.random.default_rng([seed, block]).random((len(n), vector_size)) - 0.5) / vector_size
                columns = [pa.array([block], pa.int32()), *[pa.array([m.tobytes()], pa.binary()) for m in (first, np.zeros_like(first), np.cumsum(n ** 0.75))]]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "inputs", "outputs", "chances"])

    begun = cut_lineage(members.select("block", F.col("words.count").alias("counts")).mapInArrow(
        begin, "block int, inputs binary, outputs binary, chances binary"))
    weights = begun.select(F.col("block").alias("other"), "chances")
    state = begun.withColumn("other", F.col("block"))
    pairs = spark.read.schema("block int, pairs binary, stratum int").parquet(path)
    shares = shares_for(pairs, n, vector_size, blocks, share_bytes)
    for epoch in range(epochs):
        for stratum in range(blocks):
            state = cut_lineage(_stratum(pairs, state.select("block", "inputs"), state.select("other", "outputs"), weights, stratum, blocks, shares, vector_size,
                                         seed + epoch * 1_000_003))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, value in zip(batch["names"], batch["inputs"]):
                own = _matrix(value.as_buffer(), vector_size)[:, :-1].astype(np.float64)
                edges = np.arange(len(own) + 1, dtype=np.int32) * vector_size
                yield pa.RecordBatch.from_arrays([names.values, pa.ListArray.from_arrays(edges, own.ravel())], names=["word", "vector"])

    named = state.select("block", "inputs").join(members.select("block", F.col("words.word").alias("names")), "block").select("names", "inputs")
    return named.mapInArrow(spread, "word string, vector array<double>").select("word", array_to_vector("vector").alias("vector"))

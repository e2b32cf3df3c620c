"""What keeps the operators whole and even on a large cluster: cut lineage, number rows, join on skewed keys."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only if its measured size stays below this many bytes.
BROADCAST_BYTES = 128 * 1024 * 1024
# A window without partitions is used for at most this many rows.
ONE_TASK_ROWS = 100_000
# At most this many keys are treated as hot. Any other key holds less than 1/HOT_KEYS of all rows.
HOT_KEYS = 10_000
# What is broadcast of the hot keys stays below this many bytes.
HOT_BYTES = BROADCAST_BYTES
# Hash table and row header cost per broadcast row, on top of key and payload.
_ROW_OVERHEAD = 64
# monotonically_increasing_id() keeps the partition in the upper bits and the row within it in the lower 33.
_ROW_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without the setting (tests) gets a temporary folder; on a cluster that would lose data with
    an executor, so it is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder, so that later stages, retries after a lost
    executor included, read the very same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order: list[Column], name: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``row_number() over (order by ...)`` as a long starting at 1, without a task that sees more than
    ``one_task_rows`` rows. ``order`` must be total.

    Few rows are numbered by a window. Many are range-partitioned and sorted, then numbered by the number of rows in
    earlier partitions plus the place in their own; both steps must see one partitioning, so it is checkpointed.
    """
    counted = cut_lineage(df)
    if counted.count() <= one_task_rows:
        return counted.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    slot = F.col("_slot")
    placed = cut_lineage(
        counted.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(slot, _ROW_BITS))
    )
    # One row per partition of the sort, however many rows are numbered.
    sizes = placed.groupBy("_part").count().orderBy("_part").collect()
    first = accumulate((rows for _, rows in sizes), initial=0)
    starts = df.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, first)], "_part long, _start long"
    )
    place = slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + place + 1).alias(name)
    )


def broadcast_size(df: DataFrame, key: str, payload: Column | int = 16) -> int:
    """Bytes that ``df`` takes as a broadcast, measured by one aggregate.

    :param payload: bytes per row beside the key.
    """
    key_bytes = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0))
    row_bytes = key_bytes + (F.lit(payload) if isinstance(payload, int) else payload) + _ROW_OVERHEAD
    return df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).cast("long")).first()[0]


def fits_broadcast(df: DataFrame, key: str, payload: Column | int = 16, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` (see :func:`broadcast_size`) and tell whether it may be broadcast."""
    return broadcast_size(df, key, payload) <= limit


def most_frequent_keys(facts: DataFrame, key: str, n: int = HOT_KEYS) -> DataFrame:
    """The ``n`` keys with the most rows in ``facts``."""
    return facts.groupBy(key).count().orderBy(F.desc("count"), key).limit(n).select(key)


def join_skewed(facts: DataFrame, dimension: DataFrame, key: str, *, payload: Column | int = 16,
                hot: DataFrame | None = None, hot_keys: int = HOT_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner equi-join of ``facts`` with a ``dimension`` of unique keys, safe for keys that hold most of the facts.

    A dimension that fits is broadcast, and the facts are not moved at all. Beyond that size only its share of the
    ``hot`` keys is broadcast and meets the hot facts where they are; the remaining facts, none of whose keys is large,
    are shuffled. Both parts together are the whole join, whichever keys count as hot.

    :param payload: bytes per row of ``dimension`` beside the key.
    :param hot: one column ``key`` with at most ``hot_keys`` rows, counted from ``facts`` if not given. Fewer are used
        while their part of the dimension is larger than ``HOT_BYTES``.
    """
    if fits_broadcast(dimension, key, payload, broadcast_bytes):
        return facts.join(F.broadcast(dimension), key)
    hot = cut_lineage(most_frequent_keys(facts, key, hot_keys) if hot is None else hot.select(key))
    hot_dimension = cut_lineage(dimension.join(F.broadcast(hot), key, "left_semi"))
    while not fits_broadcast(hot_dimension, key, payload, HOT_BYTES):
        hot_keys //= 2
        hot_dimension = cut_lineage(hot_dimension.limit(hot_keys))
        hot = hot_dimension.select(key)
    hot_rows = facts.join(F.broadcast(hot_dimension), key)
    other_rows = facts.join(F.broadcast(hot), key, "left_anti").join(dimension, key)
    return hot_rows.unionByName(other_rows)

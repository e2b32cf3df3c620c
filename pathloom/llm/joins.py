"""Left joins on keys of which one may hold a large part of all rows, and numbers of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.scale import fits_broadcast

BROADCAST_BYTES = 32 << 20
PARTITION_BYTES = 16 << 20
LARGE_PARTITION_BYTES = 512 << 20
MANY_PARTITIONS = 20_000


def partitions_for(spark: SparkSession, size: int) -> int:
    """So many partitions that each holds about ``PARTITION_BYTES`` of ``size`` bytes, and no fewer than the session asks for.

    More than ``MANY_PARTITIONS`` cost a shuffle more than they save, so beyond that partitions grow, up to ``LARGE_PARTITION_BYTES``. Their tasks
    must read them as a stream.
    """
    wanted = min(-(-size // PARTITION_BYTES), max(MANY_PARTITIONS, -(-size // LARGE_PARTITION_BYTES)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)


def bytes_of(rows: DataFrame, column: str) -> int:
    """The bytes of all texts or binary values of a column."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def left_join(facts: DataFrame, dimension: DataFrame, key: str, payload: Column | int = 16) -> DataFrame:
    """``facts`` with the columns of ``dimension``, whose keys are unique.

    A dimension whose measured size is small is broadcast and the facts stay where they are. Otherwise both are shuffled, and
    Spark splits partitions with a hot key at run time.
    """
    if fits_broadcast(dimension, key, payload, BROADCAST_BYTES):
        dimension = F.broadcast(dimension)
    return facts.join(dimension, key, "left")


def semi_join(facts: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``facts`` whose key is (or with ``left_anti`` is not) among ``keys``."""
    keys = keys.select(key).distinct()
    return facts.join(F.broadcast(keys) if fits_broadcast(keys, key, 0, BROADCAST_BYTES) else keys, key, how)

"""Which rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def count_by(df: DataFrame, group: str) -> dict:
    """The number of rows of each value of ``group``."""
    return {row[group]: row["_rows"] for row in df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).collect()}


def sample_by(df: DataFrame, group: str, key: str, rows: int, counts: dict | None = None) -> DataFrame:
    """About ``rows`` rows of each value of ``group``: those whose hash of ``key`` is below the share that gives as many.
    The same rows come back in every run, and no group is gathered to choose them. ``counts`` are those of ``count_by``, if known."""
    place = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    few = {value: min(1.0, rows / count) for value, count in (count_by(df, group) if counts is None else counts).items()}
    chosen = F.lit(False)
    for value, share in few.items():
        chosen = chosen | ((F.col(group) == value) & (place < share))
    return df.filter(chosen)

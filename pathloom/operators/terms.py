"""Term tables: split URLs and exploded terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.url import TermSorter, split_url


def split_urls(urls: DataFrame, term_sorter: TermSorter | None = None) -> DataFrame:
    """``id, url`` to ``id, url, split_url``. A pure projection: works on streaming DataFrames too."""
    return urls.select("id", "url", split_url(F.col("url"), term_sorter).alias("split_url"))


def explode_terms(split: DataFrame) -> DataFrame:
    """One row ``id, url, pos, word`` per term, ``pos`` from 0. URLs without terms have no rows."""
    return split.select("id", "url", F.posexplode("split_url").alias("pos", "word"))

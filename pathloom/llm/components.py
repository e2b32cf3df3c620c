"""Connected components of a table of links, by hooking and pointer jumping on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.scale import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node in ``links (a, b)``; the root is the smallest node that can be reached.

    Each round hooks every root to its smallest smaller neighbour and shortens the trees to stars by pointer jumping, so the rounds grow
    with the logarithm of the size of a component, also for long chains. No group of links is gathered: all steps are
    minima, which combine before the shuffle, and joins.
    """
    links = links.filter("a != b")
    roots = cut_lineage(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")))
    open_links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while open_links.limit(1).count():
        parents = cut_lineage(open_links.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")))
        while True:
            onward = parents.select(F.col("from").alias("to"), F.col("to").alias("far"))
            jumped = cut_lineage(parents.join(onward, "to", "left").select("from", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
            parents = jumped.select("from", "to")
            if not jumped.filter("moved").limit(1).count():
                break
        roots = cut_lineage(_moved(roots, parents, "root"))
        moved = _moved(_moved(open_links, parents, "a"), parents, "b").filter("a != b")
        open_links = cut_lineage(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots


def _moved(df: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    onward = parents.withColumnRenamed("from", column)
    return df.join(onward, column, "left").withColumn(column, F.coalesce("to", column)).select(*df.columns)

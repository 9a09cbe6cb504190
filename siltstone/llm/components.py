"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.workspace import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round: each node's neighbours are linked with the least of its neighbourhood.

    Large-star moves the greater neighbours, small-star the lesser ones and the
    node itself.  The group is only ever reduced to its minimum, so a node with
    any number of links needs no task of its own.
    """
    if large:
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` to ``(node, component)``; a component is named by its least node.

    Nodes without a link have no row.  Rounds, each written to the shared folder, go
    on until one changes nothing, some log2 of the longest path; every round but the
    last lowers a link, so they end.  An empty table gives an empty result.
    """
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        now = written(_star(_star(now, large=True), large=False), "star")
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that can be reached, for every node of the edges ``a, b``
    (bigints, in any direction). Every round points each node at the least root among its neighbours'
    and then at that root's own root, so chains shrink by half; a round is written to the shared
    folder. The driver sees one count a round."""
    both = cut(
        edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    known = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    total = F.sum(F.col("root").cast("decimal(38,0)")).alias("total")
    was = known.agg(total).first()["total"]
    while True:
        # Besides the node itself, its present root hears of the smaller root, which joins whole trees.
        near = both.join(known.withColumnsRenamed({"node": "b", "root": "r"}), "b").select("a", "r")
        here = near.join(known.withColumnsRenamed({"node": "a", "root": "own"}), "a")
        heard = here.select(F.col("a").alias("node"), "r").unionByName(here.filter("r < own").select(F.col("own").alias("node"), "r"))
        least = known.select("node", F.col("root").alias("r")).unionByName(heard).groupBy("node").agg(F.min("r").alias("root"))
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = cut(
            least.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"))
        )
        # Roots only fall, so a round that leaves their sum has moved none.
        now = after.agg(total).first()["total"]
        known = after
        if now == was:
            return known
        was = now


def joined_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known`` (``node, root``) after more edges: their ends are replaced by roots first, so that what is searched
    is only as large as what they join."""
    for end in ("a", "b"):
        root = known.select(F.col("node").alias(end), F.col("root").alias("_r"))
        edges = edges.join(root, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    edges = cut(edges.filter("a <> b").distinct())
    if edges.isEmpty():
        return known
    found = components(edges)
    moved = known.join(found.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    moved = moved.select("node", F.coalesce("_to", "root").alias("root"))
    new = found.join(known.select("node"), "node", "left_anti")
    return cut(moved.unionByName(new))

"""Connected components of a link table by alternating stars: joins and aggregates only, on the executors.

Each round is written to the shared folder, so that lineage stays one round long. Links, components and
labels never reach the driver; only a count and a checksum do, to see when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import dropped, written


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m").toDF("a", "b")).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links: two columns of one orderable type, either direction, repeats and self-links allowed.

    Returns (node, component) for every node that has a link to another one; component is the smallest
    node that can be reached. Nodes without links are not returned; null ends are ignored.
    """
    a, b = links.columns
    now = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        last, now = now, written(_small_star(_large_star(now)), "links")
        before, state = state, _state(now)
        dropped(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct().toDF("node", "component"))

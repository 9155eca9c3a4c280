"""Breadth-first search and paths over edge tables, in rounds that each cost what they touch.

Edges are written once, in buckets by the vertex they leave, so a round sends only its frontier to them: a small
frontier is broadcast, a large one is shuffled to the buckets, and the edges stay where they are. The vertices seen are
in buckets as well, and written anew only once what came since is half as many.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.common import bucketed, cut_lineage

#: A frontier of at most NARROW vertices goes UNROLLED hops in one job: long thin graphs would else cost a job a hop.
NARROW, UNROLLED = 10_000, 4
#: Rounds whose finds are kept apart before they are written together.
COMPACT = 8


def _hop(frontier: DataFrame, edges: DataFrame, label: Callable[[Column, Column], Column]) -> DataFrame:
    """Where edges lead from a frontier (key, label), once each, with the smallest label."""
    met = frontier.join(edges, frontier["key"] == edges["from_key"])
    return met.select(F.col("to_key").alias("key"), label(F.col("label"), F.col("edge")).alias("label")).groupBy("key").agg(F.min("label").alias("label"))


def breadth_first(edges: DataFrame, roots: DataFrame, label: Callable[[Column, Column], Column], narrow: int = NARROW) -> DataFrame:
    """All vertices that roots reach: key, hops, label; runs to its end, through cycles as well.

    edges: from_key, to_key and edge (any value); roots: key and label. A vertex's label is the smallest of
    label(label of a predecessor, edge) over the predecessors that are one hop nearer; roots keep theirs, the smallest
    if they repeat.

    A job may go several hops. Vertices met again on the way are followed again, which costs and changes nothing: all
    that they lead to has been reached in fewer hops, and the fewest count.
    """
    kept = bucketed(edges.select("from_key", "to_key", "edge"), "edges", "from_key")
    base = bucketed(roots.groupBy("key").agg(F.min("label").alias("label")).select("key", F.lit(0).alias("hops"), "label"), "bfs", "key")
    base_rows = rows = base.count()
    recent: list[DataFrame] = []
    recent_rows, frontier, hops = 0, base, 0
    while rows:
        ahead = UNROLLED if rows <= narrow else 1
        now, found = frontier.select("key", "label"), []
        for k in range(1, ahead + 1):
            now = _hop(now, kept, label)
            found.append(now.select("key", F.lit(hops + k).alias("hops"), "label"))
        reached = reduce(DataFrame.union, found)
        if ahead > 1:
            reached = reached.groupBy("key").agg(F.min(F.struct("hops", "label")).alias("m")).select("key", "m.hops", "m.label")
        for known in (base, reduce(DataFrame.union, recent)) if recent else (base,):
            reached = reached.join(known.select("key"), "key", "left_anti")
        new = cut_lineage(reached, "bfs")
        hops += ahead
        frontier = new.filter(F.col("hops") == hops)
        made = new.agg(F.count("*").alias("all"), F.count_if(F.col("hops") == hops).alias("last")).first()
        rows, recent_rows = made["last"], recent_rows + made["all"]
        recent.append(new)
        if len(recent) == COMPACT:
            recent = [cut_lineage(reduce(DataFrame.union, recent), "bfs")]
            if 2 * recent_rows >= base_rows:  # else the large table is not written again
                base, base_rows, recent, recent_rows = bucketed(base.union(recent[0]), "bfs", "key"), base_rows + recent_rows, [], 0
    return reduce(DataFrame.union, [base, *recent])


def paths(parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted key: the path of keys from its root to it, in about log2(longest path) rounds.

    parents: key and pred (null for roots), without cycles. Round k knows each key's ancestor 2^k above and
    the wanted keys' ancestors below that; both double. Only the wanted keys' paths are made, one row per vertex of a path.
    """
    jump = cut_lineage(parents.filter("pred is not null").select("key", "pred"), "jumps")
    found = cut_lineage(parents.join(wanted.select("key").distinct(), "key", "left_semi").select("key", F.lit(0).alias("up"), F.col("key").alias("at")), "paths")
    reach = 1
    while not jump.isEmpty():
        further = found.join(jump.withColumnRenamed("key", "at"), "at").select("key", (F.col("up") + reach).alias("up"), F.col("pred").alias("at"))
        found = cut_lineage(found.union(further), "paths")
        jump = cut_lineage(jump.alias("a").join(jump.alias("b"), F.col("a.pred") == F.col("b.key")).select("a.key", "b.pred"), "jumps")
        reach *= 2
    return found.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("up", "at")), asc=False), lambda x: x["at"]).alias("path"))

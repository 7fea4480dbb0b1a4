"""Graphs as edge tables: components, bounded search, labels, halos and cuts, by rounds of joins.

A round's frontier is written to the shared folder, so lineage doesn't grow with the number of rounds.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.tables import cut, drop, large


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, sort: bool = False) -> DataFrame:
    """(key, component) of all ends of edges (a, b): the smallest end that can be reached. Labels spread along edges and then jump to their label's label, so the rounds follow the logarithm of the longest path. sort: no side of a join is broadcast, however small its files are."""
    side = large if sort else lambda df: df
    both = cut(both_ways(edges))
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(side(labels.select(F.col("key").alias("b"), F.col("component").alias("other"))), "b").groupBy(F.col("a").alias("key")).agg(F.min("other").alias("other"))
        step = cut(labels.join(side(near), "key").select("key", F.col("component").alias("old"), F.least("component", "other").alias("component")))
        jump = step.select(F.col("key").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(side(jump), "component", "left").select("key", "old", F.coalesce("far", "component").alias("component")))
        drop(step), drop(labels)
        if new.filter(F.col("old") != F.col("component")).isEmpty():
            drop(both)
            return new.select("key", "component")
        labels = new.select("key", "component")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, avg_degree over distinct neighbours, density with repeated edges) in one row; nodes: key; edges: a, b."""
    pairs = both_ways(edges).filter("a <> b").distinct().agg(F.count(F.lit(1)).alias("ends"))
    one = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(pairs)  # one row each
    n = F.col("n_nodes")
    return one.select("n_nodes", "n_edges", F.when(n > 0, F.col("ends") / n).otherwise(0.0).alias("avg_degree"), F.when(n > 1, F.col("n_edges") / (n * (n - 1) / 2)).otherwise(0.0).alias("density"))


def depths(edges: DataFrame, roots: DataFrame, most: int, sort: bool = False) -> DataFrame:
    """(key, depth) of what roots (key) reach along edges a -> b within `most` steps, at the first step. sort: as in components()."""
    side = large if sort else lambda df: df
    edges = cut(edges.select("a", "b").distinct())
    seen = cut(roots.select("key").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        front = seen.filter(F.col("depth") == depth - 1).select(F.col("key").alias("a"))
        new = edges.join(side(front), "a").select(F.col("b").alias("key")).distinct().join(side(seen.select("key")), "key", "left_anti").withColumn("depth", F.lit(depth))
        grown = cut(seen.unionByName(new))
        found = not grown.filter(F.col("depth") == depth).isEmpty()
        drop(seen)
        seen = grown
        if not found:
            break
    drop(edges)
    return seen


def shortest_path(edges: DataFrame, start, goal, most: int | None = None) -> list:
    """The nodes of a shortest directed path, [] if there is none (within `most` steps, if given); edges: a, b, position. Of parents as near, the one whose edge comes first."""
    if start == goal:
        return [start]
    spark = edges.sparkSession
    seen = cut(spark.createDataFrame([(start,)], "key bigint").withColumns({"parent": F.lit(None).cast("bigint"), "depth": F.lit(0)}))
    for depth in count(1) if most is None else range(1, most + 1):
        front = seen.filter(F.col("depth") == depth - 1).select(F.col("key").alias("a"))
        new = edges.join(front, "a").groupBy(F.col("b").alias("key")).agg(F.min_by("a", "position").alias("parent")).join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth))
        seen = cut(seen.unionByName(new))
        if not seen.filter(F.col("key") == goal).isEmpty():
            path = [goal]
            while path[-1] != start:
                path.append(seen.filter(F.col("key") == path[-1]).first()["parent"])
            return path[::-1]
        if seen.filter(F.col("depth") == depth).isEmpty():
            return []
    return []


def spread_labels(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(key, distance, label) within k steps of seeds (key, label), along edges (a, b, position) both of whose directions are given: in each round a node takes the label of its nearest neighbour, of those the first by position."""
    seen = cut(seeds.groupBy("key").agg(F.min("label").alias("label")).withColumn("distance", F.lit(0)))
    for step in range(1, k + 1):
        near = edges.join(seen.select(F.col("key").alias("b"), "label", "distance"), "b").groupBy(F.col("a").alias("key")).agg(F.min_by("label", F.struct("distance", "position")).alias("label"))
        new = near.join(seen.select("key"), "key", "left_anti").withColumn("distance", F.lit(step))
        grown = cut(seen.unionByName(new))
        drop(seen)
        seen = grown
    return seen.select("key", "distance", "label")


def halo_masks(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(key, mask): bit p is set if a neighbour of the node belongs to p and the node doesn't; owners: (key, owner), under 32 of them."""
    o = lambda side: owners.select(F.col("key").alias(side), F.col("owner").alias(f"o_{side}"))
    met = both_ways(edges).join(o("a"), "a").join(o("b"), "b").filter("o_a <> o_b")
    masks = met.groupBy(F.col("a").alias("key")).agg(F.bit_or(F.expr("shiftleft(1L, o_b)")).alias("mask"))
    return owners.select("key").join(masks, "key", "left").select("key", F.coalesce("mask", F.lit(0)).alias("mask"))


def cut_matrix(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(from_owner, to_owner, n) of the edges between owners."""
    o = lambda side: owners.select(F.col("key").alias(side), F.col("owner").alias(f"o_{side}"))
    return edges.join(o("a"), "a").join(o("b"), "b").filter("o_a <> o_b").groupBy(F.col("o_a").alias("from_owner"), F.col("o_b").alias("to_owner")).agg(F.count(F.lit(1)).alias("n"))


def block_owner(index, n, size):
    """The owner of row `index` of n when rows are dealt to `size` owners in blocks, the first ones a row longer where it doesn't divide. Columns or numbers."""
    base, more = F.floor(n / size), n % size
    wide = more * (base + 1)
    return F.when(index < wide, F.floor(index / (base + 1))).otherwise(more + F.floor((index - wide) / F.greatest(base, F.lit(1)))).cast("int")


def shrink(ranks: DataFrame, failed: DataFrame) -> DataFrame:
    """(rank, new_rank): survivors numbered in order, -1 for those that failed. Ranks are few: a cluster's processes."""
    gone = failed.select("rank", F.lit(True).alias("gone")).distinct()
    own = ranks.join(gone, "rank", "left")
    live = F.row_number().over(Window.partitionBy(F.col("gone").isNull()).orderBy("rank")) - 1
    return own.select("rank", F.when(F.col("gone").isNull(), live).otherwise(-1).alias("new_rank"))

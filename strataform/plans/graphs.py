"""Graphs of parts and suppliers, of similar vectors, and of chains of customers' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.operators import graph, similarity
from strataform.plans.base import registry, table

QUERIES, ORACLE, query = registry()

#: Suppliers are numbered from here in the graph of parts and suppliers.
SUPPLIERS = 1_000_000_000_000
_EDGES = f"e AS (SELECT DISTINCT l_partkey AS a, {SUPPLIERS} + l_suppkey AS b FROM lineitem)"


def supply(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (SUPPLIERS + F.col("l_suppkey")).alias("b")).distinct()


def both(edges):
    return graph.both_ways(edges).withColumn("position", F.col("b"))


@query(f"""
WITH {_EDGES}, n AS (SELECT p_partkey AS key FROM part UNION ALL SELECT {SUPPLIERS} + s_suppkey FROM supplier)
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, 2.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(*) FROM n) AS avg_degree,
       (SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1) / 2) AS density
""")
def graph_stats(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("key")).union(table(spark, d, "supplier").select(SUPPLIERS + F.col("s_suppkey")))
    return graph.stats(nodes, supply(spark, d))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS key, least(a, min(b)) AS component FROM r GROUP BY a
""")
def connected_components(spark, d):
    edges = similarity.similar_links(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3)
    return graph.components(edges)


@query(f"""
WITH RECURSIVE {_EDGES}, w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(key, depth) AS (SELECT {SUPPLIERS} + s_suppkey, 0 FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT w.b, r.depth + 1 FROM r JOIN w ON w.a = r.key WHERE r.depth < 4)
SELECT key, min(depth) AS depth FROM r GROUP BY 1
""")
def bfs_depth(spark, d):
    roots = table(spark, d, "supplier").filter("s_suppkey % 10 = 0").select((SUPPLIERS + F.col("s_suppkey")).alias("key"))
    return graph.depths(graph.both_ways(supply(spark, d)), roots, 4)


@query(f"""
WITH {_EDGES}, w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), s AS (SELECT {SUPPLIERS} + s_suppkey AS key, s_suppkey AS label FROM supplier WHERE s_suppkey % 3 = 0),
o AS (SELECT w.a AS key, min_by(s.label, w.b) AS label FROM w JOIN s ON s.key = w.b WHERE w.a NOT IN (SELECT key FROM s) GROUP BY 1),
k AS (SELECT key, 0 AS distance, label FROM s UNION ALL SELECT key, 1, label FROM o),
t AS (SELECT w.a AS key, min_by(k.label, (k.distance, w.b)) AS label FROM w JOIN k ON k.key = w.b WHERE w.a NOT IN (SELECT key FROM k) GROUP BY 1)
SELECT * FROM k UNION ALL SELECT key, 2, label FROM t
""")
def khop_labels(spark, d):
    seeds = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select((SUPPLIERS + F.col("s_suppkey")).alias("key"), F.col("s_suppkey").alias("label"))
    return graph.spread_labels(both(supply(spark, d)), seeds, 2)


_OWNERS = f"o AS (SELECT p_partkey AS key, (p_size % 8)::INTEGER AS owner FROM part UNION ALL SELECT {SUPPLIERS} + s_suppkey, (s_nationkey % 8)::INTEGER FROM supplier)"


def owners(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 8).cast("int").alias("owner")).union(table(spark, d, "supplier").select(SUPPLIERS + F.col("s_suppkey"), (F.col("s_nationkey") % 8).cast("int")))


@query(f"WITH {_EDGES}, {_OWNERS}, w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), m AS (SELECT w.a AS key, bit_or(1::BIGINT << q.owner) AS mask FROM w JOIN o p ON p.key = w.a JOIN o q ON q.key = w.b WHERE p.owner <> q.owner GROUP BY 1) SELECT o.key, coalesce(mask, 0) AS mask FROM o LEFT JOIN m ON m.key = o.key")
def halo_mask(spark, d):
    return graph.halo_masks(supply(spark, d), owners(spark, d))


@query(f"WITH {_EDGES}, {_OWNERS} SELECT p.owner AS from_owner, q.owner AS to_owner, count(*) AS n FROM e JOIN o p ON p.key = e.a JOIN o q ON q.key = e.b WHERE p.owner <> q.owner GROUP BY 1, 2")
def edge_cut_matrix(spark, d):
    return graph.cut_matrix(supply(spark, d), owners(spark, d))


@query("WITH n AS (SELECT count(*) AS n FROM orders), b AS (SELECT o_orderkey % n AS i, n // 7 AS base, n % 7 AS more FROM orders, n) SELECT CASE WHEN i < more * (base + 1) THEN i // (base + 1) ELSE more + (i - more * (base + 1)) // base END::INTEGER AS owner, count(*) AS n FROM b GROUP BY 1")
def row_block_partition(spark, d):
    orders = table(spark, d, "orders")
    n = orders.count()
    return orders.select(graph.block_owner(F.col("o_orderkey") % n, F.lit(n), 7).alias("owner")).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS rank, CASE WHEN n_regionkey = 2 THEN -1 ELSE row_number() OVER (PARTITION BY n_regionkey = 2 ORDER BY n_nationkey) - 1 END AS new_rank FROM nation")
def shrink_renumber(spark, d):
    ranks = table(spark, d, "nation").select(F.col("n_nationkey").alias("rank"), "n_regionkey")
    return graph.shrink(ranks.select("rank"), ranks.filter("n_regionkey = 2").select("rank"))

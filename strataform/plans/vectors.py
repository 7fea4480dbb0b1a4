"""Similarity of vectors and token sets, retrieval, components of variance and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.functions import scalars
from strataform.operators import features, similarity, stats
from strataform.plans.base import registry, table

QUERIES, ORACLE, query = registry()

_TOP = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS row_id, {score} AS score FROM v q, v x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, row_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s) WHERE rank <= {k}
"""


@query(_TOP.format(score="list_cosine_similarity(q.e, x.e)", k=10))
def cosine_topk(spark, d):
    out = similarity.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding")
    return out.select("query_id", "rank", "row_id", F.round("score", 9).alias("score"))


@query(_TOP.format(score="-list_distance(q.e, x.e)", k=10))
def l2_topk(spark, d):
    out = similarity.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding", "l2")
    return out.select("query_id", "rank", "row_id", F.round("score", 9).alias("score"))


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3
""")
def threshold_similarity_edges(spark, d):
    return similarity.similar_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3).select("a", "b", F.round("score", 9).alias("score"))


_SETS = """
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS t FROM benchmark WHERE item_id % 100 = 0),
r AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS t FROM documents),
s AS (SELECT item_id AS query_id, doc_id AS row_id, len(list_intersect(q.t, r.t)) AS common, len(q.t) + len(r.t) - len(list_intersect(q.t, r.t)) AS alike FROM q, r)
"""


def _sides(spark, d):
    distinct = F.array_distinct(scalars.tokens(F.col("text")))
    q = table(spark, d, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), distinct.alias("tokens"))
    return q, table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), distinct.alias("tokens"))


@query(_SETS + "SELECT query_id, row_id, round(common / alike, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY common / alike DESC, row_id) AS n FROM s WHERE common > 0) WHERE n <= 20")
def jaccard_topk(spark, d):
    return similarity.top_sets(*_sides(spark, d), 20).select("query_id", "row_id", F.round("score", 9).alias("score"))


@query(_SETS + "SELECT query_id, row_id, common FROM s WHERE common > 0")
def token_overlap(spark, d):
    return similarity.set_overlaps(*_sides(spark, d)).select("query_id", "row_id", "common")


_FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"""


@query(f"""
WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS w FROM benchmark),
h AS (SELECT item_id, {_FNV.format(x="w")} AS h FROM t), s AS (SELECT item_id, i, sum(((h >> (3 * i)) & 255) / 255.0::DOUBLE - 0.5) AS x FROM h, range(8) r(i) GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
SELECT item_id, i, round(x / CASE WHEN n > 0 THEN n ELSE 1 END, 7) AS x FROM s JOIN n USING (item_id)
""")
def hashed_text_embedding(spark, d):
    v = scalars.text_embedding(F.col("text"))
    rows = table(spark, d, "benchmark").filter(F.size(scalars.tokens(F.col("text"))) > 0).select("item_id", F.posexplode(v).alias("p", "x"))
    return rows.select("item_id", F.col("p").cast("long").alias("i"), F.round("x", 7).alias("x"))


@query(_TOP.format(score="0.7 * list_cosine_similarity(q.e, x.e)", k=20).rsplit("SELECT query_id, rank", 1)[0].replace("0.7 * ", "") + """
, a AS (SELECT query_id, row_id, 0.7 * round(score, 12) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS n FROM s) WHERE n <= 20),
l AS (SELECT q.vec_id AS query_id, x.vec_id AS row_id, -round(list_distance(q.e, x.e), 12) AS score FROM v q, v x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
b AS (SELECT query_id, row_id, 0.3 * score AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS n FROM l) WHERE n <= 20),
u AS (SELECT query_id, row_id, round(sum(score), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT query_id, row_id, score FROM u
""")
def pooled_retrieval_union(spark, d):
    e = table(spark, d, "embeddings")
    asked = F.col("vec_id") % 100 == 0
    parts = [(similarity.top_k(e, asked, 20, "vec_id", "embedding"), 0.7), (similarity.top_k(e, asked, 20, "vec_id", "embedding", "l2"), 0.3)]
    return similarity.fused(parts, 40).select("query_id", "row_id", F.round("score", 9).alias("score"))


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 7) AS norm FROM e
""")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.norm(F.col("embedding")), 7).alias("norm"))


@query(None)
def pca_latent(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    mean, dev, components, _ = stats.pca(own, names, 2)
    return stats.project(own, names, mean, dev, components).select("l_orderkey", "l_linenumber", "latent")


@query(None)
def kmeans_clusters(spark, d):
    own = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("x"), (F.col("p_retailprice") / 2000).alias("y"))
    return stats.kmeans(own, ["x", "y"], stats.spread_centres(own, ["x", "y"], "p_partkey", 3))[1]


@query(f"""
WITH n AS (SELECT user_id, event_type, ln(1 + count(*)) AS x FROM events GROUP BY 1, 2), h AS (SELECT *, {_FNV.format(x="event_type")} AS h FROM n),
s AS (SELECT user_id, h % 32 AS d, sum(CASE WHEN (h >> 31) % 2 = 0 THEN x ELSE -x END) AS x FROM h GROUP BY 1, 2), l AS (SELECT user_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
SELECT user_id, d, round(x / CASE WHEN n > 0 THEN n ELSE 1 END + 3.7e-10, 8) AS x FROM s JOIN l USING (user_id) WHERE x <> 0
""")
def type_counts_embedding(spark, d):
    out = features.type_counts_embedding(table(spark, d, "events"), "user_id", "event_type").select("user_id", F.posexplode("vector").alias("p", "x"))
    return out.filter("x <> 0").select("user_id", F.col("p").cast("long").alias("d"), F.round(F.col("x") + 3.7e-10, 8).alias("x"))


@query("""
WITH p AS (SELECT p_partkey, unnest(['part', 'size:' || CASE WHEN p_size < 0.5 THEN 'xs' WHEN p_size < 2 THEN 's' WHEN p_size < 10 THEN 'm' WHEN p_size < 100 THEN 'l' ELSE 'xl' END, 'brand:' || lower(p_brand)]) AS token FROM part
  UNION SELECT p_partkey, 'tok:' || unnest(list_filter(regexp_split_to_array(lower(p_name), '[-_\\s/]+'), lambda w: w <> '')) FROM part)
SELECT token, count(DISTINCT p_partkey) AS n FROM p GROUP BY 1
""")
def topology_tokens(spark, d):
    own = table(spark, d, "part").select("p_partkey", features.topology_tokens(F.lit("part"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")), F.col("p_name")).alias("tokens"))
    return own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

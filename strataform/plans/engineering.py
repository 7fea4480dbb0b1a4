"""Materials, designs, learning, cells and surfaces, hashes and draws, and rows of the service's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.functions import scalars
from strataform.operators import decision, features, graph, learning, materials, mesh, ordered, relational, similarity, simulation, structural, telemetry, topology
from strataform.plans.base import registry, table
from strataform.sources import readers

QUERIES, ORACLE, query = registry()


# --- hashes and draws ---------------------------------------------------------------------------------------------


@query("""
WITH h AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616) AS h FROM part)
SELECT p_partkey, lower(lpad(to_hex(h::UBIGINT), 16, '0')) AS digest FROM h
""")
def content_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.fnv1a64(F.col("p_name")).alias("digest"))


_MUL = "((({a})::HUGEINT * ({b})) & 4294967295)::BIGINT"


@query(f"""
WITH a AS (SELECT c_custkey, k::INTEGER AS draw, (greatest(c_custkey, 1) + {_MUL.format(a='k + 1', b='1831565813')}) & 4294967295 AS s FROM customer, range(3) t(k)),
b AS (SELECT *, {_MUL.format(a='xor(s, s >> 15)', b='(s | 1)')} AS t FROM a),
c AS (SELECT *, xor(t, (t + {_MUL.format(a='xor(t, t >> 7)', b='(t | 61)')}) & 4294967295) AS u FROM b)
SELECT c_custkey, draw, xor(u, u >> 14) / 4294967296.0::DOUBLE AS x FROM c
""")
def seeded_draws(spark, d):
    own = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("draw"))
    return own.withColumn("x", scalars.mulberry32(F.col("c_custkey"), F.col("draw")))


@query("SELECT p_partkey, round(sum(CASE WHEN b = 2 THEN floor(p_partkey / pow(2, j)) % 2 / pow(2, j + 1) END), 9) AS x2, round(sum(CASE WHEN b = 3 AND j < 30 THEN floor(p_partkey / pow(3, j)) % 3 / pow(3, j + 1) END), 9) AS x3 FROM part, range(40) r(j), (VALUES (2), (3)) v(b) GROUP BY 1")
def halton_points(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.round(scalars.halton(k, 2), 9).alias("x2"), F.round(scalars.halton(k, 3), 9).alias("x3"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"""
WITH RECURSIVE r AS (
  SELECT s_suppkey, 0 AS i, {_FNV.format(x='s_name')} AS h FROM supplier UNION ALL
  SELECT s_suppkey, i + 1, {_MUL.format(a='xor(h, h >> 13)', b='1540483477')} FROM r WHERE i < 8
), v AS (SELECT s_suppkey, i, h / 4294967295.0::DOUBLE * 2 - 1 AS x FROM r WHERE i > 0), n AS (SELECT s_suppkey, sqrt(sum(x * x)) AS n FROM v GROUP BY 1)
SELECT s_suppkey, (i - 1)::BIGINT AS i, round(x / n, 9) AS x FROM v JOIN n USING (s_suppkey)
""")
def seeded_embedding(spark, d):
    own = table(spark, d, "supplier").select("s_suppkey", F.posexplode(scalars.seeded_vector(F.col("s_name"))).alias("p", "x"))
    return own.select("s_suppkey", F.col("p").cast("long").alias("i"), F.round("x", 9).alias("x"))


# --- materials and designs ----------------------------------------------------------------------------------------


def _catalogue(spark, d):
    k = F.col("p_partkey")
    meta = F.when(k % 3 == 0, F.format_string('{"fatigue_limit": %d, "cost": %d}', k % 50, F.col("p_size")))
    return table(spark, d, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), F.when(k % 5 > 0, 1000 + k % 9000).alias("density_kg_m3"), (k % 7).alias("youngs_modulus_gpa"),
        F.when(k % 11 > 0, F.col("p_size") * 10).alias("yield_strength_mpa"), F.when(k % 2 == 0, F.col("p_size") * 13).alias("ultimate_strength_mpa"), meta.alias("metadata"),
    )


@query("""
SELECT p_partkey AS id, (CASE WHEN p_partkey % 5 > 0 THEN 1000 + p_partkey % 9000 ELSE 7800 END) / 1000::DOUBLE AS density, (p_partkey % 7)::DOUBLE AS modulus, p_size * 10.0::DOUBLE AS yield,
  CASE WHEN p_partkey % 2 = 0 THEN p_size * 13.0::DOUBLE ELSE p_size * 10.0::DOUBLE * 1.2::DOUBLE END AS ultimate, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 50)::DOUBLE ELSE p_size * 10.0::DOUBLE * 0.4::DOUBLE END AS fatigue_limit,
  CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE 5.0 END AS cost, 0.6::DOUBLE AS corrosion
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 > 0 AND p_size <> 0
""")
def corpus_mapping(spark, d):
    return materials.corpus_of(_catalogue(spark, d)).select("id", "density", "modulus", "yield", "ultimate", "fatigue_limit", "cost", "corrosion")


@query("SELECT id, count(*) AS n FROM (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1")
def corpus_union(spark, d):
    both = materials.union_of(table(spark, d, "part").select(F.col("p_partkey").alias("id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _stand_ins(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), (F.col("p_retailprice") <= 1500).alias("feasible"), (F.col("p_partkey") % 97 / 97.0).alias("score"))


@query("""
WITH m AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS a, p_retailprice / 2000::DOUBLE AS b, p_retailprice <= 1500 AS feasible, p_partkey % 97 / 97.0::DOUBLE AS score FROM part),
s AS (SELECT q.p_partkey AS query_id, x.p_partkey, x.feasible, 1 / (1 + sqrt((q.a - x.a) * (q.a - x.a) + (q.b - x.b) * (q.b - x.b))) AS similarity, x.score FROM m q, m x WHERE q.p_partkey % 100 = 0 AND q.p_partkey <> x.p_partkey)
SELECT query_id, p_partkey, feasible, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY feasible DESC, 0.7::DOUBLE * similarity + 0.3::DOUBLE * score DESC, p_partkey) AS rank FROM s) WHERE rank <= 5
""")
def substitute_rank(spark, d):
    own = _stand_ins(spark, d)
    out = materials.substitutes(own, own.filter("p_partkey % 100 = 0"), "p_partkey", ["a", "b"])
    return out.select("query_id", "p_partkey", "feasible", F.round("similarity", 9).alias("similarity"))


@query("""
WITH r AS (SELECT o_custkey, o_totalprice / 500000 AS score, o_orderstatus <> 'P' AS feasible, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
t AS (SELECT o_custkey, avg(score * CASE WHEN feasible THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) AS rel, avg(feasible::INT::DOUBLE) AS sat FROM r WHERE rank <= 5 GROUP BY 1),
o AS (SELECT count(*) AS scenarios, avg(rel) AS relevance, avg(sat) AS satisfied FROM t)
SELECT scenarios, round(relevance, 9) AS relevance, round(satisfied, 9) AS satisfied, scenarios >= 8 AS ready, scenarios >= 8 AND relevance > 0.85 AND satisfied > 0.95 AS passed FROM o
""")
def recommendation_gate(spark, d):
    own = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderstatus") != "P").alias("feasible"))
    ranked = relational.ranked(own, "o_custkey", [F.desc("score"), F.col("o_orderkey")])
    return materials.gate(ranked, "o_custkey").select("scenarios", F.round("relevance", 9).alias("relevance"), F.round("satisfied", 9).alias("satisfied"), "ready", "passed")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_discount AS eps, 1 + l_tax AS mu, 2 + l_tax AS la, CASE l_linenumber % 5 WHEN 0 THEN 'hookean' WHEN 1 THEN 'neo-hookean' WHEN 2 THEN 'viscoelastic' WHEN 3 THEN 'plastic' ELSE 'fracture' END AS kind FROM lineitem),
m AS (SELECT *, 2 * mu + la AS e, 0.5 * (2 * mu + la) * eps * eps AS hook FROM e)
SELECT kind, count(*) AS n, round(sum(CASE kind WHEN 'hookean' THEN hook
  WHEN 'neo-hookean' THEN 0.5 * mu * ((1 + eps) * (1 + eps) - 1) - mu * ln(1 + eps) + 0.5 * la * ln(1 + eps) * ln(1 + eps)
  WHEN 'viscoelastic' THEN hook + 0.5 * (3::DOUBLE / 2) * eps * eps
  WHEN 'plastic' THEN CASE WHEN abs(eps) <= 0.2::DOUBLE / e THEN hook ELSE 0.5 * e * (0.2::DOUBLE / e) * (0.2::DOUBLE / e) + 0.2::DOUBLE * (abs(eps) - 0.2::DOUBLE / e) + 0.5 * 0.7::DOUBLE * (abs(eps) - 0.2::DOUBLE / e) * (abs(eps) - 0.2::DOUBLE / e) END
  ELSE hook * (1 - least(1, greatest(0, (abs(eps) - 0.05::DOUBLE) * e / 0.4::DOUBLE))) END), 7) AS energy FROM m GROUP BY 1
""")
def strain_energies(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("hookean", "neo-hookean", "viscoelastic", "plastic", "fracture"))), F.col("l_linenumber") % 5 + 1)
    p = {"mu": 1 + F.col("l_tax"), "lambda": 2 + F.col("l_tax")} | {k: F.lit(v) for k, v in (("eta", 3.0), ("tau", 2.0), ("yield_stress", 0.2), ("hardening", 0.7), ("eps_frac", 0.05), ("gc", 0.4))}
    own = table(spark, d, "lineitem").select(kinds.alias("kind"), materials.strain_energy(kinds, F.col("l_discount"), p).alias("energy"))
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 7).alias("energy"))


_MATERIALS = "kinds(material, y, e, rho, kg, mf, wf) AS (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x!r}::DOUBLE' for x in v)})" for k, v in structural.MATERIALS.items()) + ")"


def _beam_sql(rows: str) -> str:
    """The chain from rows (volume, surface_area, material, csa, moi, length, force) to rounded results."""
    return f"""
{_MATERIALS}, g AS ({rows}), m AS (SELECT g.*, y, e, rho, kg, mf, wf FROM g JOIN kinds USING (material)),
a AS (SELECT *, floor((CASE WHEN force > 0 THEN force ELSE (rho * volume * 9.81::DOUBLE + 180 * surface_area) * 1.5::DOUBLE END) * 100 + 0.5) / 100 AS load, least(surface_area / greatest(volume, 1e-9::DOUBLE), 100) AS r FROM m),
b AS (SELECT *, load / greatest(csa, 1e-6::DOUBLE) AS sx, load / (2 * greatest(csa, 1e-6::DOUBLE)) AS t, load / greatest(csa, 1e-6::DOUBLE) * 0.3::DOUBLE * (r / (r + 10)) AS sy FROM a),
c AS (SELECT *, floor(sqrt(sx * sx - sx * sy + sy * sy + 3 * t * t) * 100 + 0.5) / 100 AS von_mises, load * length * length * length / (48 * greatest(e * moi, 1e-12::DOUBLE)) AS bend FROM b),
s AS (SELECT *, floor(y / von_mises * 1000 + 0.5) / 1000 AS safety_factor, floor(bend * 1000 * 100 + 0.5) / 100 AS deflection_mm, floor(length / bend + 0.5) AS span_ratio FROM c)"""


_BASES = "SELECT s_suppkey, 0.001::DOUBLE + s_suppkey % 10 / 1000.0::DOUBLE AS csa, 1::DOUBLE + s_suppkey % 5 AS length, abs(s_acctbal) AS force FROM supplier"


@query(f"""
WITH base AS ({_BASES}), f(scale) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in structural.SCALES)}), names(material) AS (VALUES {', '.join(f"('{m}')" for m in structural.MATERIALS)}),
x AS (SELECT s_suppkey, material, scale, csa * scale AS csa, length, force FROM base, f, names),
{_beam_sql("SELECT *, csa * length AS volume, sqrt(csa) * 4 * length AS surface_area, csa * csa / (4 * pi()) AS moi FROM x")},
q AS (SELECT *, volume * rho * kg AS raw, surface_area * 50 * mf AS mach FROM s),
t AS (SELECT *, floor((raw + mach + raw * wf + (raw + mach) * ((1.2::DOUBLE - 1.0) * 0.3::DOUBLE + CASE WHEN safety_factor > 1.5 THEN pow((safety_factor - 1.5) / 2, 1.3::DOUBLE) * 0.15::DOUBLE ELSE 0 END)) * 100 + 0.5) / 100 AS total FROM q),
u AS (SELECT *, safety_factor >= 1.5 AND deflection_mm <= 10 AND span_ratio >= 250 AS meets, floor((total + (CASE WHEN safety_factor >= 1.5 THEN 0 ELSE 10000 * (1.5 - safety_factor) END + CASE WHEN deflection_mm <= 10 THEN 0 ELSE 5000 * (deflection_mm - 10) END + CASE WHEN span_ratio >= 250 THEN 0 ELSE 3000 * (250 - span_ratio) / 250 END)) * 100 + 0.5) / 100 AS score FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY meets DESC, score, material, scale) AS rank FROM u)
SELECT s_suppkey, material, scale, meets, round(score, 1) AS score FROM w WHERE rank <= 3
""")
def design_grid(spark, d):
    k = F.col("s_suppkey")
    own = table(spark, d, "supplier").select("s_suppkey", (0.001 + k % 10 / 1000.0).alias("csa"), (1.0 + k % 5).alias("length"), F.abs("s_acctbal").alias("force"))
    return structural.grid_search(own, "s_suppkey").filter("rank <= 3").select("s_suppkey", "material", "scale", "meets", F.round("score", 1).alias("score"))


@query(f"""
WITH {_beam_sql("SELECT p_partkey, 0.01::DOUBLE AS volume, 1::DOUBLE AS surface_area, 'steel' AS material, 0.0001::DOUBLE * (1 + p_size) AS csa, 0.0000001::DOUBLE * (1 + p_size % 20) AS moi, 1::DOUBLE + p_partkey % 3 AS length, p_retailprice * 20 AS force FROM part")},
k AS (SELECT *, von_mises / y AS used FROM s),
z AS (SELECT p_partkey, list_filter([CASE WHEN safety_factor < 1 THEN 'Increase cross-section thickness' END, CASE WHEN safety_factor >= 1 AND safety_factor < 1.5 THEN 'Marginal safety factor' END, CASE WHEN safety_factor > 3 THEN 'Reduce thickness to save weight' END,
  CASE WHEN used > 0.9 AND safety_factor >= 1 THEN 'High stress concentration' END, CASE WHEN used < 0.3 AND safety_factor > 2 THEN 'Simplify geometry' END, CASE WHEN span_ratio < 250 THEN 'Increase moment of inertia' END, CASE WHEN span_ratio > 1000 AND safety_factor > 2 THEN 'Reduce section depth' END], lambda x: x IS NOT NULL) AS l FROM k)
SELECT unnest(CASE WHEN len(l) > 0 THEN l ELSE ['Design looks good'] END) AS advice, count(*) AS n FROM z GROUP BY 1
""")
def design_advice(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    own = table(spark, d, "part").select(
        "p_partkey", F.lit(0.01).alias("volume"), F.lit(1.0).alias("surface_area"), F.lit("steel").alias("material"), (0.0001 * (1 + size)).alias("csa"),
        (0.0000001 * (1 + size % 20)).alias("moi"), (1.0 + k % 3).alias("length"), (F.col("p_retailprice") * 20).alias("force"),
    )
    return structural.recommendations(structural.beam(own)).select(F.explode("advice").alias("advice")).groupBy("advice").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, -p_retailprice AS b FROM part),
r(level, id, a, b) AS (SELECT 0, id, a, b FROM p UNION ALL SELECT l.level + 1, y.id, y.a, y.b FROM p y, (SELECT max(level) AS level FROM r) l WHERE l.level IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.a <= y.a AND r.b <= y.b AND (r.a < y.a OR r.b < y.b)))
SELECT id AS p_partkey, max(level)::INT AS front FROM r GROUP BY id
""")
def front_ranks(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (-F.col("p_retailprice")).alias("b"))
    return decision.front_ranks(own, "p_partkey", ["a", "b"])


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT max(vec_id) + 1 AS m FROM v),
g AS (SELECT vec_id AS edge_id, (vec_id * 7 + 1) % m AS from_id, label / 10.0::DOUBLE AS w FROM v, m)
SELECT query_id, row_id, round(score, 8) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
    SELECT q.vec_id AS query_id, edge_id AS row_id, round(0.7::DOUBLE * list_cosine_similarity(q.e, p.e) + 0.3::DOUBLE * w, 12) AS score FROM v q, g JOIN v p ON p.vec_id = g.from_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5
""")
def edge_weighted_rank(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    m = own.agg(F.max("vec_id")).first()[0] + 1
    edges = own.select(F.col("vec_id").alias("edge_id"), ((F.col("vec_id") * 7 + 1) % m).alias("from_id"), (F.col("label") / 10.0).alias("weight"))
    out = similarity.memory_rank(own.filter("vec_id % 100 = 0"), own, edges, "vec_id", "e")
    return out.select("query_id", "row_id", F.round("score", 8).alias("score"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, x.vec_id AS row_id, round(list_cosine_similarity(q.e, x.e), 12) AS s FROM v q, v x WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
t AS (SELECT query_id, row_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS n FROM c) WHERE n <= 40),
o AS (SELECT vec_id AS row_id, label % 10 / 10.0::DOUBLE AS defect FROM embeddings WHERE vec_id % 2 = 0), st AS (SELECT vec_id AS row_id, 100.0::DOUBLE + vec_id % 300 AS stress FROM embeddings WHERE vec_id % 3 = 0)
SELECT query_id, row_id, round(0.5 * s + 0.3::DOUBLE * coalesce(1 / (1 + abs(stress - 200) / 100), 0) + 0.2::DOUBLE * least(1, defect) + 3.7e-11, 8) AS score FROM t JOIN o USING (row_id) LEFT JOIN st USING (row_id)
""")
def fused_failure_rank(spark, d):
    e = table(spark, d, "embeddings")
    near = similarity.top_k(e, F.col("vec_id") % 100 == 0, 40, "vec_id", "embedding").select("query_id", "row_id", "score")
    outcomes = e.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 2).cast("int").alias("passed"), (F.col("label") % 10 / 10.0).alias("defect_rate"))
    edges = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("to_id"), F.col("vec_id").alias("from_id"), F.lit(0).alias("position"))
    sims = e.select(F.col("vec_id").alias("from_id"), (100.0 + F.col("vec_id") % 300).alias("stress"))
    out = similarity.failure_rank(near, outcomes, edges, sims, 200.0, 40)
    return out.select("query_id", "row_id", F.round(F.col("score") + 3.7e-11, 8).alias("score"))


@query("""
WITH s AS (SELECT s_suppkey AS id, s_nationkey % 3 AS domain, s_nationkey % 2 AS regime, s_acctbal / 2000 AS x FROM supplier),
q AS (SELECT c_custkey AS id, c_nationkey % 3 AS domain, c_nationkey % 2 AS regime, c_acctbal / 2000 AS x, c_custkey % 2 = 0 AS spd, c_custkey % 10 / 10.0::DOUBLE AS nl, c_custkey % 7 / 7.0::DOUBLE AS ms FROM customer),
n AS (SELECT q.*, (SELECT min({'d': abs(q.x - s.x), 'id': s.id, 'r': s.regime}) FROM s WHERE s.domain = q.domain) AS b FROM q)
SELECT id, CASE WHEN ms >= 0.4 AND b.r = regime AND b.d <= 0.35 AND 0.005::DOUBLE + 0.06::DOUBLE * (b.d / 0.35::DOUBLE) * (b.d / 0.35::DOUBLE) <= 0.05 THEN 'cache' WHEN ms >= 0.4 AND b.d <= 1.2 AND (spd OR nl < 0.4) THEN 'rom' ELSE 'full' END AS stage, b.id AS nearest_id FROM n
""")
def reuse_routes(spark, d):
    solved = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("domain"), (F.col("s_nationkey") % 2).alias("regime"), F.array(F.col("s_acctbal") / 2000).alias("latent"))
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(k.alias("id"), (F.col("c_nationkey") % 3).alias("domain"), (F.col("c_nationkey") % 2).alias("regime"), F.array(F.col("c_acctbal") / 2000).alias("latent"), (k % 2 == 0).alias("spd"), (k % 10 / 10.0).alias("nonlinearity"), (k % 7 / 7.0).alias("mesh_score"))
    return simulation.route(asked, solved).select("id", "stage", "nearest_id")


@query("""
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_tax / 4 AS error, l_extendedprice AS full_ms, l_extendedprice * (1 - l_discount * 5) AS routed_ms FROM lineitem ORDER BY seq DESC LIMIT 256),
o AS (SELECT count(*) AS n, avg(error) AS e, (sum(full_ms) - sum(routed_ms)) / sum(full_ms) AS s FROM l)
SELECT n, round(e, 9) AS mean_error, round(s, 9) AS saved, n >= 24 AND e <= 0.02 AND s >= 0.2 AS ready FROM o
""")
def reuse_gate(spark, d):
    p = F.col("l_extendedprice")
    own = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_tax") / 4).alias("error"), p.alias("full_ms"), (p * (1 - F.col("l_discount") * 5)).alias("routed_ms"))
    return simulation.gate(own).select("n", F.round("mean_error", 9).alias("mean_error"), F.round("saved", 9).alias("saved"), "ready")


# --- rates, learning, features ------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT o_orderpriority AS strategy, l_orderkey AS tick, sum(l_quantity) AS wall, sum(l_tax) AS gpu, count(*) * 100 AS cand, sum(l_linenumber) AS em, count(DISTINCT l_linenumber % 4) AS un, count(*) FILTER (l_discount > 0.05) AS dr FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY tick DESC) AS n FROM l) WHERE n <= 240)
SELECT strategy, count(*) AS n, round(avg(wall), 6) AS total_wall_ms, round(avg(gpu), 6) AS total_gpu_ms, round(avg(em / wall), 8) AS emitted_per_ms, round(avg(cand / wall), 8) AS candidates_per_ms, round(avg(em / cand), 8) AS emission_ratio, round(avg(un / em), 8) AS dedup_ratio, round(avg(dr / (em + dr)), 8) AS saturation_ratio FROM t GROUP BY 1
""")
def strategy_rates(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("strategy"))
    own = l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy("strategy", F.col("l_orderkey").alias("tick")).agg(
        F.collect_list("l_quantity").alias("wall_ms"), F.collect_list("l_tax").alias("gpu_ms"), (F.count(F.lit(1)) * 100).alias("candidates"), F.sum("l_linenumber").alias("emitted"),
        F.count_distinct(F.col("l_linenumber") % 4).alias("uniq"), F.count_if(F.col("l_discount") > 0.05).alias("dropped"),
    )
    out = materials.mean_rates(materials.rates(own), "strategy", "tick")
    return out.select("strategy", "n", *(F.round(c, 6).alias(c) for c in ("total_wall_ms", "total_gpu_ms")), *(F.round(c, 8).alias(c) for c in materials.RATES[1:]))


_W = ([0.5, -0.25, 0.1], [1.5, -2.0, -0.2])
_HAT = "SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS q, (l_returnflag = 'R')::INT AS y, l_quantity / 50 * 0.5 + l_discount * 10 * -0.25 + 0.1::DOUBLE AS qh, 1 / (1 + exp(-(l_quantity / 50 * 1.5 + l_discount * 10 * -2.0 + -0.2::DOUBLE))) AS p FROM lineitem"


def _predicted(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("q"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return learning.predict(own, ["a", "b"], *_W)


@query(f"WITH h AS ({_HAT}) SELECT count(*) AS n, round(avg((qh - q) * (qh - q)), 8) AS mse, round(avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))), 8) AS bce, round(avg(((p >= 0.5) = (y = 1))::INT::DOUBLE), 9) AS accuracy FROM h")
def model_evaluation(spark, d):
    return learning.evaluate(_predicted(spark, d), "q", "y").select("n", F.round("mse", 8).alias("mse"), F.round("bce", 8).alias("bce"), F.round("accuracy", 9).alias("accuracy"))


@query("""
WITH h AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS a, p_retailprice / 2500 AS b, 1 / (1 + exp(-(p_size / 50.0::DOUBLE * 1.5 + p_retailprice / 2500 * -2.0 + -0.2::DOUBLE))) AS p FROM part),
t AS (SELECT id, f, x, slope, greatest(0, least(1, x + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, slope)))) AS z FROM (SELECT *, 'a' AS f, a AS x, 0.5::DOUBLE - p * (1 - p) * 1.5::DOUBLE AS slope FROM h UNION ALL SELECT *, 'b', b, -0.25::DOUBLE - p * (1 - p) * -2.0::DOUBLE FROM h))
SELECT id, f AS feature, round(z, 9) AS after, round(slope * (z - x), 9) AS gain FROM t WHERE slope * (z - x) > 1e-5
""")
def tweak_gains(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2500).alias("b"))
    out = learning.tweaks(own, "id", ["a", "b"], *_W)
    return out.select("id", "feature", F.round("after", 9).alias("after"), F.round("gain", 9).alias("gain"))


@query("WITH w AS (SELECT p_brand, abs(sum(p_size - 25)) + abs(sum(p_retailprice - 1000)) AS s FROM part GROUP BY 1) SELECT p_brand, round(s / max(s) OVER (), 9) AS importance FROM w")
def feature_importance(spark, d):
    w = table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.col("p_size") - 25).alias("u"), F.sum(F.col("p_retailprice") - 1000).alias("v"))
    return learning.importance(w, "p_brand", ["u", "v"]).select("p_brand", F.round("importance", 9).alias("importance"))


@query("""
WITH b AS (SELECT * FROM (SELECT l_partkey, l_discount, l_tax, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_discount, l_tax) AS n FROM lineitem) WHERE n <= 3)
SELECT l_partkey, count(*) AS n, round(avg(l_discount), 9) AS l_discount_mean, round(coalesce(stddev_samp(l_discount), 0), 9) AS l_discount_std, round(avg(l_tax), 9) AS l_tax_mean, round(coalesce(stddev_samp(l_tax), 0), 9) AS l_tax_std FROM b GROUP BY 1
""")
def fit_consensus(spark, d):
    out = learning.consensus(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", ["l_discount", "l_tax"])
    return out.select("l_partkey", "n", *(F.round(c, 9).alias(c) for c in ("l_discount_mean", "l_discount_std", "l_tax_mean", "l_tax_std")))


@query("""
SELECT p_partkey, round(p_size / 200.0, 9) AS f0, round(p_retailprice / 2000, 9) AS f3, 0.0::DOUBLE AS f6, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS f16, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS f17 FROM part
""")
def run_parameter_features(spark, d):
    k = F.col("p_partkey")
    params = F.create_map(
        F.lit("gravity"), F.col("p_size").cast("string"), F.lit("particleCount"), F.col("p_retailprice").cast("string"), F.lit("edgesPerNode"), F.lit("many"),
        F.lit("integrator"), F.when(k % 3 == 0, "verlet").when(k % 3 == 1, "semi-euler").otherwise("euler"), F.lit("boundary"), F.when(k % 2 == 0, "periodic").otherwise("open"),
    )
    own = table(spark, d, "part").select("p_partkey", features.run_features(params).alias("v"))
    return own.select("p_partkey", *(F.round(F.col("v")[i], 9).alias(f"f{i}") for i in (0, 3, 6, 16, 17)))


@query("""
SELECT o_orderkey, round(log10(greatest(1, o_totalprice)), 9) AS v0, least(1, o_custkey / 1000.0::DOUBLE) AS v1, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS v3, CASE WHEN o_custkey % 5 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS v15, (o_orderkey % 9)::DOUBLE AS v18, 0.0::DOUBLE AS v20 FROM orders
""")
def simulation_descriptors(spark, d):
    k = F.col("o_custkey")
    numbers = {x: F.lit(1.0) for x in ("log_kappa", "nonlinearity", "elements", "nodes", "aspect_max", "aspect_mean", "min_angle", "max_angle", "jacobian_min", "skewness")}
    own = numbers | {"unknowns": F.col("o_totalprice"), "density": k / 1000.0, "spd": F.col("o_orderstatus") == "F", "domain": F.element_at(F.array(*map(F.lit, features.DOMAINS)), (k % 5 + 1).cast("int"))}
    v = features.descriptor(own, F.array(F.col("o_orderkey") % 9, F.lit(4).cast("long")))
    return table(spark, d, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", *(F.round(F.col("v")[i], 9).alias(f"v{i}") for i in (0, 1, 3, 15, 18, 20)))


@query("""
WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y, 3.0::DOUBLE AS z, p_partkey % 10 / 10.0::DOUBLE AS r FROM part WHERE p_size > 0)
SELECT p_partkey, round(least(x, y, z) / greatest(x, y, z), 9) AS v0, round(least(1, greatest(x, y, z) / least(x, y, z) / 10), 9) AS v1, round(1 - r, 9) AS v2, round(least(1, x * y * z / 1000), 9) AS v5, round(least(1, 2 * (x * y + y * z + x * z) / 1300), 9) AS v6 FROM b
""")
def learning_vectors(spark, d):
    zero, r = F.lit(0.0), F.col("p_partkey") % 10 / 10.0
    v = features.learning_vector([zero] * 3, [F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.lit(3.0)], {"stress": r, "thermal": r, "fabrication": r}, {"toroidal": zero, "spline": zero, "planar": zero}, zero)
    return table(spark, d, "part").filter("p_size > 0").select("p_partkey", v.alias("v")).select("p_partkey", *(F.round(F.col("v")[i], 9).alias(f"v{i}") for i in (0, 1, 2, 5, 6)))


_SIGNED = "SELECT l_partkey, l_discount - 0.05::DOUBLE AS dist, l_quantity AS x, l_tax AS y FROM lineitem"


@query(f"WITH s AS ({_SIGNED}) SELECT l_partkey, round(avg((dist < 0)::INT::DOUBLE), 9) AS inside, round(coalesce(avg(abs(dist)) FILTER (dist < 0), 0), 9) AS thickness, round(avg((abs(dist) / 0.0625::DOUBLE * 16 >= 15)::INT::DOUBLE), 9) AS last_share FROM s GROUP BY 1")
def band_profiles(spark, d):
    own = table(spark, d, "lineitem").select("l_partkey", (F.col("l_discount") - 0.05).alias("dist"), F.lit(0.0625).alias("band"))
    out = features.band_profile(own, "l_partkey", "dist", "band")
    return out.select("l_partkey", F.round("inside", 9).alias("inside"), F.round("thickness", 9).alias("thickness"), F.round(F.col("shares")[15], 9).alias("last_share"))


@query(f"WITH s AS ({_SIGNED}) SELECT l_partkey, round(coalesce(avg(x) FILTER (dist < 0), (min(x) + max(x)) / 2), 9) AS x, round(coalesce(avg(y) FILTER (dist < 0), (min(y) + max(y)) / 2), 9) AS y FROM s GROUP BY 1")
def inner_centres(spark, d):
    own = table(spark, d, "lineitem").select("l_partkey", (F.col("l_discount") - 0.05).alias("dist"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    return features.inner_centre(own, "l_partkey", "dist", ["x", "y"]).select("l_partkey", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY 1")
def label_counts(spark, d):
    return features.label_counts(table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("day")), "day")


@query("""
(SELECT p_partkey, 'split' AS action FROM part ORDER BY p_retailprice / 2100 DESC, p_partkey LIMIT 50) UNION ALL SELECT p_partkey, 'merge' FROM part WHERE p_retailprice / 2100 <= 0.45
""")
def refinement_actions(spark, d):
    own = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 2100).alias("error"))
    return features.refinement_plan(own, "p_partkey", 0.0, 0.45, 50)


@query("""
WITH m AS (SELECT (min(p_size) + max(p_size)) / 2.0 AS a, (min(p_retailprice) + max(p_retailprice)) / 2 AS b FROM part), s AS (SELECT sum(CASE WHEN p_size < a THEN p_partkey % 7 ELSE 0 END) AS a1, sum(CASE WHEN p_size >= a THEN p_partkey % 7 ELSE 0 END) AS a2, sum(CASE WHEN p_retailprice < b THEN p_partkey % 7 ELSE 0 END) AS b1, sum(CASE WHEN p_retailprice >= b THEN p_partkey % 7 ELSE 0 END) AS b2 FROM part, m)
SELECT 'p_size' AS axis, round(least(a1, a2) / greatest(a1, a2), 9) AS balance FROM s UNION ALL SELECT 'p_retailprice', round(least(b1, b2) / greatest(b1, b2), 9) FROM s
""")
def mirror_balance(spark, d):
    return features.mirror_balance(table(spark, d, "part"), ["p_size", "p_retailprice"], (F.col("p_partkey") % 7).cast("double")).select("axis", F.round("balance", 9).alias("balance"))


@query("""
WITH RECURSIVE r AS (SELECT user_id, value, (value - lag(value, 3) OVER (PARTITION BY user_id ORDER BY event_id)) / 3 AS slope, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events),
f AS (SELECT user_id, 0 AS step, value AS v, coalesce(slope, 0) AS s FROM r WHERE n = 1 UNION ALL SELECT user_id, step + 1, v + s * 0.995::DOUBLE, s * 0.995::DOUBLE FROM f WHERE step < 20)
SELECT user_id, step, round(v + 3.7e-9, 6) AS forecast FROM f WHERE step > 0
""")
def damped_forecast(spark, d):
    return telemetry.forecast(table(spark, d, "events"), "user_id", ["event_id"], "value", 20, damping=0.995).select("user_id", "step", F.round(F.col("forecast") + 3.7e-9, 6).alias("forecast"))


# --- cells, surfaces, parts ---------------------------------------------------------------------------------------

_CELLS = "SELECT DISTINCT l_quantity::BIGINT AS i, round(l_discount * 100)::BIGINT AS j, round(l_tax * 100)::BIGINT AS k FROM lineitem"


def _cells(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.round(F.col("l_tax") * 100).cast("long").alias("k")).distinct()
    return own.withColumn("id", F.col("i") * 10000 + F.col("j") * 100 + F.col("k"))


def _leaves(spark, d):
    return _cells(spark, d).select("id", *(f.alias(f"{m}_{a}") for a, c in zip("xyz", "ijk") for m, f in (("min", F.col(c) * 0.5), ("max", (F.col(c) + 1) * 0.5))))


@query(f"WITH c AS ({_CELLS}) SELECT a.i * 10000 + a.j * 100 + a.k AS a, b.i * 10000 + b.j * 100 + b.k AS b, CASE WHEN b.i > a.i THEN 'x' WHEN b.j > a.j THEN 'y' ELSE 'z' END AS axis, 0.25::DOUBLE AS area FROM c a JOIN c b ON (b.i - a.i, b.j - a.j, b.k - a.k) IN ((1, 0, 0), (0, 1, 0), (0, 0, 1))")
def leaf_face_join(spark, d):
    return topology.leaf_faces(_leaves(spark, d)).select("a", "b", "axis", F.round("area", 9).alias("area"))


@query("""
WITH p AS (SELECT event_id AS n, floor(value / 2 + 0.5) AS a, floor(user_id % 10 / 2.0 + 0.5) AS b FROM events), f AS (SELECT a, b, min(n) AS first FROM p GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS vertex FROM f)
SELECT n, vertex, first FROM p JOIN v USING (a, b)
""")
def vertex_pool(spark, d):
    own = table(spark, d, "events").select(F.col("event_id").alias("n"), F.col("value").alias("x"), (F.col("user_id") % 10).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return topology.vertex_pool(own, "n", 2.0)


_CODES = "(SELECT sum((((i * 16 >> b) & 1) << (3 * b + 2)) + (((j * 16 >> b) & 1) << (3 * b + 1)) + (((k * 16 >> b) & 1) << (3 * b))) FROM range(10) r(b))"


@query(f"WITH c AS ({_CELLS}), n AS (SELECT count(*) AS n, count(*) // 7 AS base, count(*) % 7 AS more FROM c), o AS (SELECT i * 10000 + j * 100 + k AS id, row_number() OVER (ORDER BY {_CODES}, i * 10000 + j * 100 + k) - 1 AS r FROM c) SELECT id, CASE WHEN r < more * (base + 1) THEN r // (base + 1) ELSE more + (r - more * (base + 1)) // base END::INTEGER AS part FROM o, n")
def strip_parts(spark, d):
    own = _cells(spark, d).select("id", (F.col("i") / 64).alias("x"), (F.col("j") / 64).alias("y"), (F.col("k") / 64).alias("z"))
    return topology.strip_partition(own, 7)


@query("WITH o AS (SELECT o_custkey % 8 AS part, sum(CASE WHEN o_shippriority > 0 THEN o_shippriority ELSE 1 END) AS load FROM (SELECT o_custkey, o_orderkey % 3 AS o_shippriority FROM orders) GROUP BY 1) SELECT part, load::DOUBLE AS load, round(avg(load) OVER (), 6) AS target, round(load / avg(load) OVER () - 1, 9) AS over FROM o")
def part_loads(spark, d):
    own = table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("owner"), (F.col("o_orderkey") % 3).alias("w"))
    return topology.loads(own, F.col("w")).select("part", F.col("load").cast("double").alias("load"), F.round("target", 6).alias("target"), F.round("over", 9).alias("over"))


_FIELD = "SELECT l_quantity::BIGINT AS i, round(l_discount * 100)::BIGINT AS j, avg(l_extendedprice) / 10000 AS z FROM lineitem GROUP BY 1, 2"


def _field(spark, d):
    own = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j")).agg((F.avg("l_extendedprice") / 10000).alias("z"))
    vertices = own.select((F.col("i") * 100 + F.col("j")).alias("vid"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "z")
    corner = lambda a, b: ((F.col("i") + a) * 100 + F.col("j") + b)
    each = own.select("i", "j", F.explode(F.array(F.struct(F.lit(0).alias("h"), corner(0, 0).alias("v0"), corner(1, 0).alias("v1"), corner(0, 1).alias("v2")), F.struct(F.lit(1).alias("h"), corner(1, 0).alias("v0"), corner(1, 1).alias("v1"), corner(0, 1).alias("v2")))).alias("t"))
    rows = each.select((F.col("i") * 1000 + F.col("j") * 2 + F.col("t.h")).alias("tri_id"), "t.v0", "t.v1", "t.v2")
    for c in ("v0", "v1", "v2"):
        rows = relational.having(rows, vertices, c, "vid")
    return vertices, rows


_TRI = f"""
f AS ({_FIELD}), v AS (SELECT i * 100 + j AS vid, i::DOUBLE AS x, j::DOUBLE AS y, z FROM f),
t AS (SELECT i * 1000 + j * 2 AS tri, i * 100 + j AS a, (i + 1) * 100 + j AS b, i * 100 + j + 1 AS c FROM f UNION ALL SELECT i * 1000 + j * 2 + 1, (i + 1) * 100 + j, (i + 1) * 100 + j + 1, i * 100 + j + 1 FROM f),
u AS (SELECT t.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM t JOIN v p ON p.vid = a JOIN v q ON q.vid = b JOIN v r ON r.vid = c)"""


@query(f"""
WITH {_TRI}, l AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) + (az - bz) * (az - bz)) AS ab, sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) + (az - cz) * (az - cz)) AS ac, sqrt((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_) + (cz - bz) * (cz - bz)) AS bc FROM u),
k AS (SELECT *, acos(greatest(-1, least(1, (ab * ab + ac * ac - bc * bc) / (2 * ab * ac)))) AS wa, acos(greatest(-1, least(1, (ab * ab + bc * bc - ac * ac) / (2 * ab * bc)))) AS wb, acos(greatest(-1, least(1, (ac * ac + bc * bc - ab * ab) / (2 * ac * bc)))) AS wc,
  sqrt(greatest(0, (ab + ac + bc) * (ab + ac - bc) * (ab + bc - ac) * (ac + bc - ab))) / 4 AS area FROM l),
s AS (SELECT vid, sum(w) AS w, sum(area) / 3 AS area FROM (SELECT a AS vid, wa AS w, area FROM k UNION ALL SELECT b, wb, area FROM k UNION ALL SELECT c, wc, area FROM k) GROUP BY 1)
SELECT vid, round(area, 5) AS area, round((2 * pi() - w) / area, 4) AS gauss FROM s
""")
def vertex_curvature(spark, d):
    vertices, triangles = _field(spark, d)
    return topology.curvature(triangles, vertices).select("vid", F.round("area", 5).alias("area"), F.round("gauss", 4).alias("gauss"))


@query(f"""
WITH {_TRI}, e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT a, b FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t)),
m AS (SELECT vid, x, y, z, x AS mx, y AS my, z * 1.5::DOUBLE AS mz FROM v), g AS (SELECT abs(sqrt((p.mx - q.mx) * (p.mx - q.mx) + (p.my - q.my) * (p.my - q.my) + (p.mz - q.mz) * (p.mz - q.mz)) / sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) - 1) AS s FROM e JOIN m p ON p.vid = e.a JOIN m q ON q.vid = e.b)
SELECT (SELECT round(avg(abs(mz - z)), 8) FROM m) AS mean_shift, (SELECT round(max(abs(mz - z)), 8) FROM m) AS most_shift, round(avg(s), 8) AS mean_stretch, round(max(s), 8) AS most_stretch FROM g
""")
def surface_deformation(spark, d):
    vertices, triangles = _field(spark, d)
    ends = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))))
    edges = triangles.select(F.explode(ends).alias("e")).select("e.*").distinct()
    out = topology.deformation(edges, vertices, vertices.withColumn("z", F.col("z") * 1.5))
    return out.select(*(F.round(c, 8).alias(c) for c in ("mean_shift", "most_shift", "mean_stretch", "most_stretch")))


def _blocks(spark, d):
    """A tetrahedron for each cell: its corner and the three next ones."""
    own = _cells(spark, d)
    v = lambda a, b, c: ((F.col("i") + a) * 10000 + (F.col("j") + b) * 100 + F.col("k") + c)
    tets = own.select(F.col("id").alias("tet_id"), v(0, 0, 0).alias("v0"), v(1, 0, 0).alias("v1"), v(0, 1, 0).alias("v2"), v(0, 0, 1).alias("v3"), F.lit(2.0).alias("kappa"))
    vid = tets.select(F.explode(F.array("v0", "v1", "v2", "v3")).alias("vid")).distinct()
    return tets, vid.select("vid", F.floor(F.col("vid") / 10000).cast("double").alias("x"), (F.floor(F.col("vid") / 100) % 100).cast("double").alias("y"), (F.col("vid") % 100).cast("double").alias("z"))


@query(f"WITH c AS ({_CELLS}) SELECT count(*) AS n_tets, round(sqrt(2), 9) AS mean_aspect, round(count(*) / 6, 6) AS volume, 0::BIGINT AS inverted, 0::BIGINT AS non_manifold FROM c")
def tet_quality(spark, d):
    out = mesh.quality(*_blocks(spark, d))
    return out.select("n_tets", F.round("mean_aspect", 9).alias("mean_aspect"), F.round("volume", 6).alias("volume"), "inverted", "non_manifold")


@query(f"""
WITH c AS ({_CELLS}), e AS (SELECT i * 10000 + j * 100 + k AS o, i, j, k FROM c),
m AS (SELECT o AS row, o AS col, 1.0::DOUBLE AS v FROM e UNION ALL SELECT o + s, o + s, 1.0 / 3 FROM e, (VALUES (10000), (100), (1)) t(s) UNION ALL SELECT o, o + s, -1.0 / 3 FROM e, (VALUES (10000), (100), (1)) t(s) UNION ALL SELECT o + s, o, -1.0 / 3 FROM e, (VALUES (10000), (100), (1)) t(s)
  UNION ALL SELECT o + s, o + u, 0.0 FROM e, (VALUES (10000), (100), (1)) t(s), (VALUES (10000), (100), (1)) w(u) WHERE s <> u)
SELECT row, col, round(sum(v) + 0.0, 8) AS value FROM m GROUP BY 1, 2
""")
def tet_stiffness(spark, d):
    out = mesh.stiffness(*_blocks(spark, d))
    return out.select("row", "col", (F.round("value", 8) + 0.0).alias("value"))


@query("""
WITH RECURSIVE e AS (SELECT o_custkey AS a, min(o_custkey) OVER (ORDER BY o_custkey RANGE BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS b FROM orders), g AS (SELECT DISTINCT a, b FROM e WHERE b IS NOT NULL),
r(key, depth) AS (SELECT min(a), 0 FROM g UNION SELECT g.b, depth + 1 FROM r JOIN g ON g.a = r.key WHERE depth < 12)
SELECT max(depth) AS steps, max(key) AS last FROM r
""")
def shortest_chain(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("a")).distinct()
    near = ordered.beside(keys, "a", "a").select("a", F.col("_after").alias("b")).filter("b - a <= 40").withColumn("position", F.lit(0))
    start = keys.agg(F.min("a")).first()[0]
    reach = graph.depths(near, spark.createDataFrame([(start,)], "key bigint"), 12)
    last = reach.orderBy(F.desc("depth")).first()
    path = graph.shortest_path(near, start, last["key"])
    return spark.createDataFrame([(len(path) - 1, path[-1])], "steps int, last bigint")


# --- rows of the service's tables ---------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey % 3 = 0)")
def scope_members(spark, d):
    scopes = F.array_compact(F.array(F.when(F.col("c_mktsegment") == "BUILDING", "read"), F.when(F.col("c_nationkey") % 3 == 0, "read"), F.lit("ping")))
    own = table(spark, d, "customer").withColumn("scopes", scopes).withColumn("revoked_at", F.when(F.col("c_custkey") % 7 == 0, F.lit("2024-01-01")))
    return relational.scoped(own, "read").select("c_custkey")


@query("SELECT 'admin' AS who, count(*) AS n FROM orders UNION ALL SELECT 'user', count(*) FROM orders WHERE o_custkey = 4")
def row_policies(spark, d):
    roles = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") == 3, "admin").otherwise("user").alias("role"))
    o = table(spark, d, "orders")
    count = lambda user, who: relational.visible(o, "o_custkey", user, roles).agg(F.lit(who).alias("who"), F.count(F.lit(1)).alias("n"))
    return count(3, "admin").unionByName(count(4, "user"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'full ' || c_custkey ELSE 'user' || c_custkey END AS name FROM customer")
def display_names(spark, d):
    k = F.col("c_custkey")
    meta = F.when(k % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("display_name")))).when(k % 3 == 1, F.to_json(F.struct(F.concat(F.lit("full "), k).alias("full_name"))))
    return table(spark, d, "customer").select("c_custkey", relational.display_name(meta, F.concat(F.lit("user"), k, F.lit("@example.com"))).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS updated_at FROM orders")
def updated_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.filter("o_orderkey % 4 <> 0").withColumn("updated_at", F.lit(1))
    new = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return relational.stamped(new, old, "o_orderkey", ["o_orderstatus", "o_totalprice"], F.lit(2)).select("o_orderkey", "updated_at")


@query("SELECT l_suppkey AS k, 'union' AS op FROM lineitem WHERE l_quantity > 45 UNION SELECT s_suppkey, 'union' FROM supplier WHERE s_acctbal < 0 UNION ALL (SELECT l_suppkey, 'both' FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey, 'both' FROM supplier WHERE s_acctbal < 0) UNION ALL (SELECT s_suppkey, 'first' FROM supplier EXCEPT SELECT l_suppkey, 'first' FROM lineitem WHERE l_quantity > 49)")
def set_operations(spark, d):
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    a, b = l.filter("l_quantity > 45").select(F.col("l_suppkey").alias("k")), s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("k"))
    rest = relational.in_first_only(s.select(F.col("s_suppkey").alias("k")), l.filter("l_quantity > 49").select("l_suppkey").distinct())
    named = lambda df, op: df.select("k", F.lit(op).alias("op"))
    return named(relational.agreed(a, b), "union").unionByName(named(relational.in_both(a, b), "both")).unionByName(named(rest, "first"))


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS grouping_id, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    out = relational.summary_sets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], {"n": F.count(F.lit(1)), "quantity": F.round(F.sum("l_quantity"), 2)})
    return out.select("l_returnflag", "l_linestatus", F.col("grouping_id").cast("long").alias("grouping_id"), "n", "quantity")


@query("SELECT p_size AS toggle, bool_and(p_retailprice > 905) AS allowed, count(*) FILTER (p_retailprice <= 905) AS n_lacking FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def capabilities(spark, d):
    own = table(spark, d, "part").select(F.col("p_size").alias("toggle"), F.col("p_name").alias("path"), (F.col("p_partkey") % 2 == 0).alias("active"), (F.col("p_retailprice") > 905).alias("capable"))
    return relational.all_capable(own, "toggle", "active", "capable").select("toggle", "allowed", F.size("lacking").cast("long").alias("n_lacking"))


@query("""
SELECT c_custkey AS file_id, 4::BIGINT AS n_entities, 1::BIGINT AS n_duplicates, 3::BIGINT AS n_references, 1::BIGINT AS n_orphans, c_nationkey::DOUBLE AS max_x FROM customer
""")
def exchange_files(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    body = F.format_string("HEADER;ENDSEC;DATA;\n#1=CARTESIAN_POINT('it''s #5;',(%d.,0.,-1.5));/* #9=X(); */\n#2=CARTESIAN_POINT('',(-2.,%d.E0,3.));#3=EDGE('',#1,#2);#3=EDGE('',#2,#2);#4=SHELL(#77);ENDSEC;", n, k)
    own = readers.entities(table(spark, d, "customer").select(k.alias("file_id"), body.alias("text")))
    refs = readers.references(own)
    facts = readers.describe(own).select("file_id", "n_entities", "n_duplicates", "max_x")
    counts = lambda df, name: df.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
    return facts.join(counts(refs, "n_references"), "file_id").join(counts(readers.orphans(own, refs), "n_orphans"), "file_id").select("file_id", "n_entities", "n_duplicates", "n_references", "n_orphans", "max_x")

"""Listings, lookups, flags, text cells, calibration and scaling over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.operators import decision, relational, stats, structural
from strataform.plans.base import registry, table

QUERIES, ORACLE, query = registry()


@query("""
SELECT o_orderkey, o_custkey, c_name, o_orderdate, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
""")
def jobs_filtered_latest(spark, d):
    found = relational.latest(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 50, {"o_orderstatus": "F"}, {"o_orderpriority": "urgent"})
    return relational.lookup(found, table(spark, d, "customer"), "o_custkey", "c_custkey", ["c_name"]).select("o_orderkey", "o_custkey", "c_name", "o_orderdate", "o_totalprice")


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def lookup_left_join(spark, d):
    return relational.lookup(table(spark, d, "supplier"), table(spark, d, "nation"), "s_nationkey", "n_nationkey", ["n_name"]).select("s_suppkey", "s_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def role_exists_semi(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
    return relational.having(table(spark, d, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)")
def orphan_anti(spark, d):
    return relational.lacking(table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size <= 40"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def root_anti(spark, d):
    return relational.lacking(table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity > 45"), "p_partkey", "l_partkey").select("p_partkey", "p_name")


@query("""
WITH h AS (
  SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split('beta:' || c_custkey, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295) AS u FROM customer
), b AS (SELECT *, abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 100 AS bucket FROM h)
SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN c_custkey % 2 = 0
  WHEN c_mktsegment = 'MACHINERY' THEN false
  WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 5 THEN true
  WHEN c_mktsegment <> 'BUILDING' AND (CASE WHEN c_mktsegment = 'FURNITURE' THEN 100 ELSE 30 END) = 100 THEN true
  ELSE c_mktsegment <> 'FURNITURE' AND bucket < 30 END AS enabled
FROM b
""")
def flag_eval(spark, d):
    c = table(spark, d, "customer")
    segment = F.col("c_mktsegment")
    override = F.when(F.col("c_custkey") % 17 == 0, F.col("c_custkey") % 2 == 0)
    rollout = F.when(segment == "FURNITURE", 100).otherwise(30)
    on = relational.flag_state(override, segment != "MACHINERY", segment == "BUILDING", F.col("c_nationkey") < 5, rollout, F.concat(F.lit("beta:"), F.col("c_custkey")))
    return c.select("c_custkey", on.alias("enabled"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def events_json_project(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
WITH c AS (
  SELECT 'tail' AS column_name, trim(regexp_extract(url, '([^/]*)$', 1)) AS cell FROM pages UNION ALL
  SELECT 'url', trim(url) FROM pages
)
SELECT column_name, count(*) FILTER (cell IS NULL OR cell = '') AS n_empty,
       count(*) FILTER (cell <> '' AND try_cast(cell AS DOUBLE) IS NOT NULL AND isfinite(try_cast(cell AS DOUBLE))) AS n_number,
       count(*) FILTER (cell <> '' AND NOT (try_cast(cell AS DOUBLE) IS NOT NULL AND isfinite(try_cast(cell AS DOUBLE)))) AS n_text
FROM c GROUP BY 1
""")
def cell_type_inference(spark, d):
    return relational.kinds_of_cells(table(spark, d, "pages").withColumn("tail", F.regexp_extract("url", "([^/]*)$", 1)), ["tail", "url"])


_FIT = """
WITH l AS (SELECT l_returnflag AS channel, l_extendedprice AS x, l_extendedprice * (1 - l_discount) AS y FROM lineitem),
s AS (SELECT channel, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM l GROUP BY 1),
m AS (SELECT *, ((n + 1e-3) * sxy - sx * sy) / ((sxx + 1e-3) * (n + 1e-3) - sx * sx) AS scale,
             ((sxx + 1e-3) * sy - sx * sxy) / ((sxx + 1e-3) * (n + 1e-3) - sx * sx) AS bias FROM s)
"""


def _measured(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))


@query(_FIT + "SELECT channel, n, round(scale, 8) AS scale, round(bias, 3) AS bias, round((sy - sx) / n, 4) AS bias0 FROM m")
def ridge_calibration(spark, d):
    fit = stats.ridge_fit(_measured(spark, d), "l_returnflag", "x", "y")
    return fit.select("channel", "n", F.round("scale", 8).alias("scale"), F.round("bias", 3).alias("bias"), F.round("bias0", 4).alias("bias0"))


@query(_FIT + """
SELECT l.channel, count(*) AS n, round(avg(y - x), 4) AS mean_raw, round(sqrt(avg((y - x) * (y - x))), 4) AS rmse_raw,
       round(sqrt(avg((y - (scale * x + bias)) * (y - (scale * x + bias)))), 4) AS rmse_corrected
FROM l JOIN m ON m.channel = l.channel GROUP BY 1
""")
def channel_residuals(spark, d):
    own = _measured(spark, d)
    fixed = stats.ridge_apply(own, stats.ridge_fit(own, "l_returnflag", "x", "y"), "l_returnflag", "x")
    out = stats.residual_stats(fixed, "l_returnflag", "x", "y", "corrected")
    return out.select("channel", "n", *(F.round(c, 4).alias(c) for c in ("mean_raw", "rmse_raw", "rmse_corrected")))


@query("""
SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 9) AS size_scaled,
       round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS price_scaled FROM part
""")
def minmax_scale_features(spark, d):
    out = stats.scale_features(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("p_size_scaled", 9).alias("size_scaled"), F.round("p_retailprice_scaled", 9).alias("price_scaled"))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 7) AS price_z FROM part")
def zscore_features(spark, d):
    return stats.scale_features(table(spark, d, "part"), ["p_retailprice"], "zscore").select("p_partkey", F.round("p_retailprice_scaled", 7).alias("price_z"))


@query("SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def histogram_with_zeros(spark, d):
    return stats.counts_with_zeros(table(spark, d, "customer").filter("c_acctbal > 9000"), "c_nationkey", table(spark, d, "nation"), "n_nationkey")


@query("SELECT 'l_extendedprice' AS column_name, round(max(abs(l_extendedprice - l_extendedprice::FLOAT::DOUBLE)), 12) AS max_abs_loss, 0::BIGINT AS overflows FROM lineitem UNION ALL SELECT 'l_tax', round(max(abs(l_tax - l_tax::FLOAT::DOUBLE)), 12), 0 FROM lineitem")
def precision_audit(spark, d):
    out = stats.precision_loss(table(spark, d, "lineitem"), ["l_extendedprice", "l_tax"])
    return out.select("column_name", F.round("max_abs_loss", 12).alias("max_abs_loss"), "overflows")


@query("SELECT l_returnflag, round(sum(l_extendedprice), 1) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(greatest(1.0, least(40.0, min(l_extendedprice) / 100)), 9) AS dt FROM lineitem GROUP BY 1")
def global_reduce(spark, d):
    out = stats.reduced(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", "l_extendedprice", 0.01, 1.0, 40.0)
    return out.select("l_returnflag", F.round("total", 1).alias("total"), "low", "high", F.round("dt", 9).alias("dt"))


@query("SELECT o_custkey, round(fsum(o_totalprice), 6) AS total FROM orders GROUP BY 1")
def compensated_sum(spark, d):
    return stats.exact_sum(table(spark, d, "orders"), "o_custkey", "o_totalprice").select("o_custkey", F.round("total", 6).alias("total"))


_BEAM = """
WITH g AS (
  SELECT p_partkey, 0.001::DOUBLE + p_size / 1000::DOUBLE AS volume, 0.5::DOUBLE + p_size / 20::DOUBLE AS surface_area,
         CASE p_partkey % 4 WHEN 0 THEN 'steel' WHEN 1 THEN 'aluminum' WHEN 2 THEN 'titanium' ELSE 'carbon-fiber' END AS material,
         0.002::DOUBLE + p_size / 10000::DOUBLE AS csa, 0.000001::DOUBLE * (1 + p_size) AS moi, 1::DOUBLE + p_partkey % 7 AS length, CASE WHEN p_partkey % 5 = 0 THEN 0::DOUBLE ELSE p_retailprice * 40 END AS force FROM part
), m AS (
  SELECT *, CASE material WHEN 'steel' THEN 250e6 WHEN 'aluminum' THEN 276e6 WHEN 'titanium' THEN 880e6 ELSE 600e6 END AS y,
         CASE material WHEN 'steel' THEN 200e9 WHEN 'aluminum' THEN 68.9e9 WHEN 'titanium' THEN 113.8e9 ELSE 150e9 END AS e,
         CASE material WHEN 'steel' THEN 7850.0::DOUBLE WHEN 'aluminum' THEN 2700.0 WHEN 'titanium' THEN 4430.0 ELSE 1600.0 END AS rho FROM g
), a AS (
  SELECT *, floor((CASE WHEN force > 0 THEN force ELSE (rho * volume::DOUBLE * 9.81::DOUBLE + 180 * surface_area::DOUBLE) * 1.5::DOUBLE END) * 100 + 0.5) / 100 AS load,
         least(surface_area::DOUBLE / volume::DOUBLE, 100) AS r FROM m
), b AS (SELECT *, load / csa::DOUBLE AS sx, load / (2 * csa::DOUBLE) AS t, load / csa::DOUBLE * 0.3::DOUBLE * (r / (r + 10)) AS sy FROM a),
c AS (SELECT *, floor(sqrt(sx * sx - sx * sy + sy * sy + 3 * t * t) * 100 + 0.5) / 100 AS von_mises, load * length::DOUBLE * length::DOUBLE * length::DOUBLE / (48 * (e * moi::DOUBLE)) AS bend FROM b),
s AS (SELECT *, floor(y / von_mises * 1000 + 0.5) / 1000 AS safety_factor, floor(bend * 1000 * 100 + 0.5) / 100 AS deflection_mm, floor(length::DOUBLE / bend + 0.5) AS span_ratio FROM c)
"""


def _beams(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.when(k % 4 == 0, "steel").when(k % 4 == 1, "aluminum").when(k % 4 == 2, "titanium").otherwise("carbon-fiber")
    own = table(spark, d, "part").select(
        "p_partkey", (0.001 + size / 1000).alias("volume"), (0.5 + size / 20).alias("surface_area"), kinds.alias("material"), (0.002 + size / 10000).alias("csa"),
        (0.000001 * (1 + size)).alias("moi"), (1.0 + k % 7).alias("length"), F.when(k % 5 == 0, 0.0).otherwise(F.col("p_retailprice") * 40).alias("force"),
    )
    return structural.beam(own)


@query(_BEAM + "SELECT p_partkey, load, von_mises, safety_factor, deflection_mm, span_ratio FROM s")
def beam_batch_scores(spark, d):
    return _beams(spark, d).select("p_partkey", "load", "von_mises", "safety_factor", "deflection_mm", "span_ratio")


@query(_BEAM + """, u AS (SELECT *, von_mises / y AS used FROM s)
SELECT p_partkey, CASE WHEN safety_factor < 1 OR used > 0.95 OR span_ratio < 200 OR deflection_mm > 50 THEN 'rejected'
  WHEN safety_factor < 1.67 OR used > 0.85 OR span_ratio < 360 OR deflection_mm > 25 THEN 'review-required' ELSE 'pass' END AS status FROM u
""")
def safety_buffer_status(spark, d):
    return structural.safety_buffer(_beams(spark, d)).select("p_partkey", "status")


@query(_BEAM + """, k AS (SELECT * FROM (VALUES ('AISC-360', 1.67::DOUBLE, 360::DOUBLE, 0.9::DOUBLE), ('Eurocode-3', 1.5, 250, 1.0), ('AS-4100', 1.5, 300, 0.9)) v(code, lsf, lspan, luse)),
u AS (SELECT *, von_mises / y AS used, length::DOUBLE / greatest(deflection_mm / 1000, 1e-9) AS span FROM s, k), checks AS (
  SELECT code, 'stress' AS "check", CASE WHEN used <= luse THEN 'pass' WHEN used <= luse * 1.05::DOUBLE THEN 'warning' ELSE 'fail' END AS status FROM u UNION ALL
  SELECT code, 'safety', CASE WHEN safety_factor >= lsf THEN 'pass' WHEN safety_factor >= lsf * 0.9::DOUBLE THEN 'warning' ELSE 'fail' END FROM u UNION ALL
  SELECT code, 'deflection', CASE WHEN span >= lspan THEN 'pass' WHEN span >= lspan * 0.85::DOUBLE THEN 'warning' ELSE 'fail' END FROM u)
SELECT code, "check", status, count(*) AS n FROM checks GROUP BY 1, 2, 3
""")
def compliance_matrix(spark, d):
    return structural.compliance(_beams(spark, d), "p_partkey").groupBy("code", "check", "status").agg(F.count(F.lit(1)).alias("n"))


@query(_BEAM + """, q AS (SELECT *, volume::DOUBLE * rho AS mass, CASE material WHEN 'steel' THEN 0.8::DOUBLE WHEN 'aluminum' THEN 2.5 WHEN 'titanium' THEN 25 ELSE 30 END AS kg,
  CASE material WHEN 'steel' THEN 1::DOUBLE WHEN 'aluminum' THEN 0.85 WHEN 'titanium' THEN 2.5 ELSE 3 END AS mf, CASE material WHEN 'steel' THEN 0.08::DOUBLE WHEN 'aluminum' THEN 0.1 WHEN 'titanium' THEN 0.15 ELSE 0.2 END AS wf FROM s),
r AS (SELECT *, mass * kg AS raw, surface_area::DOUBLE * 50 * mf AS mach FROM q)
SELECT p_partkey, floor(mass * 100 + 0.5) / 100 AS mass_kg, floor((raw + mach + raw * wf + (raw + mach) * ((1.2 - 1.0)::DOUBLE * 0.3::DOUBLE + CASE WHEN safety_factor > 1.5 THEN pow((safety_factor - 1.5) / 2, 1.3) * 0.15 ELSE 0 END)) * 100 + 0.5) / 100 AS total_cost FROM r
""")
def cost_breakdown(spark, d):
    return structural.cost(_beams(spark, d)).select("p_partkey", "mass_kg", "total_cost")


@query("""
WITH w AS (SELECT o_orderkey, o_totalprice AS work, CASE WHEN o_orderpriority = '1-URGENT' THEN 30.0 ELSE 1000.0 END AS lim FROM orders),
v AS (SELECT * FROM (VALUES ('cpu_laptop', 60::DOUBLE, 28::DOUBLE, 380::DOUBLE), ('cpu_server', 450, 220, 320), ('gpu_consumer', 8000, 320, 380), ('gpu_datacenter', 24000, 400, 240)) t(device, g, p, c)),
x AS (SELECT o_orderkey, device, work / g <= lim AS feasible, work / g * p / 3.6e6 * c AS grams FROM w, v)
SELECT o_orderkey, device, feasible, row_number() OVER (PARTITION BY o_orderkey ORDER BY feasible DESC, grams, device) AS rank FROM x
""")
def device_rank(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("work"), F.when(F.col("o_orderpriority") == "1-URGENT", 30.0).otherwise(1000.0).alias("limit_s"))
    return decision.rank_devices(own, "work", "limit_s", "o_orderkey").select("o_orderkey", "device", "feasible", "rank")


@query("""
WITH m AS (SELECT p_partkey, p_retailprice::DOUBLE AS yield, (10 + p_size * 2)::DOUBLE AS modulus, (1 + p_partkey % 80 / 10.0)::DOUBLE AS density, (p_retailprice / 50)::DOUBLE AS cost, (1 + p_size % 9)::DOUBLE AS co2, p_retailprice / 3::DOUBLE AS f FROM part),
t AS (SELECT max(cost) AS c, max(co2) AS o, max(density) AS r, max(modulus / greatest(0.01, density)) AS s FROM m),
x AS (SELECT p_partkey, yield >= 1000 AND density <= 6 AS feasible, round(
  0.35 * (0.65 * least(1, yield / 300 / 4) + 0.35 * least(1, modulus / greatest(0.01, density) / s)) + 0.2 * greatest(0, 1 - cost / greatest(1, c)) + 0.15 * greatest(0, 1 - density / greatest(0.5, r))
  + 0.15 * greatest(0, 1 - co2 / greatest(0.5, o)) + 0.15 * least(1, f / 600) + 3.7e-9, 6) AS score FROM m, t)
SELECT p_partkey, feasible, score FROM x
""")
def constraint_recommend(spark, d):
    k = F.col("p_partkey")
    own = table(spark, d, "part").select(
        "p_partkey", F.col("p_retailprice").alias("yield"), (10 + F.col("p_size") * 2).cast("double").alias("modulus"), (1 + k % 80 / 10).alias("density"),
        (F.col("p_retailprice") / 50).alias("cost"), (1 + F.col("p_size") % 9).cast("double").alias("co2"), (F.col("p_retailprice") / 3).alias("fatigue_limit"),
    )
    checks = {"yield": F.col("yield") >= 1000, "density": F.col("density") <= 6}
    return decision.recommend(own, "p_partkey", checks, design_stress=300.0).select("p_partkey", "feasible", F.round(F.col("score") + 3.7e-9, 6).alias("score"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_front(spark, d):
    own = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (-F.col("p_retailprice")).alias("less"))
    return decision.pareto_front(own, ["p_size", "less"]).drop("less")


@query("""
WITH f AS (SELECT p_partkey, p_size::DOUBLE AS a, -p_retailprice AS b FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE y.p_size <= x.p_size AND y.p_retailprice >= x.p_retailprice AND (y.p_size < x.p_size OR y.p_retailprice > x.p_retailprice))),
g AS (SELECT p_partkey, lead(a) OVER (ORDER BY a, p_partkey) - lag(a) OVER (ORDER BY a, p_partkey) AS ga, lead(b) OVER (ORDER BY b, p_partkey) - lag(b) OVER (ORDER BY b, p_partkey) AS gb,
  max(a) OVER () - min(a) OVER () AS sa, max(b) OVER () - min(b) OVER () AS sb FROM f)
SELECT p_partkey, round(CASE WHEN ga IS NULL OR gb IS NULL THEN -1 ELSE (CASE WHEN sa > 0 THEN ga / sa ELSE 0 END) + (CASE WHEN sb > 0 THEN gb / sb ELSE 0 END) END, 9) AS crowding FROM g
""")
def crowding_distance(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (-F.col("p_retailprice")).alias("b"))
    out = decision.crowding(decision.pareto_front(own, ["a", "b"]), "p_partkey", ["a", "b"])
    return out.select("p_partkey", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 9)).alias("crowding"))


@query("SELECT l_returnflag, l_linestatus, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_by_fingerprint(spark, d):
    return relational.first_of(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_returnflag", "l_linestatus", "l_partkey")


@query("SELECT * FROM region UNION ALL SELECT 100 + n_regionkey, min(n_name) FROM nation WHERE 100 + n_regionkey NOT IN (SELECT r_regionkey FROM region) GROUP BY 1")
def insert_if_absent(spark, d):
    region = table(spark, d, "region")
    rows = table(spark, d, "nation").groupBy((100 + F.col("n_regionkey")).alias("r_regionkey")).agg(F.min("n_name").alias("r_name"))
    return relational.insert_absent(region, rows.unionByName(region.withColumn("r_name", F.lit("other"))), ["r_regionkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'H' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def predicate_update(spark, d):
    return relational.update_where(table(spark, d, "orders"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), {"o_orderstatus": F.lit("H")}).select("o_orderkey", "o_orderstatus")


@query("SELECT user_id, greatest(0, least(100, floor(arg_max(value, event_id) + 0.5)))::INTEGER AS progress FROM events GROUP BY 1")
def latest_progress(spark, d):
    events = table(spark, d, "events")
    return relational.append_event(events, events.select("user_id").distinct(), "user_id", "event_id", "value").select("user_id", "progress")


@query("SELECT page_id, count(*) AS n_refs FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS ref FROM pages) GROUP BY 1")
def statements_by_regex(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ref")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_refs"))

"""Alerts, running statistics, rates, gates and forecasts over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.operators import federated, maintenance, recurrent, simulation, telemetry, twin
from strataform.plans.base import registry, table

QUERIES, ORACLE, query = registry()
# A few billionths are added before rounding, so that values half-way between two results round alike in both engines.


def _alert_sql(hit: str, clear: str, n: int, peak: str) -> str:
    return f"""
WITH e AS (SELECT user_id AS key, event_id AS t, value AS v FROM events WHERE value IS NOT NULL AND isfinite(value)),
a AS (SELECT *, {hit} AS hit, NOT ({hit}) AND ({clear}) AS clr FROM e),
b AS (SELECT *, coalesce(sum(clr::INT) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
             sum((NOT hit)::INT) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS miss FROM a),
c AS (SELECT *, hit AND sum(hit::INT) OVER (PARTITION BY key, miss ORDER BY t ROWS UNBOUNDED PRECEDING) >= {n} AS fire FROM b)
SELECT key, min(t) FILTER (fire) AS first_t, max(t) FILTER (fire) AS last_t, {peak} AS peak, count(*) FILTER (fire) AS n, coalesce(max(t) FILTER (clr), -1) AS cleared_at
FROM c GROUP BY key, part HAVING count(*) FILTER (fire) > 0
"""


def _alerts(spark, d, op, threshold, n, margin):
    return telemetry.alerts(table(spark, d, "events"), "user_id", "event_id", "value", op, threshold, n, margin).withColumn("cleared_at", F.coalesce("cleared_at", F.lit(-1)))


@query(_alert_sql("v > 60", "v < 60 * (1 - 0.25)", 2, "max(v) FILTER (fire)"))
def alert_episodes(spark, d):
    return _alerts(spark, d, ">", 60.0, 2, 0.25)


@query(_alert_sql("v >= 80", "v < 80 * (1 - 0.1)", 1, "max(v) FILTER (fire)"))
def alert_episodes_at_least(spark, d):
    return _alerts(spark, d, ">=", 80.0, 1, 0.1)


@query(_alert_sql("v < 20", "v > 20 * (1 + 0.5)", 2, "min(v) FILTER (fire)"))
def alert_episodes_below(spark, d):
    return _alerts(spark, d, "<", 20.0, 2, 0.5)


@query(_alert_sql("v <= 5", "v > 5 * (1 + 0.2)", 1, "min(v) FILTER (fire)"))
def alert_episodes_at_most(spark, d):
    return _alerts(spark, d, "<=", 5.0, 1, 0.2)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 16")
def ring_last_n(spark, d):
    return telemetry.last_n(table(spark, d, "events"), "user_id", ["ts", "event_id"], 16).select("user_id", "event_id", "value")


@query("""
SELECT event_id, count(*) OVER w AS n_recent, round(avg(value) OVER w + 3.7e-9, 6) AS mean_recent FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 6000 PRECEDING AND CURRENT ROW)
""")
def time_range_window(spark, d):
    e = table(spark, d, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    return telemetry.recent_count(e, "event_type", F.col("s"), 6000).select("event_id", "n_recent", F.round(F.col("mean_recent") + 3.7e-9, 6).alias("mean_recent"))


@query("""
WITH w AS (SELECT event_id, value, count(value) OVER o AS n, avg(value) OVER o AS m, coalesce(var_samp(value) OVER o, 1) AS v FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, n AS run_n, round(m + 3.7e-9, 6) AS run_mean, round(v + 3.7e-8, 5) AS run_var, round(CASE WHEN n < 2 THEN 0 ELSE abs(value - m) / sqrt(greatest(v, 1e-9)) END + 3.7e-9, 6) AS sigma FROM w
""")
def welford_moments(spark, d):
    out = telemetry.moments(table(spark, d, "events"), "user_id", ["event_id"], "value")
    return out.select("event_id", "run_n", F.round(F.col("run_mean") + 3.7e-9, 6).alias("run_mean"), F.round(F.col("run_var") + 3.7e-8, 5).alias("run_var"), F.round(F.col("sigma") + 3.7e-9, 6).alias("sigma"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS wall, CASE WHEN sum(value) > 0 THEN round(count(*) / sum(value), 9) ELSE 0 END AS per_unit,
       CASE WHEN count(*) > 0 THEN count(DISTINCT user_id)::DOUBLE / count(*) ELSE 1 END AS unique_ratio FROM events GROUP BY 1
""")
def rates_per_strategy(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.count_distinct("user_id").alias("u"))
    return e.select("event_type", "n", F.round("s", 4).alias("wall"), F.when(F.col("s") > 0, F.round(F.col("n") / F.col("s"), 9)).otherwise(0.0).alias("per_unit"), F.when(F.col("n") > 0, F.col("u") / F.col("n")).otherwise(1.0).alias("unique_ratio"))


@query("""
WITH s AS (SELECT user_id, event_type, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
r AS (SELECT user_id, event_type, 'n' AS metric, n AS x FROM s UNION ALL SELECT user_id, event_type, 'mean', mean FROM s),
p AS (SELECT a.user_id, a.metric, a.x AS a, b.x AS b FROM r a JOIN r b ON a.user_id = b.user_id AND a.metric = b.metric AND a.event_type = 'view' AND b.event_type = 'click')
SELECT user_id, metric, CASE WHEN abs(b - a) <= 0.01 * greatest(abs(a), abs(b)) THEN 'tie' WHEN (b > a) = (metric = 'n') THEN 'b' ELSE 'a' END AS winner FROM p
""")
def ab_compare_unpivot(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return telemetry.compare(s.filter("event_type = 'view'"), s.filter("event_type = 'click'"), "user_id", {"n": True, "mean": False}).select("user_id", "metric", "winner")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS p FROM r WHERE i = floor(0.95 * (n - 1))
""")
def floor_percentiles(spark, d):
    return telemetry.floor_percentile(table(spark, d, "events"), "event_type", "value", 0.95)


@query("""
WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_totalprice AS p FROM r WHERE i = least(floor(0.95 * n), n - 1)
""")
def index_percentiles(spark, d):
    return telemetry.floor_percentile(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 0.95, "index")


@query("""
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS tn, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels)
SELECT *, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, ((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END)) / 2 AS balanced_accuracy FROM c
""")
def gate_confusion(spark, d):
    return telemetry.confusion(table(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY event_id), 9) AS drift FROM events")
def energy_drift_from_first(spark, d):
    return twin.drift_from_first(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", F.round("drift", 9).alias("drift"))


@query("""
WITH r AS (SELECT user_id, value, (value - lag(value, 3) OVER (PARTITION BY user_id ORDER BY event_id)) / 3 AS slope, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, step::INTEGER AS step, round(value + coalesce(slope, 0) * step, 6) AS forecast FROM r, range(1, 6) t(step) WHERE n = 1
""")
def linear_forecast(spark, d):
    return telemetry.forecast(table(spark, d, "events"), "user_id", ["event_id"], "value", 5).select("user_id", "step", F.round("forecast", 6).alias("forecast"))


@query("""
SELECT event_id AS ask_id, (SELECT max_by(b.value, b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id <= a.event_id) AS found
FROM events a WHERE event_type = 'error'
""")
def latest_checkpoint(spark, d):
    e = table(spark, d, "events")
    asked = e.filter("event_type = 'error'").select("user_id", "event_id", F.col("event_id").alias("ask_id"))
    return telemetry.latest_before(e.filter("event_type = 'purchase'"), asked, "user_id", "event_id", "value").select("ask_id", "found")


@query("""
WITH m AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2), g AS (SELECT u.user_id, t.e, coalesce(m, 0) AS m FROM (SELECT DISTINCT user_id FROM m) u, (VALUES ('view'), ('click'), ('purchase')) t(e) LEFT JOIN m ON m.user_id = u.user_id AND m.event_type = t.e),
o AS (SELECT *, pow((m - 50) / 50, 2) AS q FROM g)
SELECT user_id, round(sqrt(avg(q)), 8) AS distance, CASE WHEN max(sqrt(q)) > 0.15 THEN min_by(e, (-q, CASE e WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END)) END AS worst FROM o GROUP BY 1
""")
def twin_station_distance(spark, d):
    optimal = {e: {"mean": 50.0} for e in ("view", "click", "purchase")}
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    frames = m.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(F.lit("mean"), "m")))).alias("stations"))
    return frames.select("user_id", F.round(twin.distance(F.col("stations"), optimal), 8).alias("distance"), twin.station_loads(F.col("stations"), optimal)[1].alias("worst"))


@query("""
SELECT event_id, least(1, min(abs(value - v)) / 10) AS novelty FROM (SELECT event_id, value, unnest(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)) AS v FROM events) GROUP BY 1
""")
def novelty_min_distance(spark, d):
    return twin.novelty(table(spark, d, "events"), "user_id", "event_id", "value", radius=5.0).filter("novelty IS NOT NULL").select("event_id", "novelty")


@query(None)
def twin_states(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.array("value", F.col("event_id") % 7 / 7.0, F.col("value") * F.col("value") / 100).alias("raw"), (F.abs(F.col("value") - 50) / 50).alias("far"))
    return twin.twin_states(e, "user_id", "event_id", "raw", "far")


_SERIES = "e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL)"


def _series(spark, d):
    return table(spark, d, "events").filter("value IS NOT NULL").select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), "value")


@query(f"""
WITH RECURSIVE {_SERIES}, r AS (
  SELECT user_id, -1::BIGINT AS event_id, 0::BIGINT AS n, 0::DOUBLE AS level, 0::DOUBLE AS speed, 0::DOUBLE AS mae, 0::DOUBLE AS rmse FROM e WHERE n = 1 UNION ALL
  SELECT user_id, event_id, n, now, (now - level) / 0.05::DOUBLE, mae + (abs(now - value) - mae) / n, sqrt(rmse * rmse + ((now - value) * (now - value) - rmse * rmse) / n) FROM (
    SELECT *, ahead + 0.35::DOUBLE * (value - ahead) AS now FROM (SELECT e.user_id, e.event_id, e.n, e.value, r.level, r.mae, r.rmse, r.level + r.speed * 0.05::DOUBLE AS ahead FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT event_id, round(level + 3.7e-9, 6) AS fused, round(speed + 3.7e-7, 4) AS speed, round(mae + 3.7e-9, 6) AS mae, round(rmse + 3.7e-9, 6) AS rmse FROM r WHERE n > 0
""")
def alpha_beta_filter(spark, d):
    out = recurrent.alpha_beta(_series(spark, d), "user_id", "event_id", "value")
    return out.select("event_id", *(F.round(F.col(c) + e, n).alias(c) for c, e, n in (("fused", 3.7e-9, 6), ("speed", 3.7e-7, 4), ("mae", 3.7e-9, 6), ("rmse", 3.7e-9, 6))))


@query(f"""
WITH RECURSIVE {_SERIES}, r AS (
  SELECT user_id, event_id, n, abs(value) AS m, greatest(1e-6, abs(value) * 0.5) AS v FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.n, r.m + 0.05::DOUBLE * (abs(e.value) - r.m), 0.95::DOUBLE * (r.v + 0.05::DOUBLE * (abs(e.value) - r.m) * (abs(e.value) - r.m)) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, round(m + 3.7e-9, 6) AS ewma, round(m + 3 * sqrt(v) + 3.7e-9, 6) AS threshold FROM r
""")
def ewma_threshold(spark, d):
    out = recurrent.adaptive_threshold(_series(spark, d), "user_id", "event_id", "value")
    return out.select("event_id", *(F.round(F.col(c) + 3.7e-9, 6).alias(c) for c in ("ewma", "threshold")))


@query(None)
def guard_events(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").cast("double").alias("t"), "value", F.array(F.col("value") / 2, F.col("value") * 0.3, F.col("value") * 0.2).alias("parts"))
    return recurrent.guard(e, "user_id", "t", "value", "parts")


@query("""
WITH e AS (SELECT user_id AS key, event_id AS t, value AS v, value > 60 AS hit FROM events WHERE value IS NOT NULL AND isfinite(value)),
b AS (SELECT *, NOT hit AND v < 45 AS clr, sum((NOT hit)::INT) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS miss FROM e),
c AS (SELECT *, coalesce(sum(clr::INT) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, hit AND sum(hit::INT) OVER (PARTITION BY key, miss ORDER BY t ROWS UNBOUNDED PRECEDING) >= 2 AS fire FROM b),
a AS (SELECT key, min(t) FILTER (fire) AS first_t, max(v) FILTER (fire) AS peak, count(*) FILTER (fire) AS n, max(t) FILTER (clr) AS cleared FROM c GROUP BY key, part HAVING count(*) FILTER (fire) > 0)
SELECT key, first_t::DOUBLE AS t, 'fired' AS event, 1::BIGINT AS n FROM a UNION ALL SELECT key, cleared::DOUBLE, 'cleared', n FROM a WHERE cleared IS NOT NULL
""")
def alert_log(spark, d):
    rules = [{"id": "high", "metric": "value", "op": ">", "threshold": 60.0, "consecutive": 2, "margin": 0.25}, {"id": "off", "metric": "value", "op": "<", "threshold": 90.0, "enabled": False}]
    out = recurrent.alert_log(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("t"), "value"), "key", "t", rules)
    return out.select("key", "t", "event", "n")


_FED = {"rounds": 2, "epochs": 3, "rate": 0.05, "clip": 0.02}


def _federated_sql() -> str:
    parts = ["s AS (SELECT event_type AS c, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM (SELECT event_type, value / 100 AS x, (value > 50)::INT::DOUBLE AS y FROM events WHERE value IS NOT NULL) GROUP BY 1)", "g0 AS (SELECT 0::DOUBLE AS w, 0::DOUBLE AS b)"]
    for r in range(1, _FED["rounds"] + 1):
        parts.append(f"l{r}_0 AS (SELECT s.*, w, b, w AS w0, b AS b0 FROM s, g{r - 1})")
        for e in range(1, _FED["epochs"] + 1):
            parts.append(f"l{r}_{e} AS (SELECT * REPLACE (w - 0.05::DOUBLE * (sxx * w + sx * b - sxy) / n AS w, b - 0.05::DOUBLE * (sx * w + n * b - sy) / n AS b) FROM l{r}_{e - 1})")
        parts.append(f"d{r} AS (SELECT (w - w0) AS dw, (b - b0) AS db, least(1, 0.02::DOUBLE / greatest(1e-9, sqrt((w - w0) * (w - w0) + (b - b0) * (b - b0)))) AS k, w0, b0 FROM l{r}_{_FED['epochs']})")
        parts.append(f"g{r} AS (SELECT any_value(w0) + avg(dw * k) AS w, any_value(b0) + avg(db * k) AS b FROM d{r})")
    rows = " UNION ALL ".join(f"SELECT {r}::INTEGER AS round, round((sum(syy) - 2 * (any_value(w) * sum(sxy) + any_value(b) * sum(sy)) + any_value(w) * any_value(w) * sum(sxx) + 2 * any_value(w) * any_value(b) * sum(sx) + any_value(b) * any_value(b) * sum(n)) / sum(n), 9) AS loss, round(any_value(w), 9) AS w, round(any_value(b), 9) AS b FROM s, g{r}" for r in range(1, _FED["rounds"] + 1))
    return f"WITH {', '.join(parts)} {rows}"


@query(_federated_sql())
def federated_round(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("x"), (F.col("value") > 50).cast("double").alias("y"))
    out = federated.federated(e, "event_type", ["x"], "y", **_FED)
    return out.select("round", F.round("loss", 9).alias("loss"), F.round(F.col("weights")[0], 9).alias("w"), F.round(F.col("weights")[1], 9).alias("b"))


@query(f"""
WITH RECURSIVE {_SERIES}, g AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE abs(value - avg(value) OVER o) / sqrt(greatest(1e-9, var_samp(value) OVER o)) END AS s FROM e WINDOW o AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
r AS (
  SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, 0::DOUBLE AS m, 0::DOUBLE AS v, 0::DOUBLE AS risk, 0::DOUBLE AS rate, 0::DOUBLE AS sigma FROM g WHERE n = 1 UNION ALL
  SELECT user_id, event_id, n, m, v, risk, 0.7::DOUBLE * rate + 0.3::DOUBLE * (risk - last) / greatest(1e-3, event_id - CASE WHEN last_t = 0 THEN event_id ELSE last_t END), s FROM (
    SELECT *, least(1, (CASE WHEN n < 24 THEN 0.3::DOUBLE ELSE 1 END) * 0.45::DOUBLE * least(1, s / greatest(1e-3, m + 3 * sqrt(v)))) AS risk FROM (
      SELECT g.user_id, g.event_id, g.n, g.s, r.risk AS last, r.rate, r.event_id AS last_t, CASE WHEN r.n = 0 THEN g.s ELSE r.m + 0.05::DOUBLE * (g.s - r.m) END AS m,
        CASE WHEN r.n = 0 THEN greatest(1e-6, g.s * 0.5) ELSE 0.95::DOUBLE * (r.v + 0.05::DOUBLE * (g.s - r.m) * (g.s - r.m)) END AS v FROM r JOIN g ON g.user_id = r.user_id AND g.n = r.n + 1)))
SELECT event_id, round(sigma + 3.7e-9, 6) AS sigma, round(risk + 3.7e-9, 6) AS risk, CASE WHEN risk >= 0.85 THEN 'urgent' WHEN risk >= 0.6 THEN 'schedule' WHEN risk >= 0.35 THEN 'watch' ELSE 'ok' END AS priority FROM r WHERE n > 0
""")
def maintenance_risk(spark, d):
    e = _series(spark, d).select("user_id", "event_id", F.array("value").alias("vector"))
    return maintenance.risk_series(e, "user_id", "event_id", "vector").select("event_id", *(F.round(F.col(c) + 3.7e-9, 6).alias(c) for c in ("sigma", "risk")), "priority")


@query("""
WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS n, first_value(value) OVER w AS f, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, coalesce(b, CASE WHEN n = 1 THEN f ELSE a END) AS x0, coalesce(a, f) AS x1, value AS x2 FROM r
""")
def temporal_stacking(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.array("value").alias("vector"))
    return maintenance.stacked(e, "user_id", "event_id", "vector", 3).select("event_id", *(F.col("stack")[i].alias(f"x{i}") for i in range(3)))


@query("""
WITH f AS (SELECT o_orderkey, 100 + o_orderkey % 1000 AS n, 1 + o_custkey % 3 AS s, 5.0::DOUBLE + o_orderkey % 20 AS r FROM orders)
SELECT o_orderkey, round((n * 22 + n * least(n - 1, greatest(1, (n - 1) * pi() * r * r / 921600)) * 30 + n * 36 + n * 72) * s, 4) AS flops FROM f
""")
def step_cost(spark, d):
    k = F.col("o_orderkey")
    own = table(spark, d, "orders").select("o_orderkey", (100 + k % 1000).alias("particles"), (1 + F.col("o_custkey") % 3).alias("substeps"), F.lit("verlet").alias("integrator"), (5.0 + k % 20).alias("radius"), F.lit(True).alias("grid"), F.lit(2).alias("edges_per_node"), F.lit(3).alias("constraint_iters"), F.lit(0).alias("ensemble"), F.lit(0).alias("field_ops"))
    return simulation.step_flops(own).select("o_orderkey", F.round("flops", 4).alias("flops"))

"""Operators that no catalogue query shows: files, expressions, meshes, paths, recurrences and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.functions import scalars
from strataform.functions.expressions import ExpressionError, compile_field
from strataform.operators import calibration, decision, features, graph, maintenance, mesh, recurrent, relational, similarity, simulation, spatial, stats, structural, telemetry
from strataform.sources import readers, writers
from strataform.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "value"), [("1 + 2 * 3", 7), ("-2^2", 4), ("2^3^2", 512), ("min(3, 1, 2) + max(4, 9)", 10), ("hypot(3, 4)", 5), ("1_000 / 8", 125), ("round(-2.5)", -2), ("sin(pi) + log(e)", 1), ("1e3 - .5", 999.5)])
def test_expressions(spark, text, value):
    assert math.isclose(one(spark, compile_field(text)), value, abs_tol=1e-9)


@pytest.mark.parametrize("text", ["", "1 +", "foo(1)", "zz", "(1", "1 2", "2 $ 3", "1" * 2000])
def test_expression_errors(text):
    with pytest.raises(ExpressionError):
        compile_field(text)


def test_scalars(spark):
    assert one(spark, scalars.fnv1a32(F.lit("a"))) == 0xE40C292C
    assert one(spark, scalars.round_up_half(F.lit(-2.5))) == -2
    assert one(spark, scalars.hash31(F.lit("hello world, this is long"))) == _java("hello world, this is long")
    assert one(spark, scalars.morton30(F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, scalars.clamp(F.lit(float("nan")))) == 0


def _java(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name, x ,y\n"p, q", 1e3,ok\nr, ,2\n')
    df = readers.typed(readers.read_table(spark, str(tmp_path / "a.csv")))
    assert [tuple(r) for r in df.collect()] == [("p, q", 1000.0, "ok"), ("r", None, "2")]
    (tmp_path / "b.csv").write_text("a\tb\n1\tx\n")
    assert readers.read_table(spark, str(tmp_path / "b.csv")).columns == ["a", "b"]
    (tmp_path / "c.json").write_text('{"rows": [{"predicted": 1, "ok": true, "v": [1, 2]}, {"predicted": "x"}]}')
    assert readers.typed(readers.read_table(spark, str(tmp_path / "c.json"))).count() == 2
    (tmp_path / "d.jsonl").write_text('{"p": "1", "m": "2.5", "part": ""}\n{"p": "inf", "m": "1", "part": "q"}\n')
    good, bad = readers.observations(readers.read_table(spark, str(tmp_path / "d.jsonl")), "p", "m", "part")
    assert [(r["predicted"], r["measured"]) for r in good.collect()] == [(1.0, 2.5)] and bad.count() == 1


def test_telemetry_aliases_and_quarantine(spark):
    df = spark.createDataFrame([("5", "0.1", "x"), (None, "nan", "y" * 80), (None, "7", "z")], "Time string, Risk string, sensor string").withColumn("n", F.monotonically_increasing_id())
    got = readers.telemetry(df, "n")
    rows = sorted((r["t"], r["divergence_risk"], len(r["source"])) for r in got.collect())
    assert [r[0] for r in rows] == [0.0, 1.0, 5.0] and max(r[2] for r in rows) == 64
    ok, off = live.split_valid(got)
    assert (ok.count(), off.count()) == (2, 1)
    assert readers.guess_columns(["Measured Load", "pred"], {"measured": ["meas"], "predicted": ["pred"], "none": ["q"]}) == {"measured": "Measured Load", "predicted": "pred", "none": None}


def test_entities(spark):
    text = "HEADER;ENDSEC;DATA;\n#1=POINT('a;#9',(0.,1.));/* #7=X(); */#2=EDGE(#1,#3);\n#2=EDGE(#1,#1);#4=(A()B());ENDSEC;"
    own = readers.entities(spark.createDataFrame([(1, text)], "file_id int, text string"))
    assert sorted((r["id"], r["type"], r["duplicate"]) for r in own.collect()) == [(1, "POINT", False), (2, "EDGE", False), (2, "EDGE", True)]
    refs = readers.references(own)
    assert sorted((r["from_id"], r["to_id"]) for r in refs.collect()) == [(2, 1), (2, 3)]
    assert [r["to_id"] for r in readers.orphans(own, refs).collect()] == [3]
    assert [r["id"] for r in readers.roots(own, refs).collect()] == [2]


#: Five beams with their known stress (Pa), safety factor, deflection (mm) and span ratio.
BEAMS = [
    (0.035, 2.4, "steel", 5.89e-3, 4.54e-5, 6.0, 5e4, 10591596.75, 23.604, 24.78, 242.0),
    (0.005, 1.01, "aluminum", 5e-3, 4.17e-8, 1.0, 1e4, 2491307.2, 110.785, 72.51, 14.0),
    (0.011, 1.41, "titanium", 3.57e-3, 1.17e-5, 3.0, 2e5, 69784515.44, 12.61, 84.49, 36.0),
    (0.035, 2.4, "steel", 5.89e-3, 4.54e-5, 6.0, 5e5, 105915967.5, 2.36, 247.8, 24.0),
    (0.0094, 1.88, "carbon-fiber", 2.26e-3, 3.06e-6, 5.0, 1e5, 55117415.95, 10.886, 567.36, 9.0),
]


def test_beams(spark):
    df = spark.createDataFrame([(i, *b[:7]) for i, b in enumerate(BEAMS)], "id int, volume double, surface_area double, material string, csa double, moi double, length double, force double")
    for r in structural.safety_buffer(structural.beam(df)).collect():
        want = BEAMS[r["id"]][7:]
        assert all(math.isclose(r[c], v, rel_tol=1e-6) for c, v in zip(("von_mises", "safety_factor", "deflection_mm", "span_ratio"), want)), (r, want)
    assert structural.compliance(structural.beam(df), "id").count() == 45


def cube(spark):
    """A cube of 2 x 2 x 2 cells, each of six tets around its diagonal."""
    at = lambda i, j, k: i * 9 + j * 3 + k
    verts = [(at(i, j, k), i / 2, j / 2, k / 2) for i in range(3) for j in range(3) for k in range(3)]
    tets, n = [], 0
    paths = [((1, 0, 0), (1, 1, 0)), ((1, 0, 0), (1, 0, 1)), ((0, 1, 0), (1, 1, 0)), ((0, 1, 0), (0, 1, 1)), ((0, 0, 1), (1, 0, 1)), ((0, 0, 1), (0, 1, 1))]
    xyz = {v: np.array(p) for v, *p in verts}
    for i in range(2):
        for j in range(2):
            for k in range(2):
                for p, q in paths:
                    v = [at(i, j, k), at(i + p[0], j + p[1], k + p[2]), at(i + q[0], j + q[1], k + q[2]), at(i + 1, j + 1, k + 1)]
                    a, b, c, d = (xyz[x] for x in v)
                    if np.dot(b - a, np.cross(c - a, d - a)) < 0:
                        v[1], v[2] = v[2], v[1]
                    tets.append((n, *v, 1.0))
                    n += 1
    return spark.createDataFrame(tets, "tet_id int, v0 int, v1 int, v2 int, v3 int, kappa double"), spark.createDataFrame(verts, "vid int, x double, y double, z double"), xyz


def test_mesh(spark):
    tets, verts, xyz = cube(spark)
    q = mesh.quality(tets, verts).first()
    assert q["n_tets"] == 48 and math.isclose(q["volume"], 1) and q["inverted"] == 0 and q["non_manifold"] == 0
    assert mesh.neighbours(tets).count() == (48 * 4 - 48) // 2
    rows = mesh.stiffness(tets, verts).collect()
    a = np.zeros((27, 27))
    for r in rows:
        a[r["row"], r["col"]] = r["value"]
    assert np.allclose(a, a.T) and np.allclose(a.sum(axis=1), 0)
    x = np.array([xyz[v][0] for v in range(27)])
    assert math.isclose(x @ a @ x, 1.0)  # the energy of a unit slope over a unit cube


def test_paths_and_shrink(spark):
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 2), (3, 4, 3), (4, 5, 4), (7, 8, 5)], "a long, b long, position int")
    assert graph.shortest_path(edges, 1, 5) == [1, 2, 4, 5]
    assert graph.shortest_path(edges, 1, 8) == [] and graph.shortest_path(edges, 3, 3) == [3]
    ranks = spark.createDataFrame([(i,) for i in range(5)], "rank int")
    assert [r["new_rank"] for r in graph.shrink(ranks, ranks.filter("rank in (1, 3)")).orderBy("rank").collect()] == [0, -1, 1, -1, 2]
    owners = spark.range(10).select(graph.block_owner(F.col("id"), F.lit(10), 3).alias("o")).collect()
    assert [r["o"] for r in owners] == [0] * 4 + [1] * 3 + [2] * 3
    assert [r["o"] for r in spark.range(2).select(graph.block_owner(F.col("id"), F.lit(2), 5).alias("o")).collect()] == [0, 1]


def test_pairs(spark):
    df = spark.createDataFrame([(9, 8), (0, 1), (4, 2), (7, 3)], "i int, j int")
    s = spatial.pair_stats(df, "i", "j", 10, 2).first()
    assert (s["n_pairs"], s["dropped"], s["saturated"], s["duplicates"], s["invalid"]) == (2, 2, True, 0, 0)
    df = spark.createDataFrame([(1, 1), (-1, 0), (0, 99), (0, 1), (99, 99)], "i int, j int")
    assert spatial.pair_stats(df, "i", "j", 4, 16).first()["invalid"] == 4


def alerts_by_hand(rows, op, th, n, margin):
    hit = telemetry.OPERATIONS[op]
    out, run, open_ = [], 0, None
    for t, v in rows:
        if v is None or not math.isfinite(v):
            continue
        if hit(v, th):
            run += 1
            if run >= n:
                if open_ is None:
                    open_ = [t, t, v, 0, None]
                    out.append(open_)
                open_[1], open_[3] = t, open_[3] + 1
                open_[2] = max(open_[2], v) if op[0] == ">" else min(open_[2], v) if op[0] == "<" else open_[2]
        else:
            run = 0
            if open_ is not None and recurrent.clears(v, op, th, margin):
                open_[4], open_ = t, None
    return out


@pytest.mark.parametrize("op", list(telemetry.OPERATIONS))
def test_alerts_equal_the_sequence(spark, op):
    rng = random.Random(op)
    series = {k: [(float(t), rng.choice([None, float("nan"), float("inf"), *[float(rng.randrange(12))] * 6])) for t in range(150)] for k in range(8)}
    df = spark.createDataFrame([(k, t, v) for k, s in series.items() for t, v in s], "key int, t double, value double")
    for n, margin in ((1, 0.1), (3, 0.3)):
        got = sorted((r["key"], r["first_t"], r["last_t"], r["peak"], r["n"], r["cleared_at"]) for r in telemetry.alerts(df, "key", "t", "value", op, 6.0, n, margin).collect())
        assert got == sorted((k, *a) for k, s in series.items() for a in alerts_by_hand(s, op, 6.0, n, margin))


def test_live_alerts_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, float(t), float(rng.randrange(12))) for t in range(90) for k in range(3)]
    for i in range(3):
        spark.createDataFrame(rows[i * 90 : (i + 1) * 90], "key int, t double, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int, t double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rules = [{"id": "high", "metric": "value", "op": ">", "threshold": 6.0, "consecutive": 2, "margin": 0.2}]
    q = live.live_alerts(stream, "key", "t", rules).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("live").collect()
    df = spark.createDataFrame(rows, "key int, t double, value double")
    batch = telemetry.alerts(df, "key", "t", "value", ">", 6.0, 2, 0.2).collect()
    assert sorted((r["key"], r["t"]) for r in got if r["event"] == "fired") == sorted((r["key"], r["first_t"]) for r in batch)
    closed = sorted((r["key"], r["first_t"], r["peak"], r["n"], r["t"]) for r in got if r["event"] == "cleared")
    assert closed == sorted((r["key"], r["first_t"], r["peak"], r["n"], r["cleared_at"]) for r in batch if r["cleared_at"] is not None)
    assert sorted(map(str, got)) == sorted(map(str, recurrent.alert_log(df, "key", "t", rules).collect()))


def test_recurrences(spark):
    df = spark.createDataFrame([("a", float(t), 2.0 * t + 1) for t in range(60)], "k string, t double, v double")
    rows = recurrent.alpha_beta(df, "k", "t", "v", tick=1.0).orderBy("t").collect()
    assert (rows[0]["predict"], rows[0]["residual"], rows[0]["fused"]) == (0.0, 1.0, 0.35) and rows[0]["speed"] == 0.35
    assert abs(rows[-1]["speed"] - 2) < 0.05 and abs(rows[-1]["residual"]) < 0.1
    rows = recurrent.adaptive_threshold(df.withColumn("v", -F.col("v")), "k", "t", "v").orderBy("t").collect()
    assert len(rows) == 60 and rows[0]["ewma"] == 1.0 and rows[0]["variance"] == 0.5 and math.isclose(rows[1]["ewma"], 1.1)


def test_compensated_sum(spark):
    for values in ([1e16, 1.0, -1e16, 1.0], [1.0, 1e16, 1.0, -1e16]):
        df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double").repartition(3)
        assert stats.exact_sum(df, "k", "v").first()["total"] == 2.0


def test_clusters_and_components_of_variance(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (3, 3))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    centres, out = stats.kmeans(df, ["a", "b"], [[0.5, 0.5], [2, 2], [99, 99]])
    assert np.allclose(centres[0], x[:50].mean(0)) and np.allclose(centres[1], x[50:].mean(0)) and centres[2] == [99, 99]
    assert out.groupBy("cluster").count().count() == 2
    *_, shares = stats.pca(df, ["a", "b"], 1)
    assert shares[0] > 0.95


def test_rows_and_flags(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert relational.single(df.filter("id = 1"))["v"] == "a" and relational.single(df.filter("id = 9"), optional=True) is None
    for bad in (df, df.filter("id = 9")):
        with pytest.raises(ValueError):
            relational.single(bad)
    r = decision.feasible_first(spark.createDataFrame([(1, True, 0.2), (2, False, 0.9), (3, True, 0.5)], "id int, f boolean, s double"), "f", "s", "id")
    assert [x["id"] for x in r.orderBy("rank").collect()] == [3, 1, 2]


def test_maintenance(spark):
    rows = [(a, float(t), [50.0 + (0 if a == "calm" or t < 60 else (t - 60) * 2.0) + (t % 3) * 0.1, 1.0]) for a in ("calm", "loud") for t in range(100)]
    df = spark.createDataFrame(rows, "asset string, t double, v array<double>")
    out = maintenance.risk_series(df, "asset", "t", "v", failures={"loud": [[130.0, 1.0]] * 8}, optimal={"loud": [[50.0, 1.0]], "calm": [[50.0, 1.0]]})
    risk = {(r["asset"], r["t"]): r["risk"] for r in out.collect()}
    assert risk["loud", 99.0] > risk["loud", 50.0] and len(risk) == 200
    assert [r["asset"] for r in maintenance.queue(out, "asset", "t").collect()] == ["loud", "calm"]
    packed = maintenance.pack(spark.createDataFrame([("a", 1.0, {"x": 2.0}), ("a", 2.0, {"x": float("nan"), "y": 3.0})], "asset string, t double, r map<string,double>"), "asset", "t", "r", ["x", "y"])
    assert [r["vector"] for r in packed.orderBy("t").collect()] == [[2.0, 0.0], [2.0, 3.0]]
    assert [r["stack"] for r in maintenance.stacked(packed, "asset", "t", "vector", 2).orderBy("t").collect()] == [[2.0, 0.0, 2.0, 0.0], [2.0, 0.0, 2.0, 3.0]]


def test_routes_and_costs(spark):
    kinds = "id int, domain string, regime string, latent array<double>"
    solved = spark.createDataFrame([(1, "heat", "s", [0.0, 0.0]), (2, "flow", "s", [9.0, 9.0])], kinds)
    asked = spark.createDataFrame([(10, "heat", "s", [0.1, 0.0], True, 0.1, 0.9), (11, "heat", "s", [0.9, 0.0], True, 0.1, 0.9), (12, "heat", "s", [5.0, 0.0], True, 0.1, 0.9), (13, "heat", "s", [0.1, 0.0], True, 0.1, 0.1), (14, "none", "s", [0.0, 0.0], True, 0.1, 0.9)], kinds + ", spd boolean, nonlinearity double, mesh_score double")
    assert {r["id"]: r["stage"] for r in simulation.route(asked, solved).collect()} == {10: "cache", 11: "rom", 12: "full", 13: "full", 14: "full"}
    f = simulation.step_flops(spark.createDataFrame([(100, 2, "euler", 10.0, False, 2, 3, 0, 0)], "particles int, substeps int, integrator string, radius double, grid boolean, edges_per_node int, constraint_iters int, ensemble int, field_ops int")).first()["flops"]
    assert f == 2 * (1200 + 100 * 99 * 15 + 100 * 2 * 18 + 100 * 2 * 3 * 12)
    assert simulation.gate(spark.range(30).select(F.col("id").alias("seq"), F.lit(0.01).alias("error"), F.lit(10.0).alias("full_ms"), F.lit(5.0).alias("routed_ms"))).first()["ready"]


def test_calibration(spark):
    t = np.linspace(0, 4, 120)
    y = calibration.oscillator(np.array([40.0, 0.4, 1.0, 1.5]), t)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y)] + [("b", 0.0, 1.0)], "s string, t double, y double")
    got = {r["s"]: r for r in calibration.calibrate(df, "s").collect()}
    assert got["a"]["r2"] > 0.99 and got["b"]["rss"] is None


def test_files_of_meshes_and_reports(spark, tmp_path):
    tets, verts, _ = cube(spark)
    writers.write_lines(writers.obj_lines(tets, verts), str(tmp_path / "m"))
    lines = [x for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 27 + 192 and lines[0] == "v 0.0 0.0 0.0" and lines[27].startswith("f ")
    assert [r["body"] for r in writers.report({"n": spark.range(2)}).collect()] == ['[{"id":0},{"id":1}]']


def test_failure_rank(spark):
    cos = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (0, 3, 0.5)], "query_id int, row_id int, score double")
    out = spark.createDataFrame([(1, 0, 2.0), (2, 1, 0.5), (3, 0, None)], "row_id int, passed int, defect_rate double")
    edges = spark.createDataFrame([(1, 8, 1), (1, 7, 0)], "to_id int, from_id int, position int")
    sims = spark.createDataFrame([(7, 100.0), (8, 900.0)], "from_id int, stress double")
    got = [(r["row_id"], round(r["score"], 6)) for r in similarity.failure_rank(cos, out, edges, sims, 200.0, 5).orderBy("rank").collect()]
    assert got == [(1, 0.6), (3, 0.25)]


def test_fronts_peeled_off(spark):
    rng = random.Random(3)
    pts = [(i, float(rng.randrange(8)), float(rng.randrange(8))) for i in range(60)]
    left, want, n = {i: p for i, *p in pts}, {}, 0
    while left:
        front = [i for i, p in left.items() if not any(q[0] <= p[0] and q[1] <= p[1] and q != p for q in left.values())]
        want |= dict.fromkeys(front, n)
        left = {i: p for i, p in left.items() if i not in want}
        n += 1
    got = decision.front_ranks(spark.createDataFrame(pts, "id int, a double, b double"), "id", ["a", "b"])
    assert {r["id"]: r["front"] for r in got.collect()} == want
    assert {r["front"] for r in decision.front_ranks(spark.createDataFrame(pts, "id int, a double, b double"), "id", ["a", "b"], 1).collect()} == {0, -1}


def test_features(spark):
    df = spark.createDataFrame([({"s1": {"a": 1.0}}, {"t": 5.0})], "stations map<string,map<string,double>>, ambient map<string,double>")
    v = df.select(features.packed_frame(F.col("stations"), ["s1", "s2"], ["a", "b"], F.col("ambient"), ["t", "u"]).alias("v")).first()["v"]
    assert v == [1.0, 0.0, 0.0, 0.0, 5.0, 0.0]
    lit = [F.lit(x) for x in (0.5, 2.0, 3.0, 100.0, 0.2, 10.0, 100.0)]
    assert one(spark, features.fab_problems(*lit)) == ["wall", "aspect", "hole-width"]
    b = features.mirror_balance(spark.createDataFrame([(0.0, 0.0), (1.0, 0.1), (0.9, 1.0)], "x double, y double"), ["x", "y"], F.lit(1.0))
    assert {r["axis"]: r["balance"] for r in b.collect()} == {"x": 0.5, "y": 0.5}
    p = features.refinement_plan(spark.createDataFrame([(i, i / 10) for i in range(11)], "id int, error double"), "id", 0.7, 0.1, 2)
    assert sorted(tuple(r) for r in p.collect()) == [(0, "merge"), (1, "merge"), (9, "split"), (10, "split")]
    assert math.isclose(one(spark, features.smooth_union([F.lit(0.1), F.lit(0.1)], 0.2)), 0.05)
    assert one(spark, F.size(features.log_axes([]))) == 0
    assert features.last_by(spark.range(5).withColumn("k", F.lit(1)), "k", "id").first()["id"] == 4


def test_long_paths_and_many_fronts(spark):
    from inspect import signature

    chain = spark.createDataFrame([(i, i + 1, i) for i in range(6)], "a long, b long, position long")
    assert graph.shortest_path(chain, 0, 6) == list(range(7)) and graph.shortest_path(chain, 0, 6, 5) == [] and graph.shortest_path(chain, 6, 0) == []
    assert signature(graph.shortest_path).parameters["most"].default is None and signature(decision.front_ranks).parameters["most"].default is None


@pytest.mark.parametrize("name", sorted(readers.ALIASES))
def test_every_header_alias(spark, name):
    df = spark.createDataFrame([("1.5", "0.25")], f"`{name.upper()}` string, other string")
    row = readers.telemetry(df).first()
    want = readers.ALIASES[name]
    assert row[want] == {"source": "1.5", "nan_count": 1}.get(want, 1.5)


def test_files_and_deliveries(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("x,y\n5,6\n")
    got = readers.file_summary(spark.read.csv(str(tmp_path), header=True)).collect()
    assert sorted((r["file_path"][-5:], r["rows"], r["columns"], r["bytes"]) for r in got) == [("a.csv", 2, 2, 12), ("b.csv", 1, 2, 8)]
    rows, odd = readers.batches(spark.createDataFrame([(1, [1.0]), (2, []), (3, None), (4, [0.0] * 256), (5, [0.0] * 257)], "d int, s array<double>"), "d", "s")
    assert rows.groupBy("d").count().orderBy("d").collect() == [(1, 1), (4, 256)] and sorted(r["d"] for r in odd.collect()) == [2, 3, 5]


def test_boxes_of_very_different_sizes(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(120):
        w = rng.choice([0.1, 1.0, 30.0, 5000.0])
        x, y, z = (rng.uniform(-100, 100) for _ in range(3))
        boxes.append((i, x, x + w, y, y + w * rng.random(), z, z + w * rng.random()))
    df = spark.createDataFrame(boxes, "id int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    meets = lambda a, b: all(a[k] <= b[k + 1] and b[k] <= a[k + 1] for k in (1, 3, 5))
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and meets(a, b))
    assert sorted(map(tuple, spatial.overlap_pairs(df, 0.5).collect())) == want
    half = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] % 2 == 0 and b[0] % 2 and meets(a, b))
    assert sorted(map(tuple, spatial.contacts(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), 0.5).collect())) == half
    points = spark.createDataFrame([(k, *(rng.uniform(-100, 100) for _ in range(3))) for k in range(50)], "id int, x double, y double, z double")
    held = {r["id"]: r["n_boxes"] for r in spatial.contained(points, df, 0.5).collect()}
    assert held == {p["id"]: sum(all(b[k] <= p[c] <= b[k + 1] for k, c in ((1, "x"), (3, "y"), (5, "z"))) for b in boxes) for p in points.collect()}


def test_large_fronts_block_by_block(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, float(i % 90), float(rng.randrange(60) if i % 3 else 100 - i % 90)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(7)
    want = sorted(r[0] for r in rows if not any(s[1] <= r[1] and s[2] <= r[2] and (s[1] < r[1] or s[2] < r[2]) for s in rows))
    for most in (100_000, 2):
        monkeypatch.setattr(decision, "FRONT", most)
        assert sorted(r["id"] for r in decision.pareto_front(df, ["a", "b"]).collect()) == want


def test_mesh_files(spark, tmp_path):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 1.0, 1.0, 1.0)], "vid int, x double, y double, z double")
    tets = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 2, 3, 4)], "tet_id int, v0 int, v1 int, v2 int, v3 int")
    own = writers.refined(tets, spark.createDataFrame([(1, 0.9)], "tet_id int, error double"), 0.5, 0.1)
    assert sorted((r["tet_id"], r["mask"]) for r in own.collect()) == [(0, -1), (1, 1)]
    writers.write_lines(writers.vtk_lines(own, vertices, ("error", "mask")), str(tmp_path / "vtk"))
    lines = [line for p in sorted((tmp_path / "vtk").glob("part-*")) for line in p.read_text().split("\n") if line]
    assert lines[:6] == ["# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", "POINTS 5 float", "0.0 0.0 0.0"]
    assert lines[10:14] == ["CELLS 2 10", "4 0 1 2 3", "4 1 2 3 4", "CELL_TYPES 2"] and lines[16:] == ["CELL_DATA 2", "SCALARS error float 1", "LOOKUP_TABLE default", "0.0", "0.9", "SCALARS mask float 1", "LOOKUP_TABLE default", "-1", "1"]

"""Rules against a plain loop, and templates against columns written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from strataform.operators import rules

RULES = [
    {"id": "d1", "agent": "diagnostician", "when": "drift > 8", "severity": "warn", "confidence": "least(1, drift / 20)", "title": "Energy drifts", "patch": {"dt": "dt * 0.5"}},
    {"id": "d2", "agent": "diagnostician", "when": "drift > 16", "severity": "critical", "confidence": 0.9, "title": "Energy explodes", "patch": {"dt": "dt * 0.5"}},
    {"id": "s1", "agent": "stabilizer", "when": "speed > 5 AND drift < 4", "severity": "critical", "confidence": 0.8, "title": "Damp", "patch": {"damping": "damping + 0.1", "field": "'none'"}},
    {"id": "s2", "agent": "stabilizer", "when": "speed > 3", "severity": "warn", "confidence": 0.8, "title": "Damp too", "patch": {"damping": "damping + 0.1", "field": "'none'"}},
    {"id": "o1", "agent": "optimizer", "when": "loss IS NULL", "severity": "info", "confidence": 0.4, "title": "Snapshot", "tool": "snapshot"},
    {"id": "o2", "agent": "optimizer", "when": "true", "severity": "info", "confidence": "0.4", "title": "Snapshot again", "tool": "snapshot"},
    {"id": "x1", "agent": "designer", "when": "loss < 1", "severity": "info", "confidence": "loss", "title": "Look", "patch": {}},
    {"id": "x2", "agent": "designer", "when": "loss < 2", "severity": "warn", "confidence": 0.1, "title": "Look"},
]


def plain(r):
    """The same rules in plain code, one after another."""
    drift, speed, loss = r["drift"], r["speed"], r["loss"]
    gt = lambda a, b: a is not None and a > b
    lt = lambda a, b: a is not None and a < b
    halved, damped = ("p", "dt", r["dt"] * 0.5), ("p", "damping", r["damping"] + 0.1)
    tried = [
        (gt(drift, 8), "d1", 2, min(1, (drift or 0) / 20), halved), (gt(drift, 16), "d2", 3, 0.9, halved), (gt(speed, 5) and lt(drift, 4), "s1", 3, 0.8, damped), (gt(speed, 3), "s2", 2, 0.8, damped),
        (loss is None, "o1", 1, 0.4, "snapshot"), (True, "o2", 1, 0.4, "snapshot"), (lt(loss, 1), "x1", 1, loss, "Look"), (lt(loss, 2), "x2", 2, 0.1, "Look"),
    ]
    seen, out = set(), []
    for on, name, level, sure, mark in tried:
        if on and mark not in seen:
            seen.add(mark)
            out.append((name, level, sure))
    return [x[0] for x in sorted(out, key=lambda x: (-x[1], -x[2]))]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    some = lambda high: None if rng.random() < 0.15 else round(rng.random() * high, 2)
    rows = [(i, some(25), some(8), some(3), rng.choice([0.1, 0.2]), 0.05, "o'k") for i in range(300)]
    return spark.createDataFrame(rows, "id int, drift double, speed double, loss double, dt double, damping double, rank string").withColumnRenamed("rank", "note")


def test_rules_equal_a_plain_loop(table):
    got: dict = {}
    for r in rules.fired(table, RULES).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r)
    for r in table.collect():
        assert [x["rule_id"] for x in got[r["id"]]] == plain(r)
        assert [x["rank"] for x in got[r["id"]]] == list(range(1, len(got[r["id"]]) + 1))
    one = next(x for rows in got.values() for x in rows if x["rule_id"] == "s2")
    assert one["patch"] == {"damping": "0.15000000000000002", "field": "none"} and one["tool"] is None and one["severity"] == "warn"


def test_agents_off_bounds_and_errors(table):
    off = rules.fired(table, RULES, {"optimizer": False, "designer": False})
    assert {r["agent"] for r in off.select("agent").distinct().collect()} == {"diagnostician", "stabilizer"}
    assert rules.fired(table, RULES, most=1).groupBy("id").count().filter("count > 1").count() == 0
    assert rules.fired(table, []).count() == 0 and rules.fired(table.limit(0), RULES).count() == 0
    for wrong in ({"when": "nothing > 1"}, {"when": "drift"}, {"when": "drift >"}, {"severity": "bad"}, {"confidence": "note"}):
        with pytest.raises(rules.RuleError):
            rules.fired(table, [RULES[0] | wrong])


BASE = {"parameters": {"load": {"type": "number", "default": 2.0, "least": 0, "most": 100}, "n": {"type": "integer", "default": 3}}, "outputs": {"stress": "drift * {load}", "count": "{n} + 1"}}
SPECIAL = {"extends": BASE, "parameters": {"kind": {"type": "string", "default": "it's", "choices": ["it's", "b"]}, "on": {"type": "boolean", "default": True}}, "outputs": {"count": "{n} * 2", "label": "concat({kind}, note)", "both": "{on} AND {stress} > {count}"}}


def test_templates_equal_columns_by_hand(table):
    got = rules.filled(table, SPECIAL, {"load": 1.5, "n": 4})
    stress = F.col("drift") * 1.5
    want = table.select("*", stress.alias("stress"), F.lit(8).alias("count"), F.concat(F.lit("it's"), "note").alias("label"), (stress > 8).alias("both"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    many = rules.variants(table, BASE, [{"variant": "a", "load": 1}, {"variant": "b", "n": 9}])
    assert many.count() == 600 and many.filter("variant = 'b' AND count = 10").count() == 300 and many.filter("variant = 'a' AND NOT (stress <=> drift)").count() == 0


@pytest.mark.parametrize("values", [{"load": "x"}, {"load": -1}, {"load": 101.0}, {"load": True}, {"n": 1.5}, {"kind": "c"}, {"more": 1}, {"load": float("nan")}])
def test_wrong_parameters(values):
    with pytest.raises(rules.RuleError):
        rules.compiled(SPECIAL, values)


def test_wrong_templates(table):
    for outputs in ({"a": "{nobody}"}, {"a": "{b}", "b": "1"}, {"a": "nothing + 1"}, {"a": "array(1)"}):
        with pytest.raises(rules.RuleError):
            rules.filled(table, {"outputs": outputs})
    loop = {"outputs": {"a": "1"}}
    loop["extends"] = loop
    with pytest.raises(rules.RuleError):
        rules.compiled(loop)

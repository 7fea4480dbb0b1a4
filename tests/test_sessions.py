"""Sessions of a stream against those of a table and plain code, rows out of order and late ones among them."""

import random

import pytest

from strataform.streaming import sessions

SCHEMA = "k string, t double, v double, place int"


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(6), []
    for k in ("a", "b", "c"):
        t = 0.0
        for _ in range(120):
            t += rng.choice([1, 2, 3, 30])
            out.append((t, k, t - rng.choice([0, 0, 0, 5, 12, 80]), float(rng.randrange(9))))
    return [(*r[1:], i) for i, r in enumerate(sorted(out))]  # as they come, not as they were made


def plain(rows, gap, lateness):
    """Late rows by a key's clock; the others in order, cut where they are further apart than the gap."""
    clock, late, kept = {}, [], {}
    for k, t, v, _ in rows:
        if t < clock.get(k, float("-inf")) - lateness:
            late.append((k, "late", t, t, 1, v))
            continue
        clock[k] = max(clock.get(k, t), t)
        kept.setdefault(k, []).append((t, v))
    out = []
    for k, own in kept.items():
        own.sort()
        group = [own[0]]
        for x in [*own[1:], (float("inf"), 0)]:
            if x[0] - group[-1][0] > gap:
                out.append((k, "session", group[0][0], group[-1][0], len(group), sum(v for _, v in group)))
                group = []
            group.append(x)
    return out, late


def told(df):
    return sorted(tuple(r) for r in df.select("key", "kind", "first", "last", "n", "total").collect())


@pytest.mark.parametrize("lateness", [10.0, 1000.0])
def test_a_table_equals_plain_code(spark, rows, lateness):
    got = told(sessions.sessions(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", "t", "v", 4.0, "place", lateness))
    want, late = plain(rows, 4.0, lateness)
    assert [r for r in got if r[1] == "late"] == sorted(late) and (lateness > 100 or late)
    assert [r for r in got if r[1] == "session"] == sorted(want)


def stream(spark, tmp_path, rows, idle):
    size = -(-len(rows) // 4)
    for i in range(4):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"s{abs(hash(str(tmp_path)))}"
        q = sessions.live_sessions(source, "k", "t", "v", 4.0, 10.0, idle).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return told(spark.table(name))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_stream_equals_the_table(spark, tmp_path, rows):
    """Late rows and closed sessions are the table's; what is still open at the end isn't told."""
    got = stream(spark, tmp_path, rows, None)
    every = told(sessions.sessions(spark.createDataFrame(rows, SCHEMA), "k", "t", "v", 4.0, "place", 10.0))
    clock = {k: max(r[1] for r in rows if r[0] == k) for k in "abc"}
    assert got == [r for r in every if r[1] == "late" or r[3] + 4.0 < clock[r[0]] - 10.0]


def test_silent_keys_end(spark, tmp_path, rows):
    """A key that only the first batch has gives its open sessions once it was silent."""
    own = [("z", 1.0, 2.0, -1), ("z", 2.0, 3.0, -1), *rows]
    got = stream(spark, tmp_path, own, 0)
    assert ("z", "session", 1.0, 2.0, 2, 5.0) in got


def test_silences(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 20.0), ("b", 1.0), ("a", None), (None, 3.0)], "k string, t double")
    assert sorted(map(tuple, sessions.silences(df, "k", "t", 6.0).collect()), key=str) == [("a", 20.0, None), ("a", 5.0, 20.0), ("b", 1.0, None)]

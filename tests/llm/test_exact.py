"""Exact dedup against a dictionary, with hashes that collide as well."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from strataform.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for text, g in groups.items():
        best = min(g)
        keep = None if best[1] else best[2]
        out += [(None if null else i, keep, len(g), (None if null else i) == keep, hashlib.sha256(text.encode()).hexdigest()) for _, null, i in g]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, group_size int, _hash string")
    return sorted((tuple(r)[:5] for r in exact_dedup.exact_dedup(df, **more).collect()), key=str)


def rows():
    rng = random.Random(1)
    base = ["", "a", "b c", "über straße", "x\x0by\x0cz", "\u00a0a", "long " * 3000]
    out = [(i, rng.choice(base) + rng.choice(["", " ", "\n\t", "  "])) for i in range(120)]
    return [*out, (200, None), (201, None), (None, "a"), (None, " \t"), (7, "a "), (7, "a ")]


def test_equals_brute_force(spark):
    assert run(spark, rows()) == brute(rows())
    assert run(spark, []) == []


def test_colliding_hashes(spark):
    weak = lambda sha: F.substring(sha, 1, 1)
    assert run(spark, rows(), hash_of=weak) == brute(rows())


def test_large_groups_and_string_ids(spark):
    many = [(i, "the same text" if i % 3 else f"t{i % 50}") for i in range(400)]
    assert run(spark, many, hot=4) == brute(many)
    df = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", " x"), (None, "x"), ("d", "y")], "doc_id string, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {"a": ("a", 4, True), "b": ("a", 4, False), "c": ("a", 4, False), None: ("a", 4, False), "d": ("d", 1, True)}

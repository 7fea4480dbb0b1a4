"""Removal of repeats against brute force over all positions."""

import random

import numpy as np
import pytest

from strataform.llm import suffix_dedup


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        off = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                off[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if off[k] and (k == 0 or not off[k - 1]))
        out.append((i, len(b), sum(off), spans, bytes(x for x, o in zip(b, off) if not o)))
    return sorted(out)


def run(spark, rows, **more):
    table = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, chunk int")
    return sorted(tuple(bytes(c) if isinstance(c, bytearray) else c for c in r) for r in suffix_dedup.remove_repeats(table, **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)  # many chunks
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (9, 10, 12, 30, 60)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(3), rng.choice(passages)[rng.randrange(5) : rng.choice([None, -1, -7])])
        rows.append((i * 3 % 120, rng.choice([" ", ""]).join(parts)))
    rows[5], rows[6], rows[7], rows[8] = (5, None), (6, ""), (7, "x" * 300), (8, "x" * 49 + "y" + "x" * 120)
    rows += [(200, rows[20][1]), (201, rows[20][1]), (202, "ab" * 80), (203, "ab" * 40), (204, "abc" * 40)]
    rows += [(i, rows[20][1][::-1] + "tail") for i in range(300, 330)]
    rows += [(400, rows[30][1]), (400, rows[30][1] + "more")]  # one id twice
    assert run(spark, rows) == brute(rows, 50)


def test_other_lengths_and_empty_tables(spark):
    rows = [(2, "the quick brown fox jumps"), (1, "a quick brown fox jumped")]
    for n in (9, 12):
        assert run(spark, rows, length=n) == brute(rows, n)
    assert run(spark, []) == []


def test_null_ids_and_whole_characters(spark):
    t = "é" * 40
    table = spark.createDataFrame([(None, t), (1, "x" + t), (2, "ü" + t)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table, whole_characters=True).collect()}
    assert got[None]["n_removed"] == 0 and got[1]["n_removed"] == 0
    assert got[2]["n_removed"] == 80 and bytes(got[2]["kept"]).decode() == "ü"


def test_prefixes_tell_strings_apart():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=4000)), dtype=np.uint8)
    for n in (1, 2, 7, 25, 50):
        h = suffix_dedup.prefixes(data, n)
        assert len(h) == len(data) - n + 1
        assert len(set(h.tolist())) == len({data[i : i + n].tobytes() for i in range(len(h))})


def test_string_ids_and_very_long_texts(spark):
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh ", k=2_300_000))  # many slices
    rows = [("b", "x" * 10 + long[1_000_000:1_000_200]), ("c", long), ("a", long[2_000_000:2_000_100])]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {"a": (0, 0), "b": (0, 0), "c": (300, 2)}

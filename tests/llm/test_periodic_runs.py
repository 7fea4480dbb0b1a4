"""Periodic runs against a plain search over all stretches and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from strataform.llm import periodic_runs


def plain_runs(words):
    """Every lag's maximal stretches, kept if no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            stretch = words[start : start + length]
            if length >= max(6, 4 * q) and not any(all(stretch[k] == stretch[k + r] for k in range(length - r)) for r in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def want(doc_id, text):
    words = split(text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "n_runs": len(runs), "start": best and best[1], "length": best and -best[0], "period": best and best[2], "exponent_milli": best and -best[0] * 1000 // best[2],
        "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    }


def texts(rng, n):
    """Random words of few kinds, with periodic passages of all lengths, nested and touching."""
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choices("abcdé", k=rng.randrange(12))
            block = rng.choices("ab" if rng.random() < 0.5 else "abcdefgh", k=rng.randrange(1, 9))
            words += (block * 12)[: rng.randrange(len(block) * 7)]
            if rng.random() < 0.3:
                words = words[-40:] * rng.randrange(1, 6)
        yield rng.choice([" ", "\n", "\t \x0b"]).join(words)


def check(spark, rows):
    table = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, n_runs int").repartition(3)
    got = periodic_runs.digests(table).collect()
    key = lambda d: sorted(d.items(), key=str)
    assert sorted([key(r.asDict() | {"n_words": None}) for r in got], key=str) == sorted([key({"doc_id": i, **want(i, t), "n_words": None}) for i, t in rows], key=str)


def test_equals_plain_search(spark):
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 400)))
    assert sum(want(i, t)["n_runs"] > 1 for i, t in rows) > 50
    check(spark, rows)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 4000]
    assert sum(want(i, t)["n_runs"] > 0 for i, t in rows) > 5
    check(spark, rows)


def test_nulls_repeats_and_empty_tables(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a " * 9), (None, None), (4, "a a a a a"), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a a " * 6), (6, "A a " * 6)])
    check(spark, [])


@pytest.mark.parametrize("least", [6, 9])
def test_least_length(least):
    for text in texts(random.Random(5), 150):
        ids = periodic_runs._numbers([w.encode() for w in split(text)])
        if len(ids) >= least:
            assert periodic_runs.find_runs(ids, least) == [x for x in plain_runs(ids.tolist()) if x[1] >= max(least, 4 * x[2])]


def test_very_long_texts():
    """Single words without end, long periods and natural text of a million words are quick."""
    rng = np.random.default_rng(1)
    n = 1_000_000
    assert periodic_runs.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    natural = np.minimum(rng.zipf(1.3, n), 50_000)
    for start, length, q in periodic_runs.find_runs(natural):
        assert (natural[start + q : start + length] == natural[start : start + length - q]).all() and length >= max(6, 4 * q)
    natural[300_000:700_000] = natural[300_000:301_000].tolist() * 400
    assert (300_000, 400_000, 1000) in [(s, m // 1000 * 1000, q) for s, m, q in periodic_runs.find_runs(natural)]


def test_blocks_of_lags_agree(monkeypatch):
    want = [periodic_runs.find_runs(periodic_runs._numbers([w.encode() for w in split(t)])) for t in texts(random.Random(8), 80) if len(split(t)) > 5]
    monkeypatch.setattr(periodic_runs, "SAMPLES", 16)
    assert want == [periodic_runs.find_runs(periodic_runs._numbers([w.encode() for w in split(t)])) for t in texts(random.Random(8), 80) if len(split(t)) > 5]

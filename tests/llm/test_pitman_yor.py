"""The Pitman-Yor model: exact counts, probabilities that add up, and better scores on held-out text than the base."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strataform.llm import pitman_yor
from strataform.llm._exchange import from_small, small


def tokens(t):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").split()] + [None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(40)]
    out = []
    for i in range(700):
        words = []
        for _ in range(rng.randrange(2, 40)):
            words += [rng.choice(["the", "The", "a"]), rng.choice(nouns), rng.choice(verbs)]
        if i % 50 == 0:
            words.append(f"rare{i}")
        out.append((i, " ".join(words)))
    return [*out, (700, None), (701, ""), (702, " \t\n "), (None, "the n1")]


def run(spark, rows, **more):
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, chunk int")
    return pitman_yor.score(table, **more).collect()


def test_counts_and_base(spark, monkeypatch, rows):
    monkeypatch.setattr(pitman_yor, "CHUNK", 20_000)
    got = run(spark, rows)
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(text[r["doc_id"]])
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.85


def shares(spark, rows, befores, words, **more):
    """P(w | u) by the token scores of the texts "u w"."""
    held = iter([i for i in range(100_000, 900_000) if zlib.crc32(str(i).encode()) % 7 == 2])
    ask = {next(held): (u, w) for u in befores for w in words}
    got = {r["doc_id"]: r["token_scores"] for r in run(spark, rows + [(i, f"{u} {w}") for i, (u, w) in ask.items()], by_token=True, **more)}
    return {uw: 10 ** got[i][1] for i, uw in ask.items()}


def test_probabilities_add_up(spark, rows):
    """After a frequent word, a rare one, and one that wasn't learned, the vocabulary, the end and one unknown word share 1."""
    vocabulary = sorted({w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t)[:-1]})
    assert "rare150" in vocabulary
    got = shares(spark, rows, ("the", "rare150", "new"), [*vocabulary, "unknown", ""])
    for u in ("the", "rare150", "new"):
        assert math.isclose(sum(p for (b, _), p in got.items() if b == u), 1, rel_tol=1e-9)


def test_rare_contexts_have_restaurants(spark):
    """What followed a word that was learned once or twice is likelier after it; others keep their shares at the parent."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = list(zip(ids, ["once a", "twice a", "twice a", *["a", "b"] * 20, *["b x"] * 3]))
    got = shares(spark, rows, ("once", "twice", "new"), ("a", "b", "zzz"))
    lift = {u: got[u, "a"] / got["new", "a"] for u in ("once", "twice", "new")}
    assert lift["twice"] > lift["once"] > 1.05
    d, s = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    assert math.isclose(got["once", "b"] / got["new", "b"], (s + d) / (s + 1), rel_tol=1e-9)
    assert math.isclose(got["once", "zzz"] / got["new", "zzz"], (s + d) / (s + 1), rel_tol=1e-9)
    assert math.isclose(got["once", "a"], (1 - d) / (s + 1) + got["new", "a"] * (s + d) / (s + 1), rel_tol=1e-9)


def plain_sampler(texts, ask, sweeps=60, burn_in=20, seed=1):
    """The same model, one customer after another is taken out and seated anew; average P(w | u) of ask."""
    rng, d, s = random.Random(seed), pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    pairs = [(u, w) for t in texts for u, w in zip([None, *tokens(t)[:-1]], tokens(t))]
    size = len({w for _, w in pairs}) + 1
    rooms = {}  # restaurant: dish: sizes of its tables

    def stats(room, w):
        dishes = rooms.setdefault(room, {})
        return dishes.setdefault(w, []), sum(map(sum, dishes.values())), sum(map(len, dishes.values()))

    def p(room, w):
        if room is ...:
            return 1 / size
        own, n, t = stats(room, w)
        return (sum(own) - d * len(own) + (s + d * t) * p(... if room == "top" else "top", w)) / (s + n)

    def seat(room, w):
        if room is ...:
            return
        own, _, t = stats(room, w)
        up = ... if room == "top" else "top"
        weights = [k - d for k in own] + [(s + d * t) * p(up, w)]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            seat(up, w)
        else:
            own[k] += 1

    def leave(room, w):
        if room is ...:
            return
        own = rooms[room][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            leave(... if room == "top" else "top", w)

    total = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            if sweep:
                leave(("after", u), w)
            seat(("after", u), w)
        if sweep >= burn_in:
            for u, w in ask:
                total[u, w] += p(("after", u), w) if ("after", u) in rooms else p("top", w)
    return {k: v / (sweeps - burn_in) for k, v in total.items()}


def test_agrees_with_a_plain_sampler(spark):
    rng = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(8)]
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [" ".join(x for _ in range(rng.randrange(1, 6)) for x in (rng.choice(["the", "a"]), rng.choice(nouns), rng.choice(verbs))) for _ in range(60)]
    befores, words = ("the", "a", "n1", "v3", "new"), ("the", "a", "n1", "n5", "v3", "v4", "unknown")
    want = plain_sampler(texts, [(u, w) for u in befores for w in words])
    got = shares(spark, list(zip(ids, texts)), befores, words, rounds=10, samples=5)
    off = [abs(math.log(got[k] / want[k])) for k in want]
    assert sum(off) / len(off) < 0.15 and max(off) < 0.4


def test_drawn_tables_follow_their_distribution():
    """Against single customers sitting down under weights that count every seating: two and three customers by hand, and the saddle point against the table where both can be used."""
    n, d, s = 40_000, pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    names = np.arange(n, dtype=np.uint64)
    one = lambda x: np.full(n, x)
    t = pitman_yor.draw_tables(names, 1, one(2), one(3.0), one(0.1))
    first, second = (s + d * 3) * 0.1, (s + d * 4) * 0.1
    assert abs((t == 2).mean() - first * second / (first * second + first * (1 - d))) < 0.01
    third = (s + d * 5) * 0.1
    weights = np.array([first * (1 - d) * (2 - d), 3 * first * second * (1 - d), first * second * third])
    t = pitman_yor.draw_tables(names, 1, one(3), one(3.0), one(0.1))
    assert np.abs(np.bincount(t, minlength=4)[1:] / n - weights / weights.sum()).max() < 0.01
    for rest, p in ((50.0, 0.01), (500.0, 0.05), (5.0, 0.5), (0.0, 0.05), (2000.0, 0.2), (20000.0, 0.001)):
        t = pitman_yor.draw_tables(names[:4000], 2, np.full(4000, 100), np.full(4000, rest), np.full(4000, p))
        mean, deviation = pitman_yor.seating_moments(np.array([100]), np.array([rest]), np.array([p]), d, s)
        assert abs(mean[0] - t.mean()) < 0.06 * t.mean() + 0.2 and abs(deviation[0] - t.std()) < 0.1 * t.std() + 0.5
    big = pitman_yor.draw_tables(names[:3], 1, np.array([10**3, 10**6, 10**9]), np.full(3, 1e4), np.full(3, 0.9))
    # as many as the others' tables let the dish have: (s + d (rest + t)) p / d of them
    assert 900 < big[0] < 1000 and (np.abs(big[1:] - 73_380) < 5_000).all()


def test_no_rows(spark):
    assert run(spark, []) == []


def test_a_very_long_text_and_rows_that_repeat(spark):
    long = "the n1 v2 " * 200_000  # many slices, one chunk
    got = {r["doc_id"]: r for r in run(spark, [(5000, long), (1, "the n1"), (None, "the n1"), (None, "the n1")])}
    assert got[5000]["n_tokens"] == 600_001 and math.isfinite(got[5000]["score"]) and got[5000]["score"] < 0
    assert got[None]["held_out"] and len(run(spark, [(None, "a"), (None, "a"), (7, "b")])) == 3


def test_texts_are_read_once(spark, monkeypatch, tmp_path, rows):
    """Counting words and pairs, the state and the scores rest on one reading of each text."""
    monkeypatch.setattr(pitman_yor, "CHUNK", 20_000)
    plain, folder = pitman_yor.words, str(tmp_path)

    def counted(data, lower=False):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(data)))
        return plain(data, lower)

    monkeypatch.setattr(pitman_yor, "words", counted)
    assert len(run(spark, rows)) == len(rows)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == len(rows)


@pytest.mark.parametrize("d", [pitman_yor.DISCOUNT, 0.95])
def test_drawn_tables_equal_all_weights_summed(d):
    """Dishes of all sizes in any order: the draw is where the summed weights pass the random number, though small ones aren't summed."""
    rng = np.random.default_rng(5)
    n, s = 3000, pitman_yor.STRENGTH
    c, rest, p = rng.integers(1, pitman_yor.TABULATED + 1, n), rng.integers(0, 3000, n).astype(float), 10 ** rng.uniform(-6, 0, n)
    names = rng.integers(0, 1 << 63, n).astype(np.uint64)
    got, u, seatings = pitman_yor.draw_tables(names, 3, c, rest, p, d), pitman_yor._noise(names, 3, 1), pitman_yor._log_seatings(d)
    for i in range(n):
        t = np.arange(1, c[i] + 1)
        logs = seatings[c[i], 1 : c[i] + 1] + np.cumsum(np.log((s + d * (rest[i] + t - 1)) * p[i]))
        share = np.cumsum(np.exp(logs - logs.max()))
        assert got[i] == 1 + np.searchsorted(share / share[-1], u[i])
    one = [pitman_yor.draw_tables(names[i : i + 1], 3, c[i : i + 1], rest[i : i + 1], p[i : i + 1], d)[0] for i in range(0, n, 7)]
    assert (got[::7] == one).all()


def test_small_numbers_of_any_size():
    for x in ([], [0, 65534, 65535, 65536, 1 << 40, 7], [3] * 10):
        assert from_small(small(np.array(x, dtype=np.int64))).tolist() == x

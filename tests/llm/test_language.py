"""Language ID: profiles and distances against plain counting, and accuracy on held-out rows."""

import random
import zlib
from collections import Counter

from strataform.llm import language_id


def grams(text):
    out, words, word = Counter(), [], ""
    for c in (text or "").lower():
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    words += [word] if word else []
    for w in words:
        out.update((c, "", "") for c in w)
        p = f"\0{w}\0"
        out.update((a, b, "") for a, b in zip(p, p[1:]))
        out.update((a, b, c) for a, b, c in zip(p, p[1:], p[2:]))
    return out


def order(counts):
    code = lambda g: [ord(x) if x else 0x1FFFFF for x in g]
    kind = lambda g: sum(map(bool, g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], kind(x[0]), code(x[0])))]


def order_profile(counts):
    code = lambda g: [ord(x) if x else 0x1FFFFF for x in g]
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.TOP]


def guess(text, profiles):
    own = order(grams(text))[: language_id.TOP]
    if not own:
        return "und", 0.0
    far = {k: sum(min(abs(i - p.index(g)), language_id.TOP) if g in p else language_id.TOP for i, g in enumerate(own)) for k, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (language_id.TOP * len(own))


def rows():
    rng = random.Random(1)
    parts = {"a": ["tha", "wer", "ing", "o"], "b": ["sch", "ü", "ung", "ße"], "c": ["eau", "é", "ion", "ç"]}
    out = []
    for i in range(150):
        lang = rng.choice("abc")
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))).capitalize() + rng.choice(["", ",", "."]) for _ in range(rng.randrange(3, 60))), lang))
    return [*out, (200, None, "a"), (201, "", "a"), (202, "12 %% \n", "b"), (203, "tha", None), (None, "sch ung", "c"), (204, "x\0y tha", None)]


def test_equals_plain_counting(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, k, 1.0) for i, t, k in data], "doc_id bigint, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    assert len(got) == len(data)
    held = {i: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in data}
    total = {}
    for i, t, k in data:
        if not held[i] and t is not None and k is not None:
            total.setdefault(k, Counter()).update(grams(t))
    profiles = {k: order_profile(c) for k, c in total.items()}
    right = []
    for i, t, k in data:
        lang, score = guess(t, profiles)
        assert got[i]["held_out"] == held[i] and got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-9, (i, t)
        right += [lang == k] if held[i] and i is not None and i < 200 else []
    assert sum(right) / len(right) > 0.95


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.language_id(df).collect()] == [("und", 0.0)]
    assert language_id.language_id(df.limit(0)).count() == 0


def test_a_very_long_text_and_folded_counts(spark, monkeypatch):
    """Whole texts count, and counts that are folded and sent in parts add up to the same profiles."""
    long = "schung über " * 60_000 + "tha wering " * 50_000
    data = [*rows(), (300, long, None), (301, "schung über " * 6 + "tha wering " * 5, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(df).collect()}
    assert whole[300][0] == whole[301][0] and abs(whole[300][1] - whole[301][1]) < 0.01  # the same shares of n-grams
    learned = df.filter("lang IS NOT NULL").select("text", "lang")
    profiles = language_id.train(learned)
    monkeypatch.setattr(language_id, "FOLD", 64)
    assert language_id.train(learned) == profiles

"""Personal data against the patterns themselves and plain counting of who keeps company with whom."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from strataform.llm import queries, sanitisation

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 13 <= len(d) <= 19 and luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def plain(rows, window, support, share):
    """For each row base spans and terms: (start, end)."""
    docs = []
    for _, text in rows:
        text = text or ""
        base = plain_base(text)
        words = [(m.start(), m.end(), low(m.group())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        words = [w for w in words if not any(w[0] < e and s < w[1] for _, s, e in base)]
        near = defaultdict(set)
        for k, s, e in base:
            value = (k, text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e]))
            before, after = [w for w in words if w[1] <= s], [w for w in words if w[0] >= e]
            near[value] |= {w[2] for w in before[-window:] + after[:window]}
        docs.append((base, words, near))
    n = len(rows)
    held, seen, together, df = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(int)
    for _, words, near in docs:
        for w in {w[2] for w in words}:
            df[w] += 1
        for c, terms in near.items():
            held[c] += 1
            for t in terms:
                seen[c, t].add(frozenset(terms))
                together[c, t] += 1
    told = set()
    for (c, t), k in together.items():
        if len(seen[c, t]) >= support and held[c] < n and 1 - math.log(k / df[t]) / math.log(held[c] / n) >= share:
            told.add(t)
    return [(base, [(s, e) for s, e, w in words if w in told]) for base, words, _ in docs], told


def check(spark, rows, **how):
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, base int").repartition(3)
    got = sanitisation.sanitisation(table, **how).collect()
    want, told = plain(rows, how.get("window", 5), how.get("support", 3), how.get("share", 0.9))
    a = sorted((str(r["doc_id"]), [tuple(x) for x in r["base"]], [tuple(x)[:2] for x in r["terms"]]) for r in got)
    assert a == sorted((str(i), b, t) for (i, _), (b, t) in zip(rows, want))
    return told


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    common = [f"w{i}" for i in range(60)] + ["été", "日本", "The"]
    out = []
    for i in range(500):
        words = rng.choices(common, k=rng.randrange(5, 60))
        if i % 3 == 0:
            who = rng.randrange(12)
            at = rng.randrange(len(words))
            words[at:at] = rng.sample([f"Surname{who}", "ß", f"at user{who}@mail.example.com", "and"], k=4)
            if who == 5:
                words += ["Call", "Ünal5", "+1 (377) 555-027", str(who), "or", "192.168.0.5,"]
        out.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    return out + [(1000, out[0][1])] * 40


def test_equals_plain_counting(spark, rows):
    told = check(spark, rows)
    assert {f"surname{k}" for k in range(12)} <= told and not {"the", "and", "w1"} & told
    check(spark, rows, window=2, support=2, share=0.5)


def test_patterns_equal_plain_ones():
    rng = random.Random(1)
    pieces = ["a", "Z9", "@", ".", "-", "+", "_", "%", " ", "(", ")", "é", "1", "25", "255", "256", "0001", "4111 1111 1111 1111", "5500-0000-0000-0004", "x@y.z", "10.0.0.1", "+44 20 7946 0958", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert sanitisation.base_spans(text) == plain_base(text), text


def test_long_texts_take_time_in_proportion():
    n = 300_000
    for text in ("a" * n, "1" * n, "a@" * n, "1." * n, "+1" * n, "+1(" * n, "1 " * n, "a" * n + "@" + "b" * n, "1.2.3." * n + "é", "+1" + "(" * n):
        assert len(sanitisation.base_spans(text)) < n
    assert sanitisation.base_spans("x" * n + " me@mail.example.com") == [(0, n + 1, n + 20)]


def test_nulls_repeats_and_empty_tables(spark):
    same = "dr Watson reached at w@b.st today"
    check(spark, [(1, None), (2, ""), (None, same), (None, None), *[(3, same)] * 9, (4, "Watson"), (5, same + " or later"), (6, "old " + same), (7, "é" * 5000 + " Watson " + same)])
    check(spark, [])
    check(spark, [(1, same)] * 5)


def test_digests(spark, rows):
    got = {r["doc_id"]: r for r in sanitisation.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want, _ = plain(rows, 5, 3, 0.9)
    for (i, _), (base, terms) in zip(rows, want):
        r, own = got[i], [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert r["spans"] == ",".join(own + [f"term:{s}:{e}" for s, e in terms])
        assert [r[f"n_{x}"] for x in KINDS] == [sum(k == j for k, _, _ in base) for j in range(4)]


def test_sanitised_texts(spark, rows):
    got = {r["doc_id"]: r["text"] for r in sanitisation.sanitised(spark.createDataFrame([*rows, (2000, None)], "doc_id bigint, text string"), remove=1.1).collect()}
    assert got[2000] is None and not any(plain_base(t) or re.search("surname", t or "", re.I) for t in got.values() if t)
    assert any("[email]" in t and "[name]" in t for t in got.values() if t)
    assert all(got[i] == t for i, t in rows if not plain_base(t) and "urname" not in t and "Ünal" not in t and "Call" not in t)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op11_personal_data(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = plain_base(text or "")
        assert [got[i][f"n_{x}"] for x in KINDS] == [sum(k == j for k, _, _ in base) for j in range(4)]

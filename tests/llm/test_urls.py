"""URL filters: parts of a URL, given rules, and mined rules against all token combinations."""

import random
from itertools import combinations

import pytest

from strataform.llm import url_filter


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:n], rest[n:]
    m = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:m]


def given(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def tokens(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return [set(r["t"]) for r in df.select(url_filter.tokens_of(url_filter.host_of(df.url), url_filter.path_of(df.url)).alias("t")).collect()]


def brute_rules(baskets, support, confidence, lift):
    n, rate = len(baskets), sum(b for _, b in baskets) / len(baskets)
    every = sorted({t for s, _ in baskets for t in s})
    found = {}
    for k in range(1, 6):
        for c in combinations(every, k):
            hit = [b for s, b in baskets if s.issuperset(c)]
            if hit and sum(hit) / n >= support and sum(hit) / len(hit) >= confidence and sum(hit) / len(hit) / rate >= lift:
                found[frozenset(c)] = sum(hit) / len(hit)
    return {c: v for c, v in found.items() if not any(d < c and w >= v for d, w in found.items())}


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    hosts = ["www.example.com", "M.Example.NET", "b.example.org", "net", "x.org", "spam.shop"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.choice(['7', '81', 'a.html', ''])}{rng.choice(['', '?q=/en/', '#t'])}" for _ in range(300)]
    return [*urls, None, "", "no scheme/en/7", "http://", "http://example.com", "https://a.b.com?x", "https://COM/en/", "ftp://notexample.com/en/7", "http://x://y/z", "\nhttp://Example.com/en/7", "a\nb://COM\n/en/\n?", "http://long.com/en/" + "a/" * 50_000]


def test_url_parts_and_rules(spark, pages):
    rows = [(i, u, i) for i, u in enumerate(pages)] + [(0, pages[0], 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, path int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = [tuple(r)[:5] for r in url_filter.url_filter(df, labels).collect()]
    want = [(i, *split(u), given(*split(u))[0], given(*split(u))[1] or "allow") for i, u, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


#: The contract's list, word by word, and not the operator's own.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_each_rule_has_the_verdict_of_the_contract(spark):
    urls = {"http://a.com/en/x": "com/en/", "http://m.example.com/en/71": "example.com/en/7", "http://NET/de/": "net/de/", "https://www.example.net/de/1": "net/de/", "http://example.net/de/81?q": "example.net/de/8", "http://b.example.org/es/1#t": "org/es/"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    # The labels are the other way round: a mined rule has no say where a given one fits.
    labels = spark.createDataFrame([(i, int(CONTRACT[r] == "block"), 0) for i, r in enumerate(urls.values())], "doc_id bigint, quality int, toxic int")
    got = [(r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, labels, min_pages=1).orderBy("page_id").collect()]
    assert got == [(r, CONTRACT[r]) for r in urls.values()]
    assert {r: v for v, r in url_filter.RULES} == CONTRACT


def test_mined_rules_equal_all_combinations(spark, pages):
    rng = random.Random(9)
    rows = [(i, u) for i, u in enumerate(pages)]
    sets = tokens(spark, pages)
    bad = [("domain=shop" in s and rng.random() < 0.9) or ("path=es" in s and rng.random() < 0.7) or rng.random() < 0.05 for s in sets]
    labels = [(i, 0 if b else 1, rng.choice([0, None])) for i, b in enumerate(bad) if i % 2] + [(None, 0, 1), (5000, 0, 1)]
    baskets = [(sets[i], bad[i]) for i in range(len(pages)) if i % 2]
    rules = brute_rules(baskets, 0.02, 0.6, 1.2)
    assert rules
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), min_support=0.02, min_confidence=0.6, min_lift=1.2, min_pages=1).collect()
    assert len(got) == len(rows)
    for r in got:
        fits = [v for c, v in rules.items() if c <= sets[r["page_id"]]]
        assert (r["confidence"] is not None) == bool(fits)
        assert not fits or abs(r["confidence"] - max(fits)) < 1e-9
        assert r["verdict"] == (given(r["host"], r["path"])[1] or ("block" if fits else "allow"))


def test_a_single_page_makes_no_rule_and_common_tokens_are_one(spark):
    deep = "/".join(f"d{k}" for k in range(40))  # 2**40 combinations, if each directory counted
    urls = [f"http://{'a.b.c.d.e.f.bad.com' if i % 2 else 'good.com'}/{deep}/{i}" for i in range(40)] + ["http://once.net/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(not (i % 2 or i == 40)), 0) for i in range(41)], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(40)) and got[40] == "allow"

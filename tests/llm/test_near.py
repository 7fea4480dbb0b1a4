"""Near copies of documents and paragraphs against all pairs by brute force."""

import random

import pytest

from strataform.llm import near, ngram_join, paragraph_dedup


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def closed(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def noisy(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(6)]
    out = [None, "", "  \n ", "one two", "one  two", "a b c d e", "a b c d e f"]
    for b in base:
        out += [noisy(rng, b, k) for k in (0, 0, 1, 2, 3, 5)]
    out += [noisy(rng, base[0], 1) for _ in range(200)]  # more than a block
    return out


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, key string")


@pytest.mark.parametrize("block", [1024, 40])
def test_ngram_join_equals_all_pairs(spark, texts, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    root = closed(len(texts), links)
    count = [sum(i in p for p in links) for i in range(len(texts))]
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_links"] for i in range(len(texts))] == count


def test_ngram_join_without_rows_and_with_repeated_ids(spark):
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "x"), (1, long, "x"), (None, long, "x"), (2, "other words that stand here alone", None)]
    got = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string, key string")).collect())
    assert got == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["key"]: r["component"] for r in near.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_band_plan_reaches_recall():
    for t, recall, rows in ((0.8, 0.9999, 5), (0.8, 0.999, 2), (0.5, 0.9, 3)):
        b = near.band_plan(t, recall, rows)
        assert 1 - (1 - t**rows) ** b >= recall > 1 - (1 - t**rows) ** (b - 1)


def test_paragraphs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(paragraph_dedup, "CHUNK", 4000)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(5)]
    docs = []
    for _ in range(60):
        lines = [noisy(rng, rng.choice(base), rng.choice((0, 1, 2, 6))) if rng.random() < 0.5 else " ".join(f"q{rng.randrange(9999)}" for _ in range(30)) for _ in range(4)]
        docs.append("\n".join([*lines, "short line", "the same five words here", ""]))
    docs += [None, "", "one. two. three"]
    lines = [(d, k, grams(x.decode())) for d, t in enumerate(docs) for k, x in enumerate(paragraph_dedup.paragraphs((t or "").encode())) if x.split()]
    root = closed(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i][2], lines[j][2]) >= 0.8])
    want = {lines[i][:2] + lines[r][:2] for i, r in enumerate(root) if lines[i][0] != lines[r][0]}
    copies, cleared = paragraph_dedup.paragraph_copies(frame(spark, docs))
    assert {tuple(r) for r in copies.collect()} == want
    by = {r["doc_id"]: r for r in cleared.collect()}
    assert len(by) == len(docs)
    for d, t in enumerate(docs):
        own = paragraph_dedup.paragraphs((t or "").encode())
        gone = sorted(k for e, k, *_ in want if e == d)
        assert by[d]["removed"] == gone and by[d]["n_removed"] == len(gone) and by[d]["n_paragraphs"] == len(own)
        assert bytes(by[d]["kept"]) == b"".join(x for k, x in enumerate(own) if k not in gone)


def test_a_word_more_at_either_end_of_eight(spark):
    docs = []
    for k in range(40):
        w = [f"w{k}x{i}" for i in range(9)]
        docs += [" ".join(w[:8]), " ".join(w), " ".join(w[1:])]
        docs += [" ".join([f"v{k}x{i}" for i in range(n)]) for n in (6, 7)]  # 2 of 3 shingles: too few
    by = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.digests(frame(spark, docs)).collect()}
    assert [by[i] for i in range(len(docs))] == [0, 1, 1, 0, 0] * 40
    assert [paragraph_dedup.whole_under(t) for t in (0.5, 0.8, 0.9, 1.0)] == [1, 4, 9, 1]


def test_passages_inside_other_text_are_found(spark):
    rng = random.Random(6)
    sentence = lambda: " ".join(f"s{rng.randrange(99999)}" for _ in range(rng.randrange(4, 13))) + ". "
    hits = 0
    docs = []
    for _ in range(60):
        passage = ""
        while len(passage.split()) < 55:
            passage += sentence()
        for _ in range(2):
            front, back = "".join(sentence() for _ in range(4)), "".join(sentence() for _ in range(4))
            docs.append(front[: rng.randrange(20, 60)] + " " + passage + back)
    by = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.digests(frame(spark, docs)).collect()}
    hits = sum(by[2 * k + 1] > 0 for k in range(60))
    assert hits >= 55 and not any(by[2 * k] for k in range(60))


def test_passages_of_whole_sentences_lose_every_word(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join(f"s{rng.randrange(99999)}" for _ in range(rng.randrange(4, 13))) + ". "
    docs, passages = [], []
    for _ in range(60):
        passage = []
        while sum(len(s.split()) for s in passage) < 20:
            passage.append(sentence())
        passages.append(passage)
        docs += ["".join([*(sentence() for _ in range(4)), *passage, *(sentence() for _ in range(4))]) for _ in range(2)]
    rows = paragraph_dedup.paragraph_copies(frame(spark, [*docs, docs[0]]))[1].collect()
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in rows}
    by = {r["doc_id"]: r for r in rows}
    for k, passage in enumerate(passages):
        assert kept[2 * k] == docs[2 * k] and by[2 * k]["n_removed"] == 0
        assert not any(s in kept[2 * k + 1] for s in passage)
        r, text = by[2 * k + 1], docs[2 * k + 1].encode()
        own = [p if i not in r["removed"] else b"" for i, p in enumerate(paragraph_dedup.paragraphs(text))]
        assert len(b"".join(own)) - sum(x["size"] for x in r["passages"]) == len(kept[2 * k + 1])
    assert kept[120] == ""


def test_passages_of_rows_that_repeat_an_id(spark):
    p = "one two three four five six seven eight nine. " * 2
    q = " ".join(f"q{i}" for i in range(20)) + ". "
    a = " ".join(f"a{i}" for i in range(30))
    docs = [(1, "ab cd. " + p + a), (1, "ab cd. " + p + a), (2, "xy. " + q + "z z. " + p), (2, q + " b" + a)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in paragraph_dedup.paragraph_copies(df)[1].collect())
    assert [k for i, k in kept if i == 1] == [docs[0][1]] * 2
    assert sum(q.strip() in k for i, k in kept if i == 2) == 2 and not any(p in k for i, k in kept if i == 2)


def test_short_lines_belong_to_the_paragraph_after_them():
    text = b"Head\none two three four five six\nx\n\nseven eight nine ten\nb c\nend"
    assert paragraph_dedup.paragraphs(text) == [b"Head\none two three four five six\n", b"x\n\nseven eight nine ten\nb c\nend"]
    assert paragraph_dedup.paragraphs(b"a b\nc\n") == [b"a b\nc\n"] and paragraph_dedup.paragraphs(b"") == []


def test_clean_documents_are_left_alone(spark):
    """Short sentences that many texts have, and what a document repeats of itself, stay."""
    rng = random.Random(12)
    common = ["The end of it. ", "And so on it goes. ", "See the list that follows. "]
    docs = []
    for _ in range(80):
        lines = ["".join(rng.choice(common) + " ".join(f"c{rng.randrange(99999)}" for _ in range(12)) + ". " for _ in range(3)) for _ in range(4)]
        docs.append("\n".join([*lines, lines[0], lines[1]]))
    longest = " ".join(f"l{i}" for i in range(400_000))  # beyond a slice
    docs += [longest, "x " + longest]
    by = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.digests(frame(spark, docs)).collect()}
    assert [by[i] for i in range(len(docs))] == [0] * 81 + [1]


def test_paragraphs_join_to_the_text_and_odd_rows(spark):
    rng = random.Random(1)
    for _ in range(300):
        t = bytes(rng.choice(b"ab. !?\n\t") for _ in range(rng.randrange(80)))
        assert b"".join(paragraph_dedup.paragraphs(t)) == t
    long = "one two three four five six"
    df = spark.createDataFrame([(None, long), (4, long), (4, long), (5, long)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in paragraph_dedup.digests(df).collect()) == [(0, 0), (4, 0), (4, 0), (5, 1)]
    assert paragraph_dedup.digests(df.limit(0)).count() == 0


def test_very_long_near_copies(spark):
    words = [f"w{i % 9973}x{i}" for i in range(200_000)]
    other = [*words[:1000], "changed", *words[1001:]]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, [" ".join(words), "short text of its own here", " ".join(other)])).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (0, 1)}

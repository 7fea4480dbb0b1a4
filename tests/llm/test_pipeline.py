"""The whole pipeline, and single stages, against brute force on a small folder."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near import closed, grams, jaccard
from tests.llm.test_suffix import brute


def texts():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("the", "and", "in", "for", "wa", "st") for b in ("ter", "ing", "ed", "lo", "mi", "sa", "re", "on")]
    draw = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    out = [" ".join(draw(rng.randrange(20, 120))) for _ in range(40)]
    passage = " ".join(draw(30))
    for k in range(12):
        out.append(f"{' '.join(draw(25))} {passage} {' '.join(draw(25))}")
    for k in range(10):  # near copies, exact copies but for white space
        w = out[k].split(" ")
        w[len(w) // 2] = "changed"
        out += [" ".join(w), out[k].replace(" ", "\n"), out[k] + " "]
    return [*out, None, "", "12345 %%% ...", "\n\n"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = {i: t for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    best = {}
    for i, t in docs.items():
        key = "".join(t.split())
        best[key] = min(best.get(key, (1, 0, 0)), (-len(t), i)) if key in best else (-len(t), i)
    docs = {i: docs[i] for i in sorted(x[1] for x in best.values())}
    ids, sets = list(docs), [grams(t) for t in docs.values()]
    root = closed(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    docs = {ids[k]: docs[ids[k]] for k, r in enumerate(root) if k == r}
    docs = {i: kept.decode("utf-8", "ignore") for i, *_, kept in brute(list(docs.items()), 50) if kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(slow.encode(t, add_special_tokens=False).ids) + 1) for i, t in docs.items())
    n = {}
    for r in got:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["length"]
    assert sorted(n.items()) == want
    ends = {}
    for r in got:
        ends[r["sequence_id"]] = max(ends.get(r["sequence_id"], 0), r["offset"] + r["length"])
    assert max(ends.values()) <= 1024 and sum(ends.values()) == sum(n.values())


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(2, "one two three", "en", "a", 13), (1, "one  two three", None, None, None), (None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [(r["doc_id"], r["text"]) for r in docs.collect()] == [(1, "one  two three")]


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    w = [f"word{i}" for i in range(60)]
    near = " ".join([*w[:30], "changed", *w[31:]])
    a, b, c, d = " ".join(w), "some clean text that nobody else has at all", "another clean text without an id of its own", " ".join(f"other{i}" for i in range(60))
    changed = d.replace("other30", "changed")
    rows = [(None, b), (None, c), (None, c), (5, a), (5, a), (5, d), (7, near), (None, near), (3, changed), (8, d + " ")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    order = lambda rows: sorted(((r["doc_id"] or 0, r["text"]) for r in rows))
    first = corpus_pipeline.copies(spark, docs, "")
    assert order(first.collect()) == sorted([(0, b), (0, c), (5, a), (7, near), (3, changed), (8, d + " ")])
    want = sorted([(0, b), (0, c), (5, a), (3, changed)])
    assert order(corpus_pipeline.near_copies(spark, first, "").collect()) == want
    assert order(corpus_pipeline.near_copies(spark, docs, "").collect()) == want  # 5 has a text that goes and one that stays


def test_columns_with_the_names_that_stages_use(spark):
    names = ["a.b", "`", "a`.b", "_1", "score", "lang_pred", "text_sha256", "kept", "rest", "_key", "_row", "key", "n", "place", "row", "chunk"]
    w = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, w, "en", "s", len(w), *names), (2, w + " ", "en", "s", 1, *names), (3, None, "en", "s", 0, *names)], ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"`{x.replace('`', '``')}` string" for x in names)]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[x] == x for r in rows for x in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 3
    none = docs.limit(0)
    assert all(stage(spark, none, "").count() == 0 for _, stage in corpus_pipeline.STAGES)

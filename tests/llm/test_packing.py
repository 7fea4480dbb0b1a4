"""Packing: exact ids, gapless sequences and few of them."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strataform.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, length int")


def check(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_pieces_are_the_library_s_ids(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "x<|endoftext|>y", "é中 \n\t  ok", " ".join(rng.choice(["the", "tion", "Haus"]) for _ in range(4000))]
    texts += [" ".join(f"w{rng.randrange(99999)}" for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    rows = packing.pack_documents(docs(spark, texts), PATH).collect()
    slow = Tokenizer.from_file(PATH)
    for d, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        for k, r in enumerate(own):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and (k == 0 or r["length"] == 1024)
    check(rows, 1024)


def test_few_sequences(spark):
    rng = random.Random(2)
    for draw in (lambda: rng.randrange(1, 1025), lambda: rng.choice([1, 2, 3, 40, 700]), lambda: 513, lambda: min(1024, int(rng.expovariate(1 / 90)) + 1)):
        sizes = [draw() for _ in range(4000)]
        table = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").coalesce(3)
        rows = packing.pack(table).collect()
        assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(sizes))
        least = max(-(-sum(sizes) // 1024), sum(n > 512 for n in sizes))
        assert check(rows, 1024) <= least * 1.01 + 2


def test_no_rows(spark):
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_plan_parts():
    assert packing.group_lengths({10: 2, 9: 2, 8: 1}, 2) == {10: 10, 9: 10, 8: 8}
    plan = packing.configurations({7: 3, 3: 3, 5: 1}, 10)
    assert sum(t for _, t in plan) == 4
    placed, rest = packing.best_fit({5: 1, 3: 2}, {3: 2, 2: 2, 9: 1})
    assert rest == {9: 1} and sum(p[1] for p in placed) == 3 + 1

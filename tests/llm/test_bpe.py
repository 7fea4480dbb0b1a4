"""Byte-level BPE against the tiktoken library; appends, edits and round trips are exact."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strataform.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
OTHER = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_pattern():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab \n\t'sé中\x1c\x85\u3000123.", max_size=80)))
def test_equals_the_library(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    e = bpe.encoder(PATH)
    ids = e.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == OTHER.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


def test_appends_and_edits():
    rng, v = random.Random(4), bpe.load(PATH)
    for _ in range(60):
        data = bytes(rng.choice(b"the tion  ing\xc3\xa9abc") for _ in range(rng.randrange(1, 50)))
        p = bpe.Prefixes(v)
        for i in range(0, len(data), 3):
            p.append(data[i : i + 3])
        assert p.ids() == bpe.Prefixes(v, data).ids() == OTHER._encode_single_piece(data) or RANKS.get(data) is not None
        a = rng.randrange(len(data))
        b = rng.randrange(a, len(data) + 1)
        p.edit(a, b, b"xyz")
        assert p.ids() == bpe.Prefixes(v, data[:a] + b"xyz" + data[b:]).ids()


def test_table(spark):
    texts = [None, "", "a", "Hello  world\n\n", "x" * 5000, "é中 \x1c " * 200]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, "a", 1), (None, "b", 1)], "doc_id bigint, text string, n_tokens int")
    rows = bpe.bpe_digests(df, PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = "b" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = np.array(OTHER.encode_ordinary(t), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode_table(bpe.encode_table(df, PATH), PATH).filter("doc_id = 5").first()
    assert bytes(back["bytes"]).decode() == texts[5]
    assert bpe.bpe_digests(df.limit(0), PATH).count() == 0

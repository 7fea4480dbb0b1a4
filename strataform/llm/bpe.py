"""Byte-level BPE by dynamic programming over prefixes.

Each prefix of a byte string has one valid last token: the one whose rest, a shorter prefix, ends in a token that
stays apart from it. Keeping that token for every prefix makes appending exact (old entries never change) and lets
an edit be encoded again from the place where it begins.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm._shared import text_slices

#: The pattern that splits a text before merging: a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of encoded words that a worker keeps, about, twice at most; and pairs of tokens whose border it remembers.
CACHED, PAIRS = 96 << 20, 600_000


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.reach: dict[bytes, int] = {}  # of the last two bytes, the longest token that ends in them
        for token in ranks:
            self.reach[token[-2:]] = max(self.reach.get(token[-2:], 1), len(token))
        self._edges: dict[int, tuple[list, list]] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def _merges(self, data: bytes) -> list[tuple[bytes, bytes]]:
        """The pairs merged, in order: the lowest-ranked adjacent pair first, leftmost of equals. BPE is defined by this."""
        parts, done = [data[i : i + 1] for i in range(len(data))], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return done

    def edges(self, token: int) -> tuple[list, list] | None:
        """How the token's first and last part grow while it is merged, as (part, rank of the merge that takes it in); None if merging doesn't give the token."""
        if token not in self._edges:
            data = self.bytes_of[token]
            done = self._merges(data)
            if len(done) != len(data) - 1:
                self._edges[token] = None
                return None
            head, tail = [], []
            parts = [data[i : i + 1] for i in range(len(data))]
            for a, b in done:
                rank = self.ranks[a + b]
                at = next(i for i in range(len(parts) - 1) if parts[i] == a and parts[i + 1] == b)
                if at == 0:
                    head.append((parts[0], rank))
                if at == len(parts) - 2:
                    tail.append((parts[-1], rank))
                parts[at : at + 2] = [a + b]
            self._edges[token] = ([*head, (data, 1 << 60)], [*tail, (data, 1 << 60)])
        return self._edges[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b, side by side, as they are: no pair across the border ever ranks below what its parts merge into."""
        found = self._apart.get((a, b))
        if found is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            left, right, i, j, found = self.edges(a)[1], self.edges(b)[0], 0, 0, True
            while found:
                (x, up), (y, over) = left[i], right[j]
                across = self.ranks.get(x + y, 1 << 60)
                if across < up and across <= over:
                    found = False
                elif up == over == 1 << 60:
                    break
                elif up <= over:
                    i += 1
                else:
                    j += 1
            self._apart[a, b] = found
        return found


class Prefixes:
    """The last token of every prefix of a byte string, which append() and edit() keep up to date."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, start = self.vocabulary, len(self.data)
        self.data += more
        token_of, reach, known, data, last = v.ranks.get, v.reach.get, v._apart.get, self.data, self.last
        for end in range(start + 1, len(data) + 1):
            for size in range(min(end, reach(data[max(0, end - 2) : end], 1)), 0, -1):
                token = token_of(data[end - size : end])
                if token is None:
                    continue
                if size == end:
                    fits = v.edges(token) is not None
                else:
                    fits = known((before := last[end - size - 1], token))
                    if fits is None:
                        fits = v.edges(token) is not None and v.apart(before, token)
                if fits:
                    last.append(token)
                    break

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; entries before `start` are kept."""
        rest = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(rest)

    def ids(self) -> list[int]:
        at, out = len(self.data), []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


@cache
def load(path: str) -> Vocabulary:
    """A vocabulary file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f)})


class Encoder:
    """Encodes texts word by word; a word that is a token is that token."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.vocabulary, self.split = load(path), regex.compile(pattern).findall
        self.known, self.older, self.held = {}, {}, 0

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            data = word.encode("utf-8", "replace")
            token = self.vocabulary.ranks.get(data)
            ids = [token] if token is not None else Prefixes(self.vocabulary, data).ids()
            found = pack(f"<{len(ids)}I", *ids)
        self.held += len(word) + len(found) + 150
        if self.held > CACHED:  # rare words go, words met since stay
            self.known, self.older, self.held = {}, self.known, 0
        self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, word = self.known, self._word
        out = []
        for x in self.split(text):
            got = known.get(x)
            if got is None:
                got, known = word(x), self.known
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it has learned outlives a task."""
    return Encoder(path)


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every text."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for at, to, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([e.encode(x or "") for x in texts], pa.binary())], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("ids", "binary"))


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, encoded.select("doc_id").schema.add("bytes", "binary"))


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, in one pass without a shuffle.

    A null text counts as empty: no tokens, digests of nothing. Repeated rows each get a row.
    """

    def run(batches):
        e = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in (x for *_, texts in text_slices(batch, "text") for x in texts):
                ids = e.encode(text or "")
                n.append(len(ids) // 4), a.append(hashlib.sha256(ids).hexdigest()), b.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))

"""Personal data: patterns, and the words whose company in the corpus gives a person away."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm._shared import INVERSE, LOWER, cut, looked_up, mix, powers, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of a protected value that count as its company.
WINDOW = 5
#: Different surroundings in which a word must accompany a value, and the share of the value's information that the word
#: must give away to be generalised, or removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.98
#: Bits of the filter that tells which words may matter, for each of them, and at most.
BITS, MOST_BITS = 16, 1 << 27

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
#: The bytes of words: digits, letters and whatever isn't ASCII.
_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


def _luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else _DOUBLED[int(c)] for k, c in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str):
    """What the pattern finds, in a time that follows the text's length: a name reaches back from each @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [(0, s, e) for s, e in _emails(text)]
    if not any(d in text for d in "0123456789"):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) < 3 or (len(x) == 3 and int(x) < 256) for p in m.groups())]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := _DIGITS.sub("", m.group())) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


def _value(kind: int, text: str) -> bytes:
    """A protected value, however it is written."""
    return bytes([kind]) + (text.lower() if kind < 2 else _DIGITS.sub("", text)).encode()


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and 64-bit name of every word, A-Z lower-cased."""
    flat = LOWER[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(flat) + 2, np.int8)
    inside[1:-1] = _WORD[flat]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(len(flat)), out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * powers(len(flat), INVERSE)[start])


def _points(data: bytes) -> np.ndarray:
    """The byte at which each code point begins, and the number of bytes."""
    flat = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))


def _free(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words touch none of the spans (bytes)."""
    cover = np.zeros(len(start), bool)
    for a, b in spans:
        cover[np.searchsorted(end, a, "right") : np.searchsorted(start, b)] = True
    return ~cover


def company(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW) -> dict[int, np.ndarray]:
    """For each protected value of a text, and 0 for all of them, the names of the words around it."""
    data = text.encode()
    points = _points(data)
    places = [(int(points[s]), int(points[e])) for _, s, e in spans]
    start, end, names = _words(data)
    free = _free(start, end, places)
    start, end, names = start[free], end[free], names[free]
    near: dict[int, list] = {0: []}
    for (kind, s, e), (a, b) in zip(spans, places):
        i, j = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b))
        around = [names[max(0, i - window) : i], names[j : j + window]]
        near.setdefault(_signed(blake2b(_value(kind, text[s:e]), digest_size=8).digest()) or 1, []).extend(around)
        near[0] += around
    return {k: np.unique(np.concatenate(v)) for k, v in near.items()}


def _surroundings(docs: DataFrame, window: int) -> DataFrame:
    """(entity, seen, terms) of every document and each protected value in it; seen names the set of words around it."""

    def find(batches):
        for batch in batches:
            for _, _, texts in text_slices(batch, "text"):
                entities, seen, terms = [], [], []
                for text in texts:
                    if text and (spans := base_spans(text)):
                        for entity, names in company(text, spans, window).items():
                            entities.append(entity), terms.append(names.view(np.int64))
                            seen.append(_signed(blake2b(names.tobytes(), digest_size=8).digest()))
                flat = np.concatenate(terms) if terms else np.empty(0, np.int64)
                offsets = np.cumsum([0, *map(len, terms)])
                yield pa.RecordBatch.from_arrays([pa.array(entities, pa.int64()), pa.array(seen, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["entity", "seen", "terms"])

    return docs.select("text").mapInArrow(find, "entity long, seen long, terms array<bigint>")


def _slots(names: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the filter for each name."""
    h = mix(names.view(np.uint64))
    return np.concatenate((h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits))).astype(np.int64)


def _filter(terms: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of terms (term); collects its bits, MOST_BITS at most, in pieces of 4 KB."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (n * BITS).bit_length()))

    def places(batches):
        for batch in batches:
            at = _slots(batch.column("term").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], ["piece", "bit"])

    out = np.zeros(bits >> 3, np.uint8)
    pieces = terms.mapInArrow(places, "piece int, bit long").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    for piece, got in pieces.toLocalIterator():
        out[piece << 12 : (piece + 1) << 12] = np.frombuffer(got, np.uint8)
    return out


def _spans_and_words(docs: DataFrame, bloom: np.ndarray | None, keep_text: bool) -> DataFrame:
    """docs (doc_id, text) with base (kind, start, end), and words (term, start, end): those that the filter lets through."""
    held = docs.sparkSession.sparkContext.broadcast(bloom)
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    word = pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    names = ["doc_id", *(["text"] if keep_text else []), "base", "words"]

    def find(batches):
        bits = held.value
        for batch in batches:
            for at, to, texts in text_slices(batch, "text"):
                base = [base_spans(x or "") for x in texts]
                words: list[list] = [[] for _ in texts]
                if bits is not None:
                    data = [(x or "").encode() for x in texts]
                    firsts = np.cumsum([0, *(len(x) + 1 for x in data)])
                    start, end, terms = _words(b"\n".join(data))
                    slots = _slots(terms, len(bits) << 3).reshape(2, -1)
                    hit = np.flatnonzero((bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).all(axis=0))
                    owner = np.searchsorted(firsts, start[hit], "right") - 1
                    for k in np.unique(owner).tolist():
                        points, own = _points(data[k]), hit[owner == k]
                        a, b = start[own] - firsts[k], end[own] - firsts[k]
                        free = _free(a, b, [(int(points[s]), int(points[e])) for _, s, e in base[k]])
                        words[k] = [{"term": int(t), "start": int(s), "end": int(e)} for t, s, e in zip(terms[own][free].view(np.int64), np.searchsorted(points, a[free]), np.searchsorted(points, b[free]))]
                rest = [batch.column(x).slice(at, to - at) for x in names[:-2]]
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, pa.list_(span)), pa.array(words, pa.list_(word))], names)

    fields = lambda first, kind: T.ArrayType(T.StructType([T.StructField(first, kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = T.StructType([f for f in docs.schema if keep_text or f.name != "text"]).add("base", fields("kind", T.IntegerType())).add("words", fields("term", T.LongType()))
    return docs.mapInArrow(find, kind)


def disclosing(docs: DataFrame, n_docs: int, window: int = WINDOW, support: int = SUPPORT, share: float = GENERALISE) -> DataFrame:
    """Pairs of a protected value and a word (entity, term, together, n_entity) that may give away `share` of the value's information.

    together: documents in which the word is within `window` words of the value, in `support` different surroundings at
    least, so copies of one text aren't evidence. A word's documents are known only near protected values here; as it
    comes in no fewer, none that matters is missing.
    """
    near = cut(_surroundings(docs, window))
    each = near.groupBy("entity", "seen").agg(F.count(F.lit(1)).alias("n"), F.any_value("terms").alias("terms"))
    pairs = cut(each.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("together")))
    entities = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    anywhere = pairs.filter("entity = 0").select("term", F.col("together").alias("n_near"))
    known = looked_up(cut(pairs.filter(f"entity <> 0 AND kinds >= {support}").select("entity", "term", "together")), entities, "entity")
    return looked_up(cut(known), anywhere, "term").filter(_gives("n_near", n_docs) >= share).select("entity", "term", "together", "n_entity")


def _gives(n_term: str, n_docs: int):
    """Pointwise mutual information of a value and a word as a share of the value's information; null for a value that every document has."""
    rare = F.log(F.col("n_entity") / n_docs)
    return F.when(rare < 0, 1 - F.log(F.col("together") / F.col(n_term)) / rare)


def sanitisation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, share: float = GENERALISE, keep_text: bool = False) -> DataFrame:
    """For each row of docs: doc_id, base (kind, start, end: 0 email, 1 ip, 2 card, 3 phone, by kind and start), terms (start, end, gives by start) and, if asked for, text.

    terms are words that give away `share` or more of the information of a protected value anywhere in the corpus: with
    p the share of documents, log(p(value | word) / p(value)) / -log(p(value)), the word being within `window` words
    of the value in documents of `support` different surroundings. Places are code points, ends exclusive. Words are runs
    of digits, letters and characters beyond ASCII, A-Z lower-cased, outside of base spans; told apart by 64-bit names.
    A null or empty text has no spans. Rows are counted one by one, so repeated rows and ids count as often as they come;
    no rows give none; other columns are ignored. Texts of any length are read whole. A value or a word in a third of
    all documents is counted in parts and met by a broadcast row.
    """
    own = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    n_docs = own.count()
    pairs = cut(disclosing(own, n_docs, window, support, share))
    maybe = cut(pairs.select("term").distinct())
    n = maybe.count()
    found = cut(_spans_and_words(own, _filter(maybe, n) if n else None, keep_text)).withColumn("_row", F.monotonically_increasing_id())
    each = found.filter(F.size("words") > 0).select("_row", F.explode("words").alias("w")).select("_row", "w.*")
    counts = each.select("_row", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    worst = looked_up(pairs, counts, "term").withColumn("gives", _gives("n_term", n_docs)).filter(F.col("gives") >= share).groupBy("term").agg(F.max("gives").alias("gives"))
    told = looked_up(cut(each), cut(worst), "term").filter(F.col("gives").isNotNull())
    terms = told.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "gives"))).alias("terms"))
    none = F.array().cast(terms.schema["terms"].dataType)
    some = found.filter(F.size("words") > 0).join(terms, "_row", "left").withColumn("terms", F.coalesce("terms", none))
    rest = found.filter(F.size("words") == 0).withColumn("terms", none)
    return some.unionByName(rest).select("doc_id", *(["text"] if keep_text else []), "base", "terms")


def sanitised(docs: DataFrame, remove: float = REMOVE, **how) -> DataFrame:
    """doc_id and text of every row: values are replaced by [their kind], words that give values away by what they are ([number], [name] if they begin with a capital, else [word]), or removed if they give away `remove` of the information."""
    found = sanitisation(docs, keep_text=True, **how)

    def clean(batches):
        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(x).to_pylist() for x in ("text", "base", "terms"))):
                if text is None:
                    out.append(None)
                    continue
                spans = [(x["start"], x["end"], f"[{KINDS[x['kind']]}]") for x in base]
                for x in terms:
                    word = text[x["start"] : x["end"]]
                    spans.append((x["start"], x["end"], "" if x["gives"] >= remove else "[number]" if word.isdigit() else "[name]" if word[0].isupper() else "[word]"))
                parts, at = [], 0
                for s, e, what in sorted(spans, key=lambda x: (x[0], -x[1])):
                    if s >= at:  # of values that overlap the first counts
                        parts += [text[at:s], what]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return found.mapInArrow(clean, found.select("doc_id", "text").schema)


def digests(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, a count a kind, a digest of the base spans, and all spans (terms last)."""
    found = sanitisation(docs)
    kind = f"element_at(array({', '.join(map(repr, KINDS))}), x.kind + 1)"
    base = f"transform(base, x -> concat({kind}, ':', x.start, ':', x.end))"
    counts = (F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS))
    spans = F.expr(f"array_join(concat({base}, transform(terms, x -> concat('term:', x.start, ':', x.end))), ',')")
    return found.select("doc_id", *counts, F.sha2(F.expr(f"array_join({base}, ',')"), 256).alias("base_sha256"), spans.alias("spans"), F.size("terms").cast("long").alias("n_terms"))

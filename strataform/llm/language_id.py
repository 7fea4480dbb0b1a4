"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataform.llm._shared import cut, text_slices

#: N-grams in a profile.
TOP = 300
_PAD = 0x1FFFFF


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(texts: list[str]):
    """For each text the codes of its n-grams of one to three letters, in increasing order, and how often each comes.

    Letters are lower-cased; whatever stands between letters is one boundary mark, which two- and three-grams may
    begin or end with. Codes sort alike in every call: by length, then by code points.
    """
    flat = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(flat == 0) if not any("\0" in x for x in texts) else None
    if ends is None:
        return [g for x in texts for g in _grams([x.replace("\0", " ")])]
    flat = np.where(_letters()[flat], flat, 0)
    keep = (flat != 0) | (np.concatenate(([1], flat[:-1])) != 0)
    keep[ends] = True
    place = np.cumsum(keep) - 1
    flat, ends = flat[keep], place[ends]
    seen = np.flatnonzero(np.bincount(flat, minlength=1))
    size = len(seen)
    small = np.zeros(int(seen[-1]) + 1 if size else 1, dtype=np.int64 if size**3 + size**2 + size >= 1 << 31 else np.int32)
    small[seen] = np.arange(size)
    a = small[flat]
    two = size + a[:-1] * size + a[1:]
    three = size + size * size + (a[:-2] * size + a[1:-1]) * size + a[2:]
    points = seen.astype(np.int64)
    out = []
    for s, e in zip(ends[:-1], ends[1:]):  # flat[s] and flat[e] are the marks around the text
        own = a[s + 1 : e]
        own = own[own > 0]
        if not len(own):
            out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        middle = three[s : e - 1]
        pairs = two[s:e]
        codes, counts = np.unique(np.concatenate((own, pairs[pairs > size], middle[(middle - size - size * size) // size % size > 0])), return_counts=True)
        one, up = codes < size, codes < size + size * size
        x, y, z = codes - size - size * size, codes - size, codes
        real = np.where(one, points[np.where(one, z, 0)] << 42 | _PAD << 21 | _PAD, np.where(up, points[np.where(up, y // size, 0) % size] << 42 | points[y % size] << 21 | _PAD, points[np.where(up, 0, x // (size * size))] << 42 | points[x // size % size] << 21 | points[x % size]))
        out.append((real, counts))
    return out


def _best(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The codes of the most frequent n-grams; of two as frequent, the one that sorts first."""
    return codes[np.argsort(-counts, kind="stable")[:TOP]]


#: N-grams that a task holds while it counts.
FOLD = 1 << 19


def _folded(got: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of several texts, and how often each comes."""
    codes, which = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    return codes, np.bincount(which, weights=np.concatenate([x[1] for x in got])).astype(np.int64)


def _counts(held: dict):
    for lang, got in held.items():
        codes, sums = _folded(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], ["lang", "gram", "n"])


def train(docs: DataFrame) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, in order; docs: (text, lang), whole texts. Collects TOP rows a language."""

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, to, texts in text_slices(batch, "text"):
                for lang, got in zip(langs[at:to], _grams(texts)):
                    held.setdefault(lang, []).append(got)
                    size += len(got[0])
                if size > FOLD:
                    held = {lang: [_folded(got)] for lang, got in held.items()}
                    size = sum(len(got[0][0]) for got in held.values())
                if size > FOLD // 2:  # more distinct n-grams than are held at once
                    yield from _counts(held)
                    held, size = {}, 0
        yield from _counts(held)

    each = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    total = each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = total.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP).select("lang", "place", "gram").collect()
    profiles: dict[str, list[int]] = {}
    for lang, _, gram in sorted(rows):
        profiles.setdefault(lang, []).append(gram)
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep_text: bool = False) -> DataFrame:
    """docs' columns (without text, unless it is kept), lang_pred and score: 1 less the text's out-of-place distance to the nearest profile, as a share of the largest possible one.

    `und` and 0 if the text is null or has no letter, or nothing was learned. Of languages as near, the first by name.
    """
    langs = sorted(profiles)
    known = np.unique(np.array([g for x in langs for g in profiles[x]], dtype=np.int64))
    places = np.full((len(known) + 1, max(1, len(langs))), TOP * 2, dtype=np.int64)  # the last row: not in a profile
    for k, lang in enumerate(langs):
        places[np.searchsorted(known, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def guess(batches):
        for batch in batches:
            pred, score = [], []
            for _, _, texts in text_slices(batch, "text"):
                for got in _grams([x or "" for x in texts]):
                    own = _best(*got)
                    if not len(own) or not langs:
                        pred.append("und"), score.append(0.0)
                        continue
                    where = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    where = np.where(known[where] == own, where, len(known))
                    far = np.minimum(np.abs(places[where] - np.arange(len(own))[:, None]), TOP).sum(axis=0)
                    k = int(np.argmin(far))
                    pred.append(langs[k]), score.append(float(1 - far[k] / (TOP * len(own))))
            names = [x for x in batch.schema.names if keep_text or x != "text"]
            rest = [batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    kind = T.StructType([f for f in docs.schema if keep_text or f.name != "text"]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(guess, kind)


def in_fold(doc_id, folds: int, held: int):
    """Whether crc32 of the id as text leaves `held` of folds; true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(True))


def with_language(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """docs (doc_id, text, lang, ...) with lang_pred and score; repeated column names aren't allowed, others pass through."""
    learned = docs.filter(~in_fold(F.col("doc_id"), folds, held)).select("text", "lang")
    return predict(docs, train(learned), keep_text=True)


def identified(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) in which a language can be told, as they are, whatever other columns are called."""
    names = docs.columns
    plain = docs.toDF(*(x if x == "text" else f"_{k}" for k, x in enumerate(names)))
    learned = docs.filter(~in_fold(F.col("doc_id"), folds, held)).select("text", "lang")
    told = predict(plain, train(learned), keep_text=True).filter(F.col("lang_pred") != "und")
    return told.select(*(x if x == "text" else f"_{k}" for k, x in enumerate(names))).toDF(*names)


def language_id(docs: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; profiles learned from the rows not held out.

    A row is held out if crc32(doc_id as text) mod folds is `held`; one with a null doc_id is held out as well.
    Rows without text or lang teach nothing; repeated rows count as often as they come. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), "text", "lang").withColumn("held_out", in_fold(F.col("doc_id"), folds, held))
    return predict(own.select("doc_id", "held_out", "text"), train(own.filter(~F.col("held_out"))))

"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every word that was learned is a context with a Chinese restaurant of its own: its customers are the words that follow
it, and each of its tables is a customer of the parent restaurant, which all contexts share. Tables of the parent draw
from the uniform base over the vocabulary and one unknown word.

Seatings are sampled by Gibbs, all customers of one dish of a restaurant at a time: how many tables they take is drawn
from its distribution given the other tables of the restaurant and the dish's probability at the parent. In a round
every context does so, then the parent, which the contexts see in the next round: sums are one round old, as in other
distributed samplers. The first rounds are thrown away; predictive probabilities are averaged over the rest.

Word pairs and words are counted in buckets, by 64-bit names. A chunk of documents asks a bucket once for each name
that it holds, and gets its answers in the order of its questions. Random numbers are hashes of a pair's name and the
round, so every chunk that holds a pair draws the same seating; one of them reports it. Texts are read once: each chunk
keeps its distinct words, frequent ones first, and its tokens as numbers of them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm._exchange import REPLY, Split, bucketed, from_planes, from_small, in_chunks, planes, runs, small, small_columns
from strataform.llm._shared import cut, drop, mix, slices, words

#: Text in a chunk, about.
CHUNK = 4 << 20
DISCOUNT, STRENGTH = 0.75, 5.0
#: Rounds of sampling, and how many of them, the last ones, are averaged.
ROUNDS, SAMPLES = 6, 3
END = int(mix(np.array([1], dtype=np.uint64))[0])
#: Customers of a dish up to which the distribution of their tables is tabulated; beyond, its saddle point gives mean and variance.
TABULATED = 100
#: Numbers of tables whose weights are multiplied before they are scaled.
PLAIN = 16
#: Dishes that are drawn together, if no more than a quarter more customers are among them: fewer don't pay for the steps.
TOGETHER = 4096
#: A share of the weights that is far below what a random number of 53 bits can tell.
_NONE = 1e-18
_DEALT = "bucket int, chunk int, values binary"
_TOTALS = ("vocabulary", "learned", "customers", "tables")
_ANSWER = ", ".join((REPLY, *(f"{x} double" for x in _TOTALS)))


@cache
def _log_seatings(discount: float, most: int = TABULATED) -> np.ndarray:
    """[c, t]: the log of the summed weights of all seatings of c customers of one dish at t tables (generalised Stirling numbers)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            t = np.arange(1, c + 2)
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - discount * t, 0)) + out[c, t])
    return out


@cache
def _ratios(discount: float) -> np.ndarray:
    """[t - 1, c]: how much more t + 1 tables of c customers weigh than t; 0 where there can't be so many."""
    seatings, out = _log_seatings(discount), np.zeros((TABULATED - 1, TABULATED + 1))
    for c in range(2, TABULATED + 1):
        out[: c - 1, c] = np.exp(np.diff(seatings[c, 1 : c + 1]))
    return out


def _noise(names: np.ndarray, round_: int, which: int) -> np.ndarray:
    """Uniform in (0, 1), the same for a name and round wherever it is drawn."""
    return ((mix(names + np.uint64((round_ * 8 + which) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)) + np.uint64(1)).astype(float) / (2.0**53 + 1)


def draw_tables(names: np.ndarray, round_: int, c: np.ndarray, rest: np.ndarray, p: np.ndarray, discount: float = DISCOUNT, strength: float = STRENGTH) -> np.ndarray:
    """Tables of c customers of one dish each, drawn given `rest` tables of other dishes in the restaurant and the dish's probability p at the parent."""
    c = c.astype(np.int64)
    size = np.minimum(c, TABULATED + 1).astype(np.uint8)
    if (size[1:] < size[:-1]).any():
        order, out = np.argsort(size, kind="stable"), np.empty_like(c)
        out[order] = draw_tables(names[order], round_, c[order], rest[order], p[order], discount, strength)
        return out
    out = np.minimum(c, 1)
    ends = np.cumsum(np.bincount(size, minlength=TABULATED + 2))  # of the dishes of so many customers
    at, end = int(ends[1]), int(ends[TABULATED])
    u = np.empty(len(c))
    u[at:] = _noise(names[at:], round_, 1)
    while at < end:
        k = int(size[at])
        to = int(ends[k])
        if to - at < TOGETHER:
            to = min(max(to, at + TOGETHER), int(ends[min(k * 5 // 4, TABULATED)]))
            k = int(size[to - 1])
        on = slice(at, min(to, at + (1 << 17) // k))
        same = size[at] == size[on.stop - 1]
        out[on] = _tabulated(u[on], rest[on], p[on], _ratios(discount)[: k - 1, [k] if same else size[on]], discount, strength)
        at = on.stop
    if end < len(c):
        big = slice(end, None)
        mean, deviation = seating_moments(c[big], rest[big], p[big], discount, strength)
        normal = np.sqrt(-2 * np.log(u[big])) * np.cos(2 * np.pi * _noise(names[big], round_, 2))
        out[big] = np.clip(np.rint(mean + deviation * normal), 1, c[big])
    return out


def _tabulated(u: np.ndarray, rest: np.ndarray, p: np.ndarray, ratios: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Tables of dishes with the given ratios: a row for each number of tables, its weights made from those before. Weights are divided by their sum every PLAIN rows, as products of so few factors stay within range; dishes for which all further ones together are too small to tell then go."""
    step, grow = (strength + discount * rest) * p, discount * p
    last = step + grow * len(ratios)
    on, weight, parts = slice(None), np.ones(len(p)), []
    while len(ratios):
        sums = np.empty((min(PLAIN, len(ratios)) + 1, len(weight)))
        sums[0] = 1
        for ratio, before, after in zip(ratios, sums, sums[1:]):
            step += grow
            weight *= step
            weight *= ratio
            np.add(before, weight, out=after)
        parts.append((on, sums))
        ratios = ratios[PLAIN:]
        if len(ratios):
            weight /= sums[-1]
            # If all factors that are left are at most a half, all weights that are left are less than the last one.
            left = np.flatnonzero((last * ratios.max(axis=0) > 0.5) | (weight > _NONE))
            if not len(left):
                break
            on = left if isinstance(on, slice) else on[left]
            step, grow, last, weight = step[left], grow[left], last[left], weight[left]
            ratios = ratios if ratios.shape[1] == 1 else ratios[:, left]
    want, out = u.copy(), np.ones(len(p), dtype=np.int64)
    for on, sums in reversed(parts):
        with np.errstate(over="ignore"):
            want[on] = here = want[on] * sums[-1]
        out[on] += (sums[:-1] < here).sum(axis=0, dtype=np.uint8)
    return out


def seating_moments(c: np.ndarray, rest: np.ndarray, p: np.ndarray, discount: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the tables of many customers of one dish.

    With a weight a for each table, seatings are a compound Poisson process held at c customers: a (1 - y^d) / d tables
    for the y at which a (1 - y) y^(d - 1) customers are expected, and one more, by the share of customers that join a
    table, since there is one at least. a is the weight of one table more than are found.
    """
    c = c.astype(float)
    tables, log_c, z = np.ones(len(c)), np.log(c), None  # z: log y, by Newton's method from the side on which it can't leave
    for _ in range(16):
        a = (strength + discount * (rest + tables)) * p
        if z is None:
            share = np.minimum(c / a, 1 - 1e-9)
            z = np.where(a > c, np.log1p(-share * (1 - share) ** (1 - discount)), np.minimum((np.log(a) - log_c) / (1 - discount), -1e-3))
        joined = -np.expm1(z)
        old = z, tables
        z = np.minimum(z - (np.log(a * joined) + (discount - 1) * z - log_c) / ((joined - 1) / joined + discount - 1), -1e-15)
        mean = a * -np.expm1(discount * z) / discount
        tables = np.clip(mean + 1 - mean / c, 1, c)
        if all(np.allclose(x, y, rtol=1e-13, atol=0) for x, y in zip(old, (z, tables))):
            break
    y = np.exp(z)
    fixed = np.maximum(mean - c * y / (y + (1 - y) * (1 - discount)), 1e-9)
    return tables, 1 / np.sqrt(np.maximum(1 / fixed - discount / (strength + discount * (rest + tables)), 0.05 / fixed))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each among them."""
    order = np.argsort(x)
    ordered = x[order]
    new = runs(ordered)
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _numbers(table: pa.Table, column: str, read) -> tuple[np.ndarray, list[int]]:
    """The numbers of all rows of a bucket, row after row, and how many each has."""
    parts = [read(x.as_buffer()) for x in table.column(column)]
    return np.concatenate(parts), [len(x) for x in parts]


def _names(data) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _reply(bucket: int, chunks, numbers: np.ndarray, sizes, totals=None) -> pa.Table:
    """Each chunk's answers (columns by names), in the order of its questions, and a row of chunk -1 for what the bucket adds to the totals."""
    ends = np.cumsum([0, *sizes])
    values = [small(numbers[:, a:b].ravel()) for a, b in zip(ends[:-1], ends[1:])]
    rows = len(values)
    if totals is not None:
        chunks, values = [*chunks, -1], [*values, None]
    told = {} if totals is None else {k: pa.array([None] * rows + [float(x)], pa.float64()) for k, x in zip(_TOTALS, totals)}
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([bucket] * len(values), pa.int32()), "values": pa.array(values, pa.binary())} | told)


def _row(**columns) -> pa.Table:
    """One row: numbers and bytes."""
    return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for k, v in columns.items()})


def _cell(table: pa.Table, column: str, kind, read=np.frombuffer) -> np.ndarray:
    return read(table.column(column)[0].as_buffer(), kind)


def _listed(values) -> pa.Array:
    """One row that holds a column's values as a list."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _of(found: pa.Table, kind: int) -> pa.Table:
    return found.filter(pc.equal(found.column("kind"), kind))


def score(
    docs: DataFrame, folds: int = 7, held: int = 2, discount: float = DISCOUNT, strength: float = STRENGTH, rounds: int = ROUNDS, samples: int = SAMPLES,
    by_token: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens: the words between ASCII white space, A-Z lower-cased, and one end. A row is held out, and not learned
    from, if crc32(doc_id as text) mod folds is `held`, or its doc_id is null. base_score: log10 of (c + 1) / (N + V + 1)
    summed over the tokens; score: log10 of the model's probability of the text. A null text counts as empty (the end
    token alone); rows that repeat a doc_id are learned from and scored each; no rows give none. by_token: also
    token_scores, the parts that score sums. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(True)))
    dealt, n_buckets = in_chunks(own, CHUNK)
    kind = own.schema["doc_id"].dataType.simpleString()
    seats = dict(discount=discount, strength=strength)

    def tokens(table):
        """The chunk's tokens in order, and how many each row has."""
        after, sizes = [], []
        data = table.column("text").to_pylist()
        for at, to in slices(np.array([len(x) for x in data])):
            hashes, first = words(data[at:to], lower=True)
            size = np.diff(first) + 1
            out = np.full(len(hashes) + to - at, END, dtype=np.uint64)
            here = np.ones(len(out), dtype=bool)
            here[np.cumsum(size) - 1] = False
            out[here] = hashes
            after.append(out), sizes.append(size)
        return np.concatenate(after), np.concatenate(sizes)

    def number(key, table):
        """The chunk's distinct words, frequent ones first, so that small numbers are many; how often each was learned; and the tokens as their numbers."""
        after, sizes = tokens(table)
        where, names = pd.factorize(after)
        order = np.argsort(-np.bincount(where), kind="stable")
        place = np.empty(len(order), dtype="<u2" if len(order) <= 1 << 16 else "<u4")
        place[order] = np.arange(len(order))
        where, names = place[where], names[order]
        train = ~np.array(table.column("held_out").to_pylist(), dtype=bool)
        n = np.bincount(where[np.repeat(train, sizes)], minlength=len(names))
        rows = {"ids": _listed(table.column("doc_id")), "held": _listed(table.column("held_out"))}
        row = _row(chunk=key[0].as_py(), sizes=sizes.astype("<i8").tobytes(), names=names.astype("<u8").tobytes(), n=small(n), tokens=planes(where))
        return pa.table({c: row.column(c) for c in row.column_names} | rows)

    numbered = dealt.repartition(n_buckets, "chunk").groupBy("chunk").applyInArrow(number, f"chunk int, sizes binary, names binary, n binary, tokens binary, ids array<{kind}>, held array<boolean>")
    chunks = bucketed(numbered, n_buckets, dealt=True)

    def by_chunk(*columns):
        return chunks.select("chunk", *columns).groupBy("chunk")

    def read(table):
        """The chunk's distinct words; for each token its place among them and that of the one before (the end, before a text's first); and the tokens of each row."""
        names = _cell(table, "names", "<u8")
        where = _cell(table, "tokens", "<u2" if len(names) <= 1 << 16 else "<u4", from_planes).astype(np.int64)
        prev = np.empty_like(where)
        prev[1:], prev[:1] = where[:-1], np.flatnonzero(names == END)
        return names, where, prev, _cell(table, "sizes", "<i8")

    def named(names, codes):
        """Names of pairs, and the places of both words: places of the first ones are in order."""
        u, w = np.divmod(codes, len(names))
        return mix(names[u] * np.uint64(0x9FB21C651E98DF25) ^ names[w]), u, w

    def count_words(key, table):
        names = _cell(table, "names", "<u8")
        return Split(names, n_buckets).rows(key[0].as_py(), names, n=from_small(table.column("n")[0].as_buffer()))

    def merge_words(key, table):
        """A bucket's words, how often each was learned, and which of them each chunk asks about."""
        names, sizes = _numbers(table, "names", _names)
        distinct, which = _distinct(names)
        n = np.bincount(which, weights=_numbers(table, "n", from_small)[0]).astype("<i8")
        return _row(bucket=key[0].as_py(), chunks=table.column("chunk").to_numpy().astype("<i4").tobytes(), sizes=np.array(sizes, "<i8").tobytes(), which=planes(which.astype("<u4")), names=distinct.tobytes(), n=n.tobytes())

    sent = by_chunk("names", "n").applyInArrow(count_words, "bucket int, chunk int, names binary, n binary").repartition(n_buckets, "bucket")
    asked = bucketed(sent.groupBy("bucket").applyInArrow(merge_words, "bucket int, chunks binary, sizes binary, which binary, names binary, n binary"), n_buckets, "bucket", dealt=True)

    def gather(table, found, round_, totals):
        """A bucket's words after a round: what contexts seated, and a seating of the parent. Before the first round a power of the customers guesses them, and how often a word was learned is told."""
        chunks, sizes, names, n = (_cell(table, x, d) for x, d in (("chunks", "<i4"), ("sizes", "<i8"), ("names", "<u8"), ("n", "<i8")))
        which = _cell(table, "which", "<u4", from_planes)
        if found is None:
            customers = tables = np.ceil(n**discount).astype(np.int64)
            own = np.minimum(n, 1)
        else:
            of = dict(zip(found.column("chunk").to_pylist(), found.column("values")))
            got = np.concatenate([from_small(of[c].as_buffer()).reshape(2, -1) for c in chunks.tolist()], axis=1)
            customers, tables = (np.bincount(which, weights=x, minlength=len(n)).astype(np.int64) for x in got)
            vocabulary, _, seated, top = totals
            rest = top * (1 - customers / max(seated, 1))
            own = draw_tables(names, round_, customers, rest, np.full(len(n), 1 / (vocabulary + 1)), **seats)
        told = np.stack((customers, own, tables) if found is not None else (n, customers, own, tables))
        return _reply(table.column("bucket")[0].as_py(), chunks, told[:, which], sizes, [(n > 0).sum(), n.sum(), customers.sum(), own.sum()])

    def summed(answers: DataFrame) -> np.ndarray:
        """The totals of all buckets: vocabulary, tokens, customers and tables of the parent."""
        return np.array([x or 0.0 for x in answers.agg(*map(F.sum, _TOTALS)).first()])

    answers = [cut(asked.groupBy("bucket").applyInArrow(lambda table: gather(table, None, 0, np.zeros(4)), _ANSWER))]
    totals = [summed(answers[0])]
    vocabulary, n_train = totals[0][:2]

    def of_parent(customers, own, sums) -> np.ndarray:
        """Words' probabilities at the parent."""
        return (customers - discount * own + (strength + discount * sums[3]) / (vocabulary + 1)) / (strength + sums[2])

    def seat(names, round_, c, u, w, n, tables, parent):
        """Tables of pairs, drawn by what the round before left."""
        return draw_tables(names, round_, c, tables[u] * (1 - c / np.maximum(n, 1)[u]), parent[w], **seats)

    def count_pairs(key, table):
        names, where, prev, sizes = read(table)
        codes, which = _distinct(prev * len(names) + where)
        train = ~table.column("held").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = np.bincount(which[np.repeat(train, sizes)], minlength=len(codes))
        pairs = named(names, codes)[0]
        return Split(pairs, n_buckets).rows(key[0].as_py(), pairs, n=n)

    def sum_pairs(key, table):
        """How often each pair was learned, twice that; and one more for the chunk that reports its seating."""
        table = table.sort_by("chunk")
        names, sizes = _numbers(table, "names", _names)
        n = _numbers(table, "n", from_small)[0]
        distinct, which = _distinct(names)
        sums = np.bincount(which, weights=n).astype(np.int64)
        learned = np.flatnonzero(n > 0)[::-1]
        first = np.full(len(distinct), -1)
        first[which[learned]] = learned  # of several the last one written, the first chunk's
        told = sums[which] * 2
        told[first[first >= 0]] += 1
        return _reply(key[0].as_py(), table.column("chunk").to_numpy(), told[None], sizes)

    counted = cut(by_chunk("names", "tokens", "sizes", "held").applyInArrow(count_pairs, "bucket int, chunk int, names binary, n binary").groupBy("bucket").applyInArrow(sum_pairs, REPLY))

    def known(kinds):
        """What buckets told of pairs (kind -1), and of words after some rounds."""
        out = counted.withColumn("kind", F.lit(-1))
        for k in kinds:
            out = out.unionByName(answers[k].filter("chunk >= 0").drop(*_TOTALS).withColumn("kind", F.lit(k)))
        return out

    def by_customers(pairs, c):
        """Pairs in the order in which they are drawn."""
        return pairs[np.argsort(np.minimum(c[pairs], TABULATED + 1).astype(np.uint8), kind="stable")]

    def state(key, table, found):
        """What a chunk needs to seat the pairs that it reports: those that were learned twice or more, and how many once, by word; and how often its words were learned. Words are numbered as answers come."""
        names, where, prev, _ = read(table)
        codes = np.sort(prev * len(names) + where)
        pairs, u, w = named(names, codes[runs(codes)])
        got = Split(pairs, n_buckets).answers(_of(found, -1))
        place = np.empty(len(names), np.int64)
        place[Split(names, n_buckets).order] = np.arange(len(names))
        u, w = place[u], place[w]
        c, mine = got >> 1, (got & 1).astype(bool)
        once, more = np.flatnonzero(mine & (c == 1)), by_customers(np.flatnonzero(mine & (c > 1)), c)
        sums = np.concatenate([np.bincount(x[once], minlength=len(names)) for x in (w, u)])
        n = small_columns(_of(found, 0), 4)[0][0]
        return _row(chunk=key[0].as_py(), names=pairs[more].tobytes(), u=planes(u[more].astype("<u4")), w=planes(w[more].astype("<u4")), c=small(c[more]), once=small(sums), n=small(n))

    told = known([0]).repartition(n_buckets, "chunk").groupBy("chunk")
    states = bucketed(by_chunk("names", "tokens", "sizes").cogroup(told).applyInArrow(state, "chunk int, names binary, u binary, w binary, c binary, once binary, n binary"), n_buckets, dealt=True)

    def reseat(table, found, round_, sums):
        found = found.sort_by("bucket")
        answer, sizes = small_columns(found, 4 if round_ == 1 else 3)
        customers, own, tables = answer[-3:]
        names, u, w = _cell(table, "names", "<u8"), _cell(table, "u", "<u4", from_planes), _cell(table, "w", "<u4", from_planes)
        c, once, n = (from_small(table.column(x)[0].as_buffer()) for x in ("c", "once", "n"))
        t = seat(names, round_, c, u, w, n, tables, of_parent(customers, own, sums))
        out = once.reshape(2, -1) + np.stack([np.bincount(x, weights=t, minlength=len(n)) for x in (w, u)]).astype(np.int64)
        ends = np.cumsum([0, *sizes])
        return pa.table({"bucket": found.column("bucket"), "chunk": found.column("chunk"), "values": pa.array([small(out[:, a:b].ravel()) for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    def in_round(f, k, sums):
        return lambda table, found: f(table, found, k, sums)

    for k in range(1, rounds + 1):
        before = answers[-1].filter("chunk >= 0").drop(*_TOTALS)
        sent = states.groupBy("chunk").cogroup(before.groupBy("chunk")).applyInArrow(in_round(reseat, k, totals[-1]), _DEALT)
        answers.append(cut(asked.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(in_round(gather, k, totals[-1]), _ANSWER)))
        totals.append(summed(answers[-1]))
        if len(answers) > samples + 2:  # the oldest round that no sample rests on; the first answers tell how often words were learned
            drop(answers[-samples - 2])
    drop(states), drop(asked)
    last = list(range(rounds - samples, rounds + 1))

    def value(table, found):
        names, where, prev, sizes = read(table)
        split = Split(names, n_buckets)

        def words_after(k):
            out = np.empty((3 if k else 4, len(names)), np.int64)
            out[:, split.order] = small_columns(_of(found, k), len(out))[0]
            return out

        n = words_after(0)[0]
        codes, which = _distinct(prev * len(names) + where)
        pairs, u, w = named(names, codes)
        c = Split(pairs, n_buckets).answers(_of(found, -1)) >> 1
        more = by_customers(np.flatnonzero(c > 1), c)
        of_more = pairs[more], c[more], u[more], w[more]
        p = samples * (c - discount * np.minimum(c, 1))
        before = None
        for k in last:
            customers, own, tables = words_after(k)[-3:]
            parent = of_parent(customers, own, totals[k])
            if before:
                t = seat(of_more[0], k, *of_more[1:], n, *before)
                p[more] -= discount * (t - 1)
                p += (strength + discount * tables)[u] * parent[w]
            before = tables, parent
        parts = np.log10(p / (samples * (strength + n))[u])[which]
        starts = np.cumsum(sizes) - sizes
        out = {
            "doc_id": table.column("ids").combine_chunks().flatten(), "held_out": table.column("held").combine_chunks().flatten(), "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64)[where], starts)), "train_tokens": pa.array(np.full(len(sizes), int(n_train))),
            "base_score": pa.array(np.add.reduceat(np.log10((n + 1) / (n_train + vocabulary + 1))[where], starts)), "score": pa.array(np.add.reduceat(parts, starts)),
        }
        if by_token:
            out["token_scores"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(where)), pa.int32()), pa.array(parts))
        return pa.table(out)

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return by_chunk("names", "tokens", "sizes", "ids", "held").cogroup(known(sorted({0, *last})).groupBy("chunk")).applyInArrow(value, schema + ", token_scores array<double>" * by_token)

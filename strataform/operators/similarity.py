"""Nearest vectors, similar pairs and overlapping token sets, compared block by block.

Rows are packed into blocks of a bounded number of vectors; tasks compare pairs of blocks as matrices and give only
what is asked for, so a group of any size is spread over tasks and no row is made for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import unit
from strataform.tables import large

BLOCK = 2048
#: Rows of a block where a task gives the few best of it for each query.
WIDE = 16384


def packed(df: DataFrame, group: Column, row_id: str, vector: str, size: int = BLOCK) -> DataFrame:
    """(grp, block, ids, vectors): each group's rows, about `size` to a block; vectors as little-endian doubles. Null vectors are left out."""
    own = df.filter(F.col(vector).isNotNull() & F.col(row_id).isNotNull()).select(group.alias("grp"), F.col(row_id).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    n = own.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    dealt = own.join(n, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks")

    def pack(table: pa.Table) -> pa.Table:
        x = np.array(table.column("v").to_pylist(), dtype="<f8")
        return pa.table({"grp": table.column("grp").slice(0, 1), "block": table.column("block").slice(0, 1), "ids": [table.column("id").to_numpy().astype("<i8").tobytes()], "vectors": [x.tobytes()]})

    kind = own.schema["grp"].dataType.simpleString()
    return dealt.groupBy("grp", "block").applyInArrow(pack, f"grp {kind}, block int, ids binary, vectors binary")


def _matrix(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<f8").reshape(len(i), -1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    return np.where(size > 1e-12, (x @ y.T) / np.where(size > 1e-12, size, 1), 0.0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T))


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


MEASURES = {"cosine": _cosines, "l2": _distances, "inner": _inner}


def top_between(queries: DataFrame, rows: DataFrame, k: int, row_id: str, vector: str, measure: str = "cosine") -> DataFrame:
    """(query_id, rank, row_id, score) of the k rows nearest to each query, one of its own id left out: by cosine, inner product or distance (score: its negative). Exact: every block of queries meets every block of rows; ties go to the smaller id."""
    score = MEASURES[measure]
    held = packed(rows, F.lit(0), row_id, vector)
    asked = packed(queries, F.lit(0), row_id, vector, 512).withColumnsRenamed({"ids": "q_ids", "vectors": "q", "block": "q_block"})

    def best(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (q_ids, q), (ids, x) = _matrix(r["q_ids"], r["q"]), _matrix(r["ids"], r["vectors"])
                s = np.round(score(q, x), 12)
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                order = np.array([np.lexsort((ids, -line))[:k] for line in s]).reshape(len(q), -1)
                value = np.take_along_axis(s, order, axis=1)
                keep = value > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1])[keep.ravel()]), pa.array(ids[order][keep]), pa.array(value[keep])], ["query_id", "row_id", "score"])

    # Every block of queries goes to every block of rows; blocks, not one key, are what the join deals out.
    n = held.groupBy("grp").agg((F.max("block") + 1).alias("n"))
    pairs = asked.join(n, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(held.drop("grp"), "block").select("q_ids", "q", "ids", "vectors")
    found = pairs.mapInArrow(best, "query_id bigint, row_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")


def apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The distance of each row of q to each row of x, by differences, column after column."""
    out = np.zeros((len(q), len(x)))
    for c in range(q.shape[1]):
        out += (q[:, c][:, None] - x[:, c][None, :]) ** 2
    return np.sqrt(out)


def _best(values: list[np.ndarray], ids: np.ndarray, on: np.ndarray, k: int) -> np.ndarray:
    """The places (of `on`) of the k least by values, one after another, then by id. Only places that tie for the last seats are sorted."""
    sure, rest, need = [], on, k
    for v in values:
        if len(rest) <= need:
            break
        x = v[rest]
        last = np.partition(x, need - 1)[need - 1]
        under, tie = (~np.isnan(x), np.isnan(x)) if np.isnan(last) else (x < last, x == last)
        sure.append(rest[under])
        need -= len(sure[-1])
        rest = rest[tie]
    some = np.concatenate((*sure, rest))
    return some[np.lexsort((ids[some], *(v[some] for v in reversed(values))))[:k]]


def best_between(queries: DataFrame, rows: DataFrame, k: int, group: str | None, row_id: str, vector: str, keys, by: int, others: bool = False) -> DataFrame:
    """(query_id, row_id, k0, k1, ..., rank) of each query's k best rows of its group; with `others` of those of another id.

    keys(q, x): matrices (queries by rows), of which the first `by` order the rows, least first; then the smaller id. Blocks of
    queries meet blocks of rows of their group; a task gives the k best of a block for each query.
    """
    at = lambda df: F.col(group) if group else F.lit(0)
    held = packed(rows, at(rows), row_id, vector, WIDE)
    asked = packed(queries, at(queries), row_id, vector, 512).withColumnsRenamed({"ids": "q_ids", "vectors": "q", "block": "q_block"})

    def best(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (q_ids, q), (ids, x) = _matrix(r["q_ids"], r["q"]), _matrix(r["ids"], r["vectors"])
                for a in range(0, len(q), 64):
                    values = keys(q[a : a + 64], x)
                    every = np.arange(len(ids))
                    best = [_best([v[i] for v in values[:by]], ids, np.flatnonzero(ids != q_ids[a + i]) if others else every, k) for i in range(len(values[0]))]
                    line, order = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
                    columns = [q_ids[a + line], ids[order], *(v[line, order] for v in values)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "row_id", *(f"k{i}" for i in range(len(values)))])

    n = held.groupBy("grp").agg((F.max("block") + 1).alias("n"))
    # Dealt to a fixed number of tasks: few bytes are much work here.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: large(df.repartition(parts, "grp", "block"))
    pairs = dealt(asked.join(n, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))).join(dealt(held), ["grp", "block"]).select("q_ids", "q", "ids", "vectors")
    width = len(keys(np.zeros((1, 64)), np.zeros((1, 64))))
    names = [f"k{i}" for i in range(width)]
    found = pairs.mapInArrow(best, ", ".join(["query_id bigint, row_id bigint", *(f"{c} double" for c in names)]))
    w = Window.partitionBy("query_id").orderBy(*names[:by], "row_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, asked: Column, k: int, row_id: str, vector: str, measure: str = "cosine") -> DataFrame:
    """top_between() of the rows that `asked` holds for and all rows."""
    return top_between(df.filter(asked), df, k, row_id, vector, measure)


def memory_rank(queries: DataFrame, nodes: DataFrame, edges: DataFrame, row_id: str, vector: str, k: int = 5) -> DataFrame:
    """(query_id, rank, row_id: the edge, score): edges (edge_id, from_id, weight) that say what was improved from what, by seven tenths of the cosine of the query and their start and three tenths of their weight.

    Both become one inner product: the unit vector by 0.7 with 0.3 of the weight behind it, against the query's unit vector and 1.
    """
    sized = lambda c: F.transform(unit(F.col(c)), lambda x: x * 0.7)
    held = edges.join(nodes.select(F.col(row_id).alias("from_id"), F.col(vector).alias("_v")), "from_id").select(F.col("edge_id").alias(row_id), F.concat(sized("_v"), F.array(F.col("weight") * 0.3)).alias(vector))
    asked = queries.select((-F.col(row_id) - 1).alias(row_id), F.concat(unit(F.col(vector)), F.array(F.lit(1.0))).alias(vector))
    return top_between(asked, held, k, row_id, vector, "inner").withColumn("query_id", -F.col("query_id") - 1)


def _block_pairs(df: DataFrame, group: str, row_id: str, vector: str) -> DataFrame:
    """(q_ids, q, ids, vectors, same) of each two blocks of a group, once, dealt by group and block, so a large group spreads."""
    blocks = packed(df, F.col(group), row_id, vector)
    n = blocks.groupBy("grp").agg((F.max("block") + 1).alias("n"))
    other = blocks.join(n, "grp").withColumnsRenamed({"ids": "q_ids", "vectors": "q", "block": "q_block"}).withColumn("block", F.explode(F.sequence(F.col("q_block"), F.col("n") - 1)))
    return other.join(blocks, ["grp", "block"]).select("q_ids", "q", "ids", "vectors", (F.col("q_block") == F.col("block")).alias("same"))


def _close(r: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of two blocks, and places and cosines of the pairs that reach the threshold."""
    (q_ids, q), (ids, x) = _matrix(r["q_ids"], r["q"]), _matrix(r["ids"], r["vectors"])
    s = np.round(_cosines(q, x), 12)
    i, j = np.nonzero((s >= threshold) & ((q_ids[:, None] < ids[None, :]) if r["same"] else (q_ids[:, None] != ids[None, :])))
    return q_ids, ids, i, j, s[i, j]


def similar_pairs(df: DataFrame, group: str, row_id: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, score), a < b, of the rows of one group whose cosine is at least the threshold."""

    def close(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids, i, j, score = _close(r, threshold)
                a, b = q_ids[i], ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score)], ["a", "b", "score"])

    return _block_pairs(df, group, row_id, vector).mapInArrow(close, "a bigint, b bigint, score double")


def similar_links(df: DataFrame, group: str, row_id: str, vector: str, threshold: float) -> DataFrame:
    """(a, b) that connect the same rows as similar_pairs: of each two blocks a link from every row to the smallest id of its component there, so at most a block's rows instead of their square."""

    def link(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids, i, j, _ = _close(r, threshold)
                every, at = np.unique(np.concatenate((q_ids[i], ids[j])), return_inverse=True)
                a, b = at[: len(i)], at[len(i) :]
                root = np.arange(len(every))
                while True:
                    low, before = np.minimum(root[a], root[b]), root.copy()
                    np.minimum.at(root, a, low), np.minimum.at(root, b, low)
                    root = root[root]
                    if (root == before).all():
                        break
                on = root != np.arange(len(every))
                yield pa.RecordBatch.from_arrays([pa.array(every[root[on]]), pa.array(every[on])], ["a", "b"])

    return _block_pairs(df, group, row_id, vector).mapInArrow(link, "a bigint, b bigint")


def _packed_sets(df: DataFrame, row_id: str, size: int) -> DataFrame:
    """(block, ids, ends, names): sets of tokens, about `size` to a block, by 64-bit names; ends: where each set's names end."""
    own = df.filter(F.col(row_id).isNotNull() & F.col("tokens").isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("names"))
    n = F.broadcast(own.agg(F.ceil((F.count(F.lit(1)) + 1) / size).alias("_n")))  # one row
    dealt = own.crossJoin(n).select("id", "names", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        names = table.column("names").combine_chunks()
        ends = np.diff(names.offsets.to_numpy()).cumsum()
        return pa.table({"block": table.column("block").slice(0, 1), "ids": [table.column("id").to_numpy().astype("<i8").tobytes()], "ends": [ends.astype("<i8").tobytes()], "names": [names.flatten().to_numpy().astype("<i8").tobytes()]})

    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, ends binary, names binary")


def set_overlaps(queries: DataFrame, rows: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, row_id, common, score) of all pairs that share a token, or of the k best rows of each query by score, then row_id: the Jaccard similarity of sets.

    Both sides: (query_id or row_id, whole numbers, and tokens, sets). A block of queries becomes a matrix of tokens by queries, and
    a row's common tokens are the sum of the lines that its tokens have there: no row is made for each shared token, and
    a token that all rows have is a line like others. Tokens are told apart by 64-bit names.
    """
    asked = _packed_sets(queries, "query_id", 256).withColumnsRenamed({"ids": "q_ids", "ends": "q_ends", "names": "q_names", "block": "q_block"})
    held = _packed_sets(rows, "row_id", BLOCK)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(0).alias("_on")
    n = F.broadcast(held.agg(F.max("block").alias("last")).withColumn("_on", F.lit(0)))  # one row
    pairs = asked.select("*", one).join(n, "_on").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("_on", "last").repartition(parts, "block").join(held, "block")

    def count(batches):
        for batch in batches:
            for r in batch.to_pylist():
                get = lambda c: np.frombuffer(r[c], "<i8")  # noqa: E731, B023
                q_ids, q_ends, q_names, ids, ends, names = map(get, ("q_ids", "q_ends", "q_names", "ids", "ends", "names"))
                known, line = np.unique(q_names, return_inverse=True)
                matrix = np.zeros((len(known) + 1, len(q_ids)), np.float32)  # the last line: no query has the token
                q_sizes, sizes = np.diff(q_ends, prepend=0), np.diff(ends, prepend=0)
                matrix[line, np.repeat(np.arange(len(q_ids)), q_sizes)] = 1
                at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
                at = np.where(known[at] == names, at, len(known)) if len(known) else np.zeros(len(names), np.int64)
                owner = np.repeat(np.arange(len(ids)), sizes)
                on = np.flatnonzero(at < len(known))
                owner, at = owner[on], at[on]
                common = np.zeros((len(ids), len(q_ids)))
                for low in range(0, len(at), 1 << 14):
                    high = min(len(at), low + (1 << 14))
                    starts = np.flatnonzero(np.diff(owner[low:high], prepend=-1))
                    common[owner[low:high][starts]] += np.add.reduceat(matrix[at[low:high]], starts, axis=0)
                score = common / np.maximum(sizes[:, None] + q_sizes[None, :] - common, 1)
                if k is None:
                    i, j = np.nonzero(common)
                else:
                    best = [np.lexsort((ids, -score[:, j]))[:k] for j in range(len(q_ids))]
                    i, j = np.concatenate(best or [np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(q_ids)), [len(b) for b in best])
                    i, j = i[common[i, j] > 0], j[common[i, j] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[j]), pa.array(ids[i]), pa.array(common[i, j].astype(np.int64)), pa.array(score[i, j])], ["query_id", "row_id", "common", "score"])

    return pairs.select("q_ids", "q_ends", "q_names", "ids", "ends", "names").mapInArrow(count, "query_id bigint, row_id bigint, common bigint, score double")


def top_sets(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, common, score, rank) of the k rows whose sets are most like each query's."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return set_overlaps(queries, rows, k).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fused(parts: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """(query_id, row_id, score): the retrievers' scores by weight, added up; a weight of 0 or less gives nothing."""
    live = [d.select("query_id", "row_id", (F.col("score") * w).alias("score")) for d, w in parts if w > 0]
    rows = live[0]
    for d in live[1:]:
        rows = rows.unionByName(d)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return rows.groupBy("query_id", "row_id").agg(F.sum("score").alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def failure_rank(cosines: DataFrame, outcomes: DataFrame, edges: DataFrame, sims: DataFrame, target_stress: float, k: int) -> DataFrame:
    """(query_id, row_id, score, rank) of failed outcomes: half the cosine, three tenths for a stress near the target, two tenths for the defect rate.

    cosines: (query_id, row_id, score); outcomes: (row_id, passed, defect_rate), null passed counts as passed; edges:
    (to_id, from_id, position) causal; sims: (from_id, stress). Of an outcome's simulations the first by position counts.
    """
    first = edges.join(sims, "from_id").groupBy(F.col("to_id").alias("row_id")).agg(F.min_by("stress", "position").alias("stress"))
    own = cosines.join(outcomes.filter(F.coalesce("passed", F.lit(1)) == 0), "row_id").join(first, "row_id", "left")
    near = F.coalesce(1 / (1 + F.abs(F.col("stress") - target_stress) / 100), F.lit(0.0))
    score = 0.5 * F.col("score") + 0.3 * near + 0.2 * F.least(F.lit(1.0), F.coalesce("defect_rate", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return own.select("query_id", "row_id", score.alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

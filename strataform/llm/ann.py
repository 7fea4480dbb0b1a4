"""Approximate nearest neighbours: inverted lists scanned dimension block by dimension block.

Vectors are lifted by one coordinate so that the largest inner product is the least distance, and rotated at random,
so that the distance over the first d of D coordinates estimates the whole. After each block of columns a test
abandons the candidates whose partial distance is too large to be among the nearest with any likelihood. A first
pass scans each query's closest lists; the distance of its k-th hit is what the other lists' candidates must beat.

The number of lists grows with the table. How many of them a query looks into is measured on the sample that the
lists are fitted on: so many that the asked share of the true neighbours there lies in them. On vectors with clusters
that is a small part; on vectors without any structure no list can be left out for free, and most are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.llm._shared import cut, partitions

#: Vectors that the list centres are fitted on, at most, and numbers in them (so few long vectors are drawn); all are indexed.
SAMPLE, NUMBERS = 20_000, 8 << 20
#: Sampled vectors whose neighbours within the sample tell how many lists to look into.
TRIED = 256
#: Columns in a block; how many standard errors a partial distance must lie beyond the threshold to be abandoned.
COLUMNS, ERRORS = 16, 2.1
#: Vectors and queries that a task compares at once, and bundles of queries that it compares with the same vectors.
TILE, QUERIES, BUNDLES = 2048, 512, 64


def _centres(x: np.ndarray, n: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), n, replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, 1)[:, 0]
        for k in range(n):
            own = x[near == k]
            centres[k] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    far = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def _sortable(ids: np.ndarray) -> np.ndarray:
    return ids.astype(str) if ids.dtype == object else ids


def _rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _lift(x: np.ndarray, largest: float, query: bool = False) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))
    return np.column_stack((x, extra))


def scan(queries: np.ndarray, limits: np.ndarray, own: list, ids: np.ndarray, vectors: np.ndarray, k: int, largest: float, rotation: np.ndarray):
    """(query, candidate) positions of each query's k nearest among the candidates, and their exact inner products; and how many columns were read, of how many.

    limits: squared distance that a candidate must not exceed; where it is infinite, the k-th distance among the first
    few candidates takes its place. own: the queries' ids, never their own hits.
    """
    x, own = _lift(vectors, largest) @ rotation, np.asarray(own)
    d, parts, read = rotation.shape[0], [], 0
    for at in range(0, len(queries), 64):  # so that the pairs alive fit in memory
        found = _scan_few(queries[at : at + 64], limits[at : at + 64], own[at : at + 64], ids, vectors, x, k, largest, rotation)
        read += found[-1]
        parts.append((found[0] + at, *found[1:3]))
    i, j, score = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, int), np.empty(0, int), np.empty(0))
    return i, j, score, read, len(queries) * len(ids) * d


def _scan_few(queries, limits, own, ids, vectors, x, k, largest, rotation):
    d, read = rotation.shape[0], 0
    q = _lift(queries, largest, True) @ rotation
    free = np.flatnonzero(~np.isfinite(limits))
    head = min(len(ids), max(4 * k, 128))
    if len(free) and head > k:
        near = queries[free] @ vectors[:head].T
        near[own[free][:, None] == ids[None, :head]] = -np.inf
        limits = limits.copy()
        kth = np.partition(near, head - k, axis=1)[:, head - k]
        limits[free] = np.maximum((queries[free] ** 2).sum(axis=1) + largest - 2 * kth, 0) * (1 + 1e-9) + 1e-9
        read += near.size * d
    # The first block of columns for all pairs as one product, the others for the pairs still alive.
    first = min(COLUMNS, d)
    partial = (q[:, :first] ** 2).sum(axis=1)[:, None] + (x[:, :first] ** 2).sum(axis=1)[None, :] - 2 * q[:, :first] @ x[:, :first].T
    read += partial.size * first
    i, j = np.nonzero((partial <= limits[:, None] * _slack(first, d) + 1e-9) & (own[:, None] != ids[None, :]))
    partial = partial[i, j]
    for at in range(first, d, COLUMNS):
        to = min(d, at + COLUMNS)
        read += len(i) * (to - at)
        off = x[j, at:to] - q[i, at:to]
        partial = partial + np.einsum("ij,ij->i", off, off)
        keep = partial <= limits[i] * _slack(to, d) + 1e-9
        i, j, partial = i[keep], j[keep], partial[keep]
    score = (vectors[j] * queries[i]).sum(axis=1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], score[place < k], read


def probes_for(drawn: np.ndarray, centres: np.ndarray, largest: float, k: int, recall: float) -> int:
    """Lists to look into so that `recall` of the k nearest of some drawn vectors, among all drawn, lie in them."""
    tried = drawn[: min(TRIED, len(drawn))]
    home = _nearest(_lift(drawn, largest), centres, 1)[:, 0]
    near = tried @ drawn.T
    near[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(drawn) - 1)]
    place = np.argsort(_nearest(_lift(tried, largest, True), centres, len(centres)), axis=1)  # of each list in a query's order
    ranks = np.sort(np.take_along_axis(place, home[best], axis=1), axis=None)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def _slack(seen: int, d: int) -> float:
    """How much of the limit the distance over `seen` of d columns may be before a candidate is abandoned."""
    return (1 + ERRORS / np.sqrt(seen)) ** 2 * seen / d if seen < d else 1 + 1e-9


def nearest(vectors: DataFrame, queries, k: int = 20, lists: int | None = None, recall: float = 0.96, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (inner product, in double precision) of each query's k nearest rows.

    queries: a condition on id_col. Candidates are all rows but those with the query's own id. Vectors that are null,
    zero, or hold null or non-finite components take no part; vectors of several lengths are searched apart, each
    among those of its own length. Ties go to the smaller id (of any type that sorts); a null id takes no part. Fewer
    candidates than k give all of them, no rows none; rows that repeat an id are candidates each. lists: inverted
    lists (twice the root of the rows, by default, and one for 20 sampled vectors at most); recall: the share of
    neighbours in the sample that probed lists hold. A list of any size is cut into tiles of bounded size, which tasks
    scan apart.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    own = vectors.select(F.col(id_col).alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("largest")).orderBy("d").collect()
    out = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    for r in sizes:  # one length, as a rule
        out = out.unionByName(_nearest_of(fine.filter(F.size("v") == r["d"]), r["d"], r["n"], r["largest"], queries, k, lists, recall, min(sample, max(1000, NUMBERS // r["d"])), kind))
    return out


def _nearest_of(fine: DataFrame, d: int, total: int, largest: float, queries, k: int, lists: int | None, recall: float, sample: int, kind: str) -> DataFrame:
    """nearest() for vectors of one length, all fit to take part."""
    # The rows with the smallest hashes: a uniform sample of a bounded size that doesn't depend on how rows are dealt.
    drawn = fine.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    drawn = drawn.flatten().to_numpy().reshape(-1, d)
    lifted = np.unique(_lift(drawn, largest), axis=0)
    n_lists = min(len(lifted), lists or max(1, min(int(2 * total**0.5), max(len(drawn) // 20, int(2 * len(drawn) ** 0.5)))))
    centres, rotation = _centres(lifted, n_lists), _rotation(d + 1)
    n_probes = min(n_lists, probes_for(drawn, centres, largest, k, recall))

    def stack(column) -> np.ndarray:
        return np.array(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]).reshape(-1, d) if len(column) else np.empty((0, d))

    def assign(batches):
        for batch in batches:
            x = stack(batch.column("v"))
            yield batch.append_column("list", pa.array(_nearest(_lift(x, largest), centres, 1)[:, 0].astype(np.int32)))

    def probe(batches):
        for batch in batches:
            x = stack(batch.column("v"))
            for at in range(0, len(x), 1024):
                near = _nearest(_lift(x[at : at + 1024], largest, True), centres, n_probes)
                yield batch.slice(at, 1024).append_column("lists", pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())))

    indexed = cut(fine.mapInArrow(assign, f"vec_id {kind}, v array<double>, list int"))
    asked = cut(fine.filter(queries(F.col("vec_id"))).mapInArrow(probe, f"vec_id {kind}, v array<double>, lists array<int>"))
    tiles = {r["list"]: -(-r["count"] // TILE) for r in indexed.groupBy("list").count().collect()}  # n_lists rows
    n_tiles = F.element_at(F.lit(None).cast("map<int,bigint>") if not tiles else F.create_map(*(F.lit(x).cast(t) for p in tiles.items() for x, t in zip(p, ("int", "bigint")))), F.col("list"))
    tile_of = F.pmod(F.xxhash64("vec_id", F.lit(3)), n_tiles)
    n_parts = partitions(fine.sparkSession)

    def as_pack(names):
        def run(table: pa.Table) -> pa.Table:
            x = stack(table.column("v").combine_chunks())
            out = {n: table.column(n).slice(0, 1) for n in names} | {"ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(table.schema.field("vec_id").type)), "vectors": [x.astype("<f8").tobytes()]}
            if "limit" in table.column_names:
                out["limits"] = [table.column("limit").to_numpy().astype("<f8").tobytes()]
            return pa.table(out)

        return run

    packed = cut(indexed.withColumn("tile", tile_of).groupBy("list", "tile").applyInArrow(as_pack(["list", "tile"]), f"list int, tile bigint, ids array<{kind}>, vectors binary"))

    def ask(rows: DataFrame) -> DataFrame:
        """Candidates of (vec_id, v, limit, list): the k best of every tile."""
        bundles = rows.withColumn("bundle", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n_bundles))).groupBy("list", "bundle").applyInArrow(as_pack(["list", "bundle"]), f"list int, bundle bigint, ids array<{kind}>, vectors binary, limits binary")
        # A tile of a list and a share of the bundles meet in a task of their own, however many vectors the list has.
        asking = bundles.withColumnsRenamed({"ids": "q_ids", "vectors": "q"}).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1))).withColumn("share", F.pmod("bundle", F.lit(n_shares)))
        tiles_ = packed.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shares - 1).cast("long"))))
        keys = ["list", "tile", "share"]
        pairs = asking.repartition(n_parts, *keys).join(tiles_.repartition(n_parts, *keys), keys)

        def run(batches):
            for batch in batches:
                id_type = batch.schema.field("ids").type.value_type
                for n in range(batch.num_rows):
                    q_ids, ids = (_sortable(batch.column(x)[n].values.to_numpy(zero_copy_only=False)) for x in ("q_ids", "ids"))
                    q, limits, x = (np.frombuffer(batch.column(c)[n].as_buffer(), "<f8") for c in ("q", "limits", "vectors"))
                    i, j, score, *_ = scan(q.reshape(-1, d), limits, q_ids, ids, x.reshape(-1, d), k, largest, rotation)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i], id_type), pa.array(ids[j], id_type), pa.array(score)], ["query_id", "vec_id", "score"])

        return pairs.select("q_ids", "q", "limits", "ids", "vectors").mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double")

    n_queries = asked.count()
    n_bundles = max(1, -(-n_queries // QUERIES))
    n_shares = -(-n_bundles // BUNDLES)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    n_first = max(1, n_probes // 10)
    first = cut(ask(asked.select("vec_id", "v", F.lit(float("inf")).alias("limit"), F.explode(F.slice("lists", 1, n_first)).alias("list"))))
    # |q - x|^2 = |q|^2 + largest - 2 <q, x>, for a lifted x
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    rest = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce(norm + F.lit(largest) - 2 * F.col("score"), F.lit(float("inf"))).alias("limit"), F.explode(F.slice("lists", n_first + 1, n_probes)).alias("list"))
    found = first.unionByName(ask(rest)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")

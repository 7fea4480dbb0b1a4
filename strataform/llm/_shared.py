"""What the operators of this subpackage share: hashes of words, and slices of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.tables import cut, drop, shared_dir  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over the cluster's cores where it is read in fewer parts than there are: for costly Python steps."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that end a word: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

def order_numbers(ids: DataFrame) -> DataFrame:
    """(doc_id, place) of the distinct ids that aren't null: numbers in the ids' order, without gathering them anywhere."""
    spark = ids.sparkSession
    ordered = cut(ids.filter(F.col("doc_id").isNotNull()).distinct().repartitionByRange(partitions(spark), "doc_id").withColumn("part", F.spark_partition_id()))
    base, bases = 0, []
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # a row a partition
        bases.append((r["part"], base))
        base += r["count"]
    starts = F.broadcast(spark.createDataFrame(bases, "part int, base bigint"))
    return ordered.join(starts, "part").select("doc_id", (F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) + F.col("base") - 1).alias("place"))


_BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps.
KEPT = 1 << 21


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= KEPT:  # those of a very long text go with it
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (a well-known finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Text that is worked on at once: what is made of it is many times its size.
SLICE = 1 << 18


def slices(lengths: np.ndarray, most: int = SLICE):
    """Ranges of consecutive items of about `most` bytes together, one item at least: working memory doesn't follow the batch."""
    at, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def text_slices(batch, column: str, most: int = SLICE):
    """(at, to, texts) of consecutive rows of a record batch: only so much of its text at a time becomes Python objects. Null is None."""
    texts = batch.column(column)
    for at, to in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), most):
        yield at, to, texts.slice(at, to - at).to_pylist()


def words(data: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, in order, and the offset of each text's first word (one more at the end)."""
    joined = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    if lower:
        joined = LOWER[joined]
    blank = np.empty(len(joined) + 1, dtype=np.int8)
    blank[0] = 1
    blank[1:] = BLANK[joined]
    edges = np.flatnonzero(np.diff(blank))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * powers(len(joined)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers(len(joined), INVERSE)[start])
    firsts = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in data], out=firsts[1:])
    return hashes, np.searchsorted(start, firsts)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def looked_up(left: DataFrame, right: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """left with the columns of right, which has one row a key at most; null where there is none. left is a written table, as it is read several times.

    Rows whose key more than one in `hot` of all rows has, which are `hot` keys at most, meet a broadcast copy of
    right's rows for these and stay where they are; rows without a key aren't dealt out by it either.
    """
    sizes = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    most = max(1, left.count() // hot)
    wide = cut(sizes.filter(F.col("_n") > most).select(key))
    none = left.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(right.schema[x].dataType).alias(x) for x in right.columns if x != key))
    many = left.join(F.broadcast(wide.withColumn("_on", F.lit(True)).join(right, key, "left")), key).drop("_on")
    rest = left.join(F.broadcast(wide), key, "left_anti").filter(F.col(key).isNotNull()).join(right, key, "left")
    names = none.columns
    return none.unionByName(many.select(*names)).unionByName(rest.select(*names))

"""Places in an order, neighbours, percentiles and sliding ranges of tables that no single task could sort.

Rows are dealt into ranges of the order and written once; each range is worked on apart, and what a range must know
of the others is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.tables import cut


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges of the order, with _part, the number of each row's range; rows that are equal in the order share one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, *order: str | Column, where: Column | None = None) -> DataFrame:
    """df with _n: each row's place in the order, from 0; with `where`, the place among the rows for which it holds, and null for others."""
    spark = df.sparkSession
    parts = ranged(df.withColumn("_on", F.lit(True) if where is None else F.coalesce(where, F.lit(False))), *order)
    base, starts = 0, []
    for r in parts.groupBy("_part").agg(F.count_if("_on").alias("n")).orderBy("_part").collect():  # a row a range
        starts.append((r["_part"], base))
        base += r["n"]
    side = F.broadcast(spark.createDataFrame(starts, "_part int, _base bigint"))
    own = F.row_number().over(Window.partitionBy("_part", "_on").orderBy(*order)) - 1
    return parts.join(side, "_part").withColumn("_n", F.when(F.col("_on"), F.col("_base") + own)).drop("_part", "_base", "_on")


def beside(df: DataFrame, value: str, *order: str) -> DataFrame:
    """df with _before and _after: the value in the row before and after in the order of all rows, null at the ends."""
    spark = df.sparkSession
    parts = ranged(df, *order)
    place = F.struct(*order)
    ends = parts.groupBy("_part").agg(F.min_by(value, place).alias("first"), F.max_by(value, place).alias("last")).orderBy("_part").collect()  # a row a range
    rows = [(r["_part"], ends[i - 1]["last"] if i else None, ends[i + 1]["first"] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    kind = df.schema[value].dataType.simpleString()
    side = F.broadcast(spark.createDataFrame(rows, f"_part int, _last {kind}, _first {kind}"))
    w = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(side, "_part").withColumns({"_before": F.coalesce(F.lag(value).over(w), "_last"), "_after": F.coalesce(F.lead(value).over(w), "_first")})
    return out.drop("_part", "_last", "_first")


def at_place(df: DataFrame, key: str, value: str, place) -> DataFrame:
    """(key, p): each key's value at place(n) from 0, of its n values in order; nulls are left out.

    Equal values of a key become one row with their number first; the ranges of a key's values are counted, and only
    the range that holds the place is looked into.
    """
    each = ranged(df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("p")).agg(F.count(F.lit(1)).alias("n")), "_key", "p")
    every = Window.partitionBy("_key")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = each.groupBy("_key", "_part").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumns({"base": F.coalesce(F.sum("size").over(before), F.lit(0)), "all": F.sum("size").over(every)}).withColumn("want", place(F.col("all")).cast("long"))
    one = sizes.filter("base <= want AND want < base + size").select("_key", "_part", "base", "want")
    so_far = F.sum("n").over(Window.partitionBy("_key", "_part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    found = each.join(one, ["_key", "_part"]).withColumn("upto", so_far).filter("want < upto AND want >= upto - n")
    return found.select(F.col("_key").alias(key), "p")


def over_range(df: DataFrame, key: str, at: Column, span: int, outputs) -> DataFrame:
    """df with outputs(window) over the closed range of `span` units of `at`, whole numbers, up to each row.

    A key's rows are cut into stretches of several spans; a stretch also gets the rows of the last span before it, so
    stretches of one key are worked on apart.
    """
    length = max(1, span) * 8
    own = df.withColumn("_at", at.cast("long")).withColumn("_stretch", F.floor(F.col("_at") / length))
    end = (F.col("_stretch") + 1) * length
    homes = F.when(F.col("_at") >= end - span, F.array(F.col("_stretch"), F.col("_stretch") + 1)).otherwise(F.array("_stretch"))
    rows = own.withColumn("_in", F.explode(homes))
    w = Window.partitionBy(key, "_in").orderBy("_at").rangeBetween(-span, 0)
    return rows.withColumns(outputs(w)).filter(F.col("_in") == F.col("_stretch")).drop("_at", "_stretch", "_in")

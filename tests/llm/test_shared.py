"""Lookups in which one key has half of all rows."""

from pyspark.sql import functions as F

from strataform.llm import url_filter
from strataform.llm._shared import looked_up
from strataform.tables import cut


def test_lookup_of_a_hot_key(spark):
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 97)
    left = cut(spark.range(4000, numPartitions=4).select(F.col("id").alias("row"), key.cast("long").alias("key")))
    right = spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    got = looked_up(left, right, "key", hot=20)
    want = left.join(right, "key", "left").select("row", "key", "value")
    rows = lambda df: sorted(map(tuple, df.select("row", "key", "value").collect()), key=str)
    assert rows(got) == rows(want)
    for some in (F.col("key") == 7, F.col("key").isNull()):
        assert got.filter(some).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert looked_up(left.limit(0), right, "key").count() == 0 and looked_up(left, right.limit(0), "key").filter("value IS NOT NULL").count() == 0


def test_pages_of_one_shape_are_dealt_out(spark):
    pages = spark.range(3000, numPartitions=4).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://hot.example.org/a/1").otherwise(F.concat(F.lit("http://h"), F.col("id") % 40, F.lit(".org/p"), F.col("id") % 11)).alias("url"))
    labels = pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("quality"), F.when(F.col("url").contains("//h1."), 1).otherwise(0).alias("toxic"))
    got = url_filter.url_filter(pages, labels, hot=20)
    assert got.count() == 3000 and {r["verdict"] for r in got.filter(F.col("host") == "hot.example.org").collect()} == {"allow"}
    assert {r["verdict"] for r in got.filter(F.col("host") == "h1.org").collect()} == {"block"}
    assert got.filter(F.col("host") == "hot.example.org").select(F.spark_partition_id().alias("p")).distinct().count() > 1

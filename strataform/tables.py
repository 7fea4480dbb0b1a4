"""Tables in the shared folder that cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset one in the warehouse, or a temporary one if everything runs in this process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strataform-tables"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again, so that a lost executor costs no more than the stage it was in. by: a column of which filters read no other rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df, which joins then sort and don't broadcast: Spark takes the size of compressed files for that of rows, which may be hundreds of times as large in the driver."""
    return df.hint("merge")


def bucketed(df: DataFrame, by: str, buckets: int | None = None) -> tuple[DataFrame, int]:
    """(df written as a table bucketed by a column, which later groupings and joins by it don't shuffle; its buckets). The catalogue doesn't keep its name; its files stay."""
    spark, name = df.sparkSession, f"strataform_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, by).write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(n, by).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table, n


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(conf).delete(path, True)

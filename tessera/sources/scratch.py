"""Tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a few numbers or short strings that may be told to every task; more are shuffled.
TOLD_ROWS = 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where that is unset and all run on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python a few MB at once, as pages and texts are long: by default ten thousand rows do."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")


def told(df: DataFrame, most: int = TOLD_ROWS) -> DataFrame:
    """df, to be broadcast in a join if it has at most so many rows. df is counted: it should be a written table."""
    return F.broadcast(df) if df.count() <= most else df


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in an order without ties, from 1. Ranges of the order are numbered apart; what lies before each range is a row of its own, told to all."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = laid.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return laid.withColumn(name, here).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)

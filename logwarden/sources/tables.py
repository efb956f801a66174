"""Result tables on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.session import write_and_read

def event_rows(events: DataFrame, max_line: int | None = None) -> DataFrame:
    """Events as stored: dated, and with raw lines of ``max_line`` characters at most if a store has such a width."""
    line = F.col("raw_line") if max_line is None else F.substring("raw_line", 1, max_line)
    return events.withColumn("raw_line", line).withColumn("event_date", F.to_date("event_timestamp"))


def write_events(events: DataFrame, path: str, mode: str = "append", max_line: int | None = None) -> None:
    """Events by date. Rebalancing merges small files per date and splits a date
    that holds much of the data over several tasks."""
    (event_rows(events, max_line).hint("rebalance", "event_date")
     .write.mode(mode).partitionBy("event_date").parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None if nothing has been stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def upsert(new: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
           buckets: int = 64) -> None:
    """Merge rows into a table that lies in buckets of ``key``; only buckets with new rows are written again.

    The merged buckets are written aside first, because a table cannot be read
    and overwritten at once; then they replace the old ones. So are the new rows, whose buckets are asked for before they
    are merged: they are made once. One writer at a time.
    """
    spark = new.sparkSession
    rows = new.withColumn("bucket", bucket_of(key, buckets))
    old = read_table(spark, path)
    if old is not None:
        rows = write_and_read(rows, "new")
        touched = old.join(rows.select("bucket").distinct(), "bucket", "left_semi").select(*rows.columns)
        merged = merge(touched.drop("bucket"), rows.drop("bucket"))
        rows = write_and_read(merged.withColumn("bucket", bucket_of(key, buckets)), "upsert")
    (rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))

"""Substring search over stored indicator values by an index of trigrams.

Distinct values are stored once, by bucket of their hash; their trigrams (of the lower-cased value) are postings, stored by
trigram bucket. A search opens the buckets of its own trigrams, keeps the values that have all of them, and verifies the
text itself. The value table is then read in the buckets of the candidates alone.

``%`` and ``_`` in the text act as wildcards, as in ``search_iocs``; only the trigrams between them narrow the search. A
text without any trigram is looked for in all values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
GRAM = 3


@dataclass(frozen=True)
class ValueIndex:
    """values(bucket, value_id, value) and grams(gram_bucket, gram, value_id)."""

    values: DataFrame
    grams: DataFrame
    buckets: int

    @staticmethod
    def read(spark: SparkSession, path: str) -> "ValueIndex":
        buckets = spark.read.parquet(f"{path}/about").first().buckets
        return ValueIndex(
            spark.read.schema("value_id long, value string, bucket int").parquet(f"{path}/values"),
            spark.read.schema("gram string, value_id long, gram_bucket int").parquet(f"{path}/grams"), buckets)


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text, lower-cased."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write_values(iocs: DataFrame, path: str, buckets: int = BUCKETS) -> ValueIndex:
    """Index the distinct values of ``iocs``. Values of equal 64-bit hash share an id; the search verifies each of them."""
    spark = iocs.sparkSession
    values = iocs.select("value").filter("value IS NOT NULL").distinct().select(F.xxhash64("value").alias("value_id"), "value")
    values.withColumn("bucket", F.pmod("value_id", F.lit(buckets)).cast("int")).repartitionByRange("bucket", "value_id") \
        .sortWithinPartitions("bucket", "value_id").write.partitionBy("bucket").parquet(f"{path}/values")
    grams = values.select("value_id", F.explode(grams_of(F.col("value"))).alias("gram"))
    grams.withColumn("gram_bucket", bucket_of(F.col("gram"), buckets)).repartitionByRange("gram_bucket", "gram", "value_id") \
        .sortWithinPartitions("gram_bucket", "gram").write.partitionBy("gram_bucket").parquet(f"{path}/grams")
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/about")
    return ValueIndex.read(spark, path)


def asked_grams(text: str) -> list[str]:
    """The trigrams that a hit must have: those between wildcards."""
    return sorted({part[i:i + GRAM] for part in re.split("[%_]", text.lower()) for i in range(len(part) - GRAM + 1)})


def matching(value: Column, text: str) -> Column:
    pattern = text.replace("\\", "\\\\")
    return value.ilike(f"%{pattern}%")


def candidates(index: ValueIndex, text: str) -> DataFrame | None:
    """The ids of values with all trigrams of the text; None if it has none. Only the trigrams' buckets are read."""
    grams = asked_grams(text)
    if not grams:
        return None
    spark = index.grams.sparkSession
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select(
        "gram", bucket_of(F.col("gram"), index.buckets).alias("gram_bucket"))
    buckets = sorted(r.gram_bucket for r in asked.collect())  # as many as the text has trigrams
    found = index.grams.filter(F.col("gram_bucket").isin(buckets) & F.col("gram").isin(grams))
    return found.groupBy("value_id").agg(F.count("*").alias("n")).filter(F.col("n") >= len(grams)).select("value_id")


def search_values(index: ValueIndex, text: str) -> DataFrame:
    """The distinct values that contain the text, ignoring case: (value)."""
    text = text.strip()
    if len(text) < 2:
        raise ValueError("search text needs at least 2 characters")
    found, values = candidates(index, text), index.values
    if found is not None:
        buckets = [r.b for r in found.select(F.pmod("value_id", F.lit(index.buckets)).alias("b")).distinct().collect()]
        values = values.filter(F.col("bucket").isin(buckets)).join(found, "value_id", "left_semi")
    return values.filter(matching(F.col("value"), text)).select("value").distinct()


def search_iocs_indexed(iocs: DataFrame, index: ValueIndex, text: str, ioc_type: str | None = None) -> DataFrame:
    """As ``search_iocs`` over rows whose values are indexed: the values first, the rows by a join on the value."""
    rows = iocs if ioc_type is None else iocs.filter(F.col("ioc_type") == ioc_type)
    return rows.join(search_values(index, text), "value", "left_semi").select(*iocs.columns)

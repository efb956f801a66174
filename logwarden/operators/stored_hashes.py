"""Hashes of stored documents behind a persisted Bloom filter, so that an ingestion looks up few of them exactly.

Every ingestion adds, in folders of its own that a repeat overwrites, the hashes it stored, by bucket, and a filter of
64-bit blocks over them, sized by their number (``BITS`` bits each). A lookup joins the new hashes with the filters'
blocks; only hashes that a filter lets pass go on to an exact join, which opens their buckets alone and takes out the false
positives. What the filter does not know is stored nowhere, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.session import write_and_read
from logwarden.sources.tables import read_table

BUCKETS = 256
BITS = 16  # of filter per hash: about one in 300 unknown hashes passes
PROBES = 4  # bits of a block that a hash sets
FILTER = "block long, blocks long, bits long, run string"
HASHES = "doc_hash string, run string, bucket int"


def bucket_of(hash_: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(hash_), F.lit(buckets)).cast("int")


def mask_of(hash_: Column) -> Column:
    """The bits of its block that a hash sets, from a hash of its own."""
    h = F.xxhash64(hash_, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(PROBES):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def block_of(hash_: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(hash_, F.lit("block")), blocks)


def add_hashes(docs: DataFrame, out: str, run: str) -> None:
    """Store the hashes of ``docs(doc_hash)`` and their filter as those of the ingestion ``run``."""
    known = write_and_read(docs.select("doc_hash").filter("doc_hash IS NOT NULL").distinct(), "hashes")
    blocks = F.lit(max(1, -(-known.count() * BITS // 64))).cast("long")
    known.withColumn("bucket", bucket_of(F.col("doc_hash"))).repartitionByRange("bucket", "doc_hash").sortWithinPartitions(
        "bucket", "doc_hash").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/hashes/run={run}")
    known.groupBy(block_of(F.col("doc_hash"), blocks).alias("block")).agg(
        blocks.alias("blocks"), F.bit_or(mask_of(F.col("doc_hash"))).alias("bits")) \
        .write.mode("overwrite").parquet(f"{out}/filter/run={run}")


def possible_hashes(docs: DataFrame, out: str) -> DataFrame:
    """(doc_hash, run): the hashes of ``docs`` that the filter of a run lets pass; all stored ones are among them."""
    spark = docs.sparkSession
    if read_table(spark, f"{out}/filter") is None:
        return spark.createDataFrame([], "doc_hash string, run string")
    filters = spark.read.schema(FILTER).parquet(f"{out}/filter")
    sizes = filters.select("run", "blocks").distinct().collect()  # one row an ingestion
    each = F.explode(F.array(*(F.struct(F.lit(r.run).alias("run"), F.lit(r.blocks).alias("blocks")) for r in sizes))).alias("f")
    asked = docs.select("doc_hash").filter("doc_hash IS NOT NULL").distinct().select("doc_hash", each).select(
        "doc_hash", "f.run", block_of(F.col("doc_hash"), F.col("f.blocks")).alias("block"), mask_of(F.col("doc_hash")).alias("mask"))
    return asked.join(filters, ["run", "block"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("doc_hash", "run")


def known_hashes(docs: DataFrame, out: str) -> DataFrame:
    """(doc_hash): the hashes of ``docs`` that are stored. Of the stored ones only the buckets of possible hits are read."""
    spark = docs.sparkSession
    possible = write_and_read(possible_hashes(docs, out).withColumn("bucket", bucket_of(F.col("doc_hash"))), "possible")
    buckets = [r.bucket for r in possible.select("bucket").distinct().collect()]  # at most BUCKETS
    if not buckets:
        return possible.select("doc_hash")
    stored = spark.read.schema(HASHES).parquet(f"{out}/hashes").filter(F.col("bucket").isin(buckets))
    return possible.join(stored, ["bucket", "run", "doc_hash"], "left_semi").select("doc_hash").distinct()

"""Inputs are spread by the rows their splits really have."""

from pyspark.sql import functions as F

from logwarden.session import spread


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_one_row_group_in_many_splits(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = spark.range(0, 200_000).withColumn("s", F.sha2(F.col("id").cast("string"), 256))
    rows.coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= 8 and largest(read) == 200_000
        assert largest(spread(read)) <= 30_000
        assert largest(spread(read, rows_a_task=5_000)) <= 6_000
        assert spread(read).agg(F.sum("id")).first()[0] == 200_000 * 199_999 // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_full_splits(spark):
    even = spark.range(0, 80_000, 1, 8)
    assert spread(even, rows_a_task=1_000).rdd.getNumPartitions() == 8
    assert spread(even, rows_a_task=1_000, always=True).rdd.getNumPartitions() == 80
    assert spread(spark.range(0), always=True).count() == 0

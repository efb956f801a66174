"""Lines meet the types of their logs where they are read."""

from pyspark.sql import functions as F

from logwarden.plans.log_run import with_log_type


def test_lines_stay_in_their_tasks(spark):
    """The lines are the smaller side by estimate, and still it is the types that travel."""
    lines = spark.range(0, 70, 1, 7).select((F.col("id") % 10).alias("log_id"), F.col("id").alias("line_number"))
    types = spark.range(0, 5000, 1, 3).select(F.col("id").alias("log_id"), F.concat(F.lit("t"), "id").alias("log_type"))
    typed = with_log_type(lines, types)
    assert typed.select(F.spark_partition_id().alias("p"), "*").select("p").distinct().count() == 7
    want = sorted((i % 10, i, f"t{i % 10}") for i in range(70))
    assert sorted(map(tuple, typed.collect())) == want
    assert sorted(map(tuple, with_log_type(lines, types, most_shipped=100).collect())) == want


def test_many_logs_are_dealt_by_rows(spark):
    """Above the bound one log with nearly all lines is several tasks."""
    lines = spark.range(0, 120_000, 1, 2).select(F.when(F.col("id") < 10, F.col("id")).otherwise(F.lit(7)).alias("log_id"))
    types = spark.range(10).select(F.col("id").alias("log_id"), F.lit("x").alias("log_type"))
    sizes = with_log_type(lines, types, most_shipped=5).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and sum(r["count"] for r in sizes) == 120_000 and max(r["count"] for r in sizes) <= 50_000

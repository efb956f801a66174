"""A passage that very many texts hold in surroundings of their own."""

import random
import string

from pyspark.sql import functions as F
from test_brute import removed_bytes, table

from logwarden.llm import substring_dedup as S


def test_many_surroundings(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choices(string.ascii_letters, k=n))
    passage = noise(260)
    rows = [(i, noise(rng.randrange(80)) + passage[rng.randrange(40):] + noise(rng.randrange(80))) for i in range(300)]
    rows += [(1000, passage[:199]), (1001, passage + passage), (1002, None)]
    got = S.remove_repeats(table(spark, rows), 20).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed_bytes(rows)))


def test_single_windows_are_counted(spark):
    """200,000 rows of one string cross the shuffle as counts, and the plan holds no Python worker."""
    rows = spark.range(200_000).select(
        F.lit(5).cast("long").alias("key"), (F.col("id") % 7).alias("pk"), F.col("id").alias("pc"), F.lit(0).alias("off"), F.lit(1).alias("n"),
        F.lit(3).alias("base"), F.lit(False).alias("many"), F.encode(F.lit("x" * S.LENGTH), "UTF-8").alias("bytes"))
    lone = rows.limit(1).withColumns({"key": F.lit(6).cast("long"), "bytes": F.encode(F.lit("y" * S.LENGTH), "UTF-8")})
    found = S.single_windows(rows.unionByName(lone))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "InArrow" not in str(found._jdf.queryExecution())
    assert found.count() == 200_000 and found.select("spans").distinct().collect()[0].spans == [(3, 3 + S.LENGTH)]

"""The persisted filter of stored hashes against a set."""

import shutil

from pyspark.sql import functions as F

from logwarden.operators import stored_hashes as H


def hashes(spark, first, last):
    return spark.range(first, last).select(F.sha2(F.col("id").cast("string"), 256).alias("doc_hash"))


def test_known(spark, tmp_path):
    out = str(tmp_path / "out")
    asked = hashes(spark, 0, 4000).unionByName(hashes(spark, 0, 10)).unionByName(spark.createDataFrame([(None,), ("",)], "doc_hash string"))
    assert H.known_hashes(asked, out).count() == 0
    H.add_hashes(hashes(spark, 1000, 1500), out, "a")
    H.add_hashes(hashes(spark, 1400, 3000).unionByName(spark.createDataFrame([(None,)], "doc_hash string")), out, "b")
    H.add_hashes(hashes(spark, 1400, 3000), out, "b")  # a repeated ingestion
    H.add_hashes(hashes(spark, 0, 0), out, "c")
    want = {r.doc_hash for r in hashes(spark, 1000, 3000).collect()}
    found = [r.doc_hash for r in H.known_hashes(asked, out).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    passed = H.possible_hashes(asked, out).select("doc_hash").distinct().count()
    assert len(want) <= passed <= len(want) + 0.02 * 2000


def test_only_possible_buckets_are_read(spark, tmp_path):
    out = str(tmp_path / "out")
    H.add_hashes(hashes(spark, 0, 3000), out, "a")
    asked = hashes(spark, 7, 9)
    buckets = {r.b for r in asked.select(H.bucket_of(F.col("doc_hash")).alias("b")).collect()}
    for bucket in set(range(H.BUCKETS)) - buckets:
        shutil.rmtree(f"{out}/hashes/run=a/bucket={bucket}", ignore_errors=True)
    assert H.known_hashes(asked, out).count() == 2
    assert H.known_hashes(hashes(spark, 5000, 5001), out).count() == 0

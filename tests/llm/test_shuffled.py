"""Operators on an input that deals its rows anew: the same results as on a scan of files."""

import pytest
from pyspark.sql import functions as F

from logwarden.llm import catalog, decontaminate, sentence_dedup, simhash, substring_dedup, url_filter

SF = "/root/testdata/sf0.001"


def same(make, table):
    def rows(df):
        return sorted(map(str, make(df).collect()))

    shuffled = table.repartition(7)
    assert rows(table) == rows(shuffled) == rows(shuffled.filter(F.lit(True)).sortWithinPartitions("url" if "url" in table.columns else "lang"))


@pytest.mark.parametrize("make", [
    substring_dedup.remove_repeats, sentence_dedup.remove_repeats, simhash.keep_one], ids=["substrings", "sentences", "simhash"])
def test_documents(spark, make):
    same(make, spark.read.parquet(f"{SF}/documents.parquet"))


def test_decontamination(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    same(lambda docs: decontaminate.remove_documents(docs, benchmark, max_windows=0), spark.read.parquet(f"{SF}/documents.parquet"))


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    listed = catalog.listed_urls(pages)
    same(lambda p: url_filter.filter_urls(p, listed, catalog.URL_RULES), pages)
    assert listed.count() > 2

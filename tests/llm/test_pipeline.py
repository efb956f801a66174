"""The pipeline's stages against brute force on the smallest table."""

from test_brute import brute_scan, brute_sentences
from test_near_copies import kept_rows

import corpus_pipeline
from logwarden.llm import catalog

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = [(r.doc_id, r.text) for r in docs.collect()]
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k == 0:
            now = [(i, t) for i, t in now if t and any(c.isalpha() for c in t)]
        elif k == 1:
            stay = set(kept_rows(now))
            now = [(i, t) for i, t in now if str(i) in stay]
        elif k == 2:
            now = [(i, t) for i, t, _, _ in brute_sentences(now, 3, 10)]
        elif k == 3:
            now = [(i, t) for (i, t), found in zip(now, brute_scan(now, benchmark)) if not found[4]]
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(now), k
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in now}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == catalog.op9_packing(spark, SF).columns and got.count() > 0

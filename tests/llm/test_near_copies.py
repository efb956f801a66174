"""The pipeline's near-duplicate stage against brute force: all pairs of exact 5-word Jaccard similarity."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import near_copies
from test_brute import LOWER, rows, table  # noqa: F401


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])


def kept_rows(rows):
    """The rows that stay, least doc_id of each component first; a row without doc_id is last."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (doc is None, doc or 0))
    return sorted(str((None if none else doc)) for none, doc in least.values())


def test_planted_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    docs, near = [], 0
    for k in range(60):
        base = [word() for _ in range(rng.randrange(40, 400))]
        docs.append((10 * k, " ".join(base)))
        for j in range(1, 5):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * j // 90)):
                copy[at] = word()
            docs.append((10 * k + j, " ".join(copy)))
            a, b = shingles(docs[-1][1]), shingles(docs[10 * k // 10 * 5][1])
            near += 0.8 <= len(a & b) / len(a | b) < 0.97
    got = corpus_pipeline.near_duplicate_stage(spark, table(spark, docs), "").collect()
    assert near > 60 and sorted(str(r.doc_id) for r in got) == kept_rows(docs) and len(got) < len(docs) - near // 2


def test_defined_rows(spark, rows):  # noqa: F811
    docs = table(spark, rows)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == kept_rows(rows)
    assert corpus_pipeline.near_duplicate_stage(spark, table(spark, []), "").count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == kept_rows([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("nodes, shingles_", [(1_000, 1_000_000), (7, 1_000_000), (1_000, 700)])
def test_groups_in_blocks(spark, nodes, shingles_):
    """A star of copies, most of them near the middle and few near each other: one class, whatever the blocks."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 8)):
            copy[at] = f"x{i}-{at}"
        docs.append((i, " ".join(copy)))
    sets = [shingles(t) for _, t in docs]
    ids = {s: i for i, s in enumerate({x for s in sets for x in s})}
    rooted = spark.createDataFrame([(1, i, len(s), i) for i, s in enumerate(sets)], "key long, node long, n int, root long")
    table_ = spark.createDataFrame([(i, [ids[x] for x in s]) for i, s in enumerate(sets)], "node long, hashes array<long>")
    links = near_copies.links_across(rooted, table_, nodes, shingles_).collect()
    up = list(range(60))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in links:
        assert 5 * len(sets[r.a] & sets[r.b]) >= 4 * len(sets[r.a] | sets[r.b])
        up[root(r.a)] = root(r.b)
    assert len({root(i) for i in range(60)}) == len(kept_rows(docs)) < 60


def test_shuffled_input(spark):
    """The numbers of rows come from one evaluation, whatever deals the rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = kept_rows([(r.doc_id, r.text) for r in docs.collect()])
    got = near_copies.keep_one(docs.repartition(7).filter(F.lit(True)))
    assert sorted(str(r.doc_id) for r in got.collect()) == expected


def test_fingerprints_give_candidates(spark):
    """Nodes within three bits, or of one fingerprint, are connected by the SimHash step; texts far apart are not."""
    rows = [(1, 9, 0b0), (2, 9, 0b111), (3, 9, 0b111), (4, 9, 0b111111), (5, 9, (1 << 40) - 1), (6, 0, 0b0)]
    nodes = spark.createDataFrame(rows, "node long, n int, fp long")
    got = {frozenset((r.a, r.b)) for r in near_copies.fingerprint_pairs(nodes).collect() if r.a != r.b}
    assert got == {frozenset((2, 3)), frozenset((1, 2)), frozenset((2, 4))}
    assert near_copies.fingerprint_pairs(nodes.limit(0)).count() == 0


def test_counting_bits_needs_little_memory_whatever_the_batch():
    import tracemalloc

    from logwarden.llm.simhash import majority_bits

    offsets = np.array([0, 5, 5, 150_000, 150_001, 300_000])
    values = np.random.default_rng(3).integers(0, 1 << 63, 300_000).astype(np.uint64)
    tracemalloc.start()
    got = majority_bits(values, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    for row, fp in enumerate(got.tolist()):
        part = values[offsets[row]:offsets[row + 1]]
        assert fp == sum(1 << b for b in range(64) if 2 * int((part >> np.uint64(b) & np.uint64(1)).sum()) > len(part))

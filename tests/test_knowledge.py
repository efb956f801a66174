import random

import numpy as np
from pyspark.sql import functions as F

from logwarden.operators import knowledge as K
from logwarden.operators import search as S
from logwarden.plans.ingest import ingest_documents


def docs(spark, *texts):
    return spark.createDataFrame([(t, f"/kb/{i}", "custom", None, f"h{i}", None, None, None, {"i": str(i)}) for i, t in enumerate(texts)],
                                 "content string, source_path string, source_type string, source_url string, doc_hash string, "
                                 "technique_id string, cve_id string, severity string, metadata map<string,string>")


def test_validation(spark):
    got = K.validate_docs(docs(spark, " ", "short", "x" * 60, "w " * 30, "word " * 60)).orderBy("source_path").collect()
    assert [r.reason for r in got] == ["Content is empty or whitespace-only", "Content too short: 5 chars (minimum is 50)",
                                       "Too few words: 1 (minimum is 10)", None, None]
    assert [len(r.warnings) for r in got] == [0, 0, 0, 2, 0]


def pack(pieces, size, overlap):
    """Greedy packing with whole-piece overlap, one piece at a time."""
    lens = [len(p.split()) for p in pieces]
    chunks, first, words = [], 0, 0
    for i, n in enumerate(lens):
        if words and words + n > size:
            chunks.append("".join(pieces[first:i]).strip())
            kept, k = 0, i
            while k - 1 > first and kept + lens[k - 1] <= overlap and kept + lens[k - 1] + n <= size:
                k -= 1
                kept += lens[k]
            first, words = k, kept
        words += n
    return chunks + ["".join(pieces[first:]).strip()]


def test_chunks(spark):
    random.seed(4)
    sentences = [" ".join("w%d" % random.randint(0, 99) for _ in range(random.randint(1, 12))) + "." for _ in range(120)]
    text = sentences[0] + "".join((" " if random.random() < 0.8 else "\n\n") + s for s in sentences[1:])
    pieces = [text[a:b] for a, b in zip(cuts(text)[:-1], cuts(text)[1:])]
    for size, overlap in ((20, 6), (30, 0), (15, 14), (5000, 64)):
        got = [r.text for r in K.chunk_docs(docs(spark, text), size, overlap).orderBy("chunk_index").collect()]
        assert got == pack(pieces_by_size(pieces, size), size, overlap)
        assert all(len(c.split()) <= size and c in text for c in got)
    long = K.chunk_docs(docs(spark, "w " * 1000), 100, 10).collect()
    assert len(long) == 10 and {r.total_chunks for r in long} == {10}
    assert K.chunk_docs(docs(spark, " ")).count() == 0


def cuts(text):
    import re
    return [0, *[m.start() for m in re.finditer(r"(?<=[.!?])(?=\s)|(?<=\n\n)", text) if m.start()], len(text)]


def pieces_by_size(pieces, size):
    return [p for p in pieces if p]


def make_encoder():
    def encoder(texts):  # nested, so that it is shipped by value
        return np.array([[len(t), t.count("a"), 1.0] for t in texts])

    return encoder


encoder = make_encoder()


def test_ingest(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu. " * 3
    rows = [("/kb/mitre/a.md", good), ("/kb/mitre/b.md", good + " "), ("/kb/x.txt", "short"), ("/kb/y.pdf", good), ("/kb/z.txt", "  "),
            ("/kb/c.jsonl", '{"text": "%s one"}\n{"text": "%s two"}' % (good, good))]
    files = spark.createDataFrame(rows, "path string, content string")
    result = ingest_documents(files, encoder=encoder)
    got = sorted((r.path, r.status) for r in result.files.collect())
    assert got == [("/kb/c.jsonl", "indexed"), ("/kb/c.jsonl", "indexed"), ("/kb/mitre/a.md", "indexed"), ("/kb/mitre/b.md", "skipped_duplicate"),
                   ("/kb/x.txt", "failed"), ("/kb/y.pdf", "skipped_unsupported"), ("/kb/z.txt", "failed")]
    chunks = result.chunks.collect()
    assert len(chunks) == 3 and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in chunks)
    again = ingest_documents(files, result.chunks, encoder)
    assert again.chunks.count() == 0 and again.files.filter("status = 'skipped_duplicate'").count() == 4


def test_equal_items_of_one_file_are_indexed_once(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    files = spark.createDataFrame([("/kb/a.json", '[{"text": "%s"}, {"text": "%s"}, {"text": "%s"}]' % (good, good, good))], "path string, content string")
    result = ingest_documents(files)
    assert sorted(r.status for r in result.files.collect()) == ["indexed", "skipped_duplicate", "skipped_duplicate"]
    assert result.chunks.count() == 1


def brute_dense(q, v, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(v).T, 6)
    return {(i, int(j)): s[i, j] for i in range(len(q)) for j in sorted(range(len(v)), key=lambda j: (-s[i, j], j))[:k]}


def test_dense_search_in_parts_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(700, 8)), rng.normal(size=(40, 8))
    chunks = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "node_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, vector array<double>")
    want = brute_dense(q, v, 7)
    shipped = {(r.query_id, r.node_id): r.score for r in S.dense_search(chunks, asked, 7).collect()}
    parts = {(r.query_id, r.node_id): r.score for r in S.dense_search(chunks, asked, 7, queries_at_once=10).collect()}
    assert shipped == want and parts == want
    assert S.dense_search(chunks, asked.limit(0), 7).count() == 0


def test_hybrid_edges_and_index_on_disk(spark):
    rows = [(1, "the quick brown fox", [1.0, 0.0]), (2, "the lazy dog", [0.0, 1.0]), (3, "quick quick dog", None), (4, "", [1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "node_id long, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "quick fox", [1.0, 0.0]), (2, "  ", [1.0, 0.0]), (3, "zzz", [0.0, 1.0])], "query_id long, query string, vector array<double>")
    index = S.persist_index(S.build_bm25(chunks), spark)
    got = S.hybrid_search(chunks, asked, index).collect()
    assert {r.query_id for r in got} == {1, 3}
    assert [r.node_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1][0] == 1
    assert S.hybrid_search(chunks, asked, index, threshold=0.35).count() == 0
    stats = index.stats.first()
    assert stats.n_nodes == 3 and abs(stats.avg_len - 10 / 3) < 1e-9
    tf = {(r.term, r.node_id): r.tf for r in index.postings.collect()}
    assert tf[("quick", 3)] == 2 and tf[("the", 2)] == 1


def test_bm25_in_rows_equals_the_join(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(60)])
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(300)] + [(400, None), (401, "")]
    index = S.build_bm25(spark.createDataFrame(rows, "node_id long, text string").repartition(4))
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 5))) for q in range(12)] + [(90, "unknown"), (91, None)],
                                  "query_id long, query string")
    pick = lambda df: {(r.query_id, r.node_id): (r.score, r["rank"]) for r in df.collect()}
    in_rows = pick(S.bm25_search(index, asked, 8))
    assert in_rows == pick(S.bm25_search(index, asked, 8, max_words=0)) and len(in_rows) > 50
    plan = S.bm25_search(index, asked, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 1 and "hashpartitioning(query_id" in plan


def test_queries_get_the_prefix(spark):
    seen = K.embed_queries(spark.createDataFrame([(1, " a "), (2, " ")], "query_id long, query string"), encoder).collect()
    assert [r.query_id for r in seen] == [1]
    n = len(K.QUERY_PREFIX + "a")
    assert abs(seen[0].vector[0] / seen[0].vector[2] - n) < 1e-3
    assert K.hashing_embed(spark.range(1).select(F.lit("a b a").alias("text")), dim=16).first().embedding is not None


def test_files_of_one_path(spark):
    """Equal paths are separate files: of equal texts one is indexed, and a blank one fails beside a filled one."""
    text = "word " * 40
    files = spark.createDataFrame([("/kb/a.md", text), ("/kb/a.md", text), ("/kb/a.md", "  "), ("/kb/a.md", text + "more"),
                                   ("/kb/b.pdf", "x"), ("/kb/b.pdf", "y")], "path string, content string")
    result = ingest_documents(files)
    assert sorted(r.status for r in result.files.collect()) == [
        "failed", "indexed", "indexed", "skipped_duplicate", "skipped_unsupported", "skipped_unsupported"]
    assert result.chunks.count() == result.chunks.select("node_id").distinct().count() == 2

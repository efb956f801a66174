"""Near copies by exact Jaccard similarity of word shingles, with SimHash fingerprints and MinHash bands as candidates.

SimHash alone cannot serve at this similarity: texts of Jaccard 0.8 differ in about 10 of 64 bits, and in 17 at times. So the
fingerprints find what lies within their 3 bits, by the masked variants of ``simhash``, and MinHash the rest.

1. A text's shingles are runs of ``WIDTH`` words (A-Z lower-cased), as 64-bit hashes. Texts of equal sets of shingles are
   one node. ``BANDS`` keys of ``ROWS`` minimal hashes each stand for a set: two sets of Jaccard 0.8 share no key in one
   of 14,000 cases, of 0.85 in one of 1.3 million. A node also has the SimHash fingerprint of its row's shingles.
2. Fingerprints within 3 bits are linked by ``simhash.link_fingerprints``; nodes of one fingerprint, and a node of each of
   two linked ones, are candidates. In the group of a key every node is compared with ``LEADS`` nodes of the group, found by one aggregation. Links are
   verified: the exact Jaccard similarity of the two sets is ``SIMILARITY`` or more.
3. Groups that still fall into several components go to tasks with the sets of their nodes. A task finds the links between
   components by sparse-to-dense products of shingle matrices and returns a spanning forest of them, never pairs. A group
   of more than ``BLOCK_NODES`` nodes or ``BLOCK_SHINGLES`` shingles is cut into blocks by hash, one task group for each two
   blocks, so that no task holds more than two. All candidates are decided; there is no cap.
4. Components of the links are the classes; the row of least doc_id of each stays.

What step 3 costs grows with the square of a group whose nodes share a key but are no near copies of each other; what it
moves, with that square over ``BLOCK_NODES``.

Defined results: fewer words than ``WIDTH`` are one shingle; null, empty and blank texts are copies of each other; of
repeated rows one stays; rows without doc_id come last; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import ascii_lower, once, repeatable, space_words
from logwarden.llm.components import components
from logwarden.llm.simhash import HASHES_AT_ONCE, Forest, link_fingerprints, majority_bits, shingle_hashes
from logwarden.session import write_and_read

WIDTH = 5
SIMILARITY = (4, 5)  # as a fraction: whole numbers decide ties
BANDS = 24
ROWS = 5
LEADS = 3
BLOCK_NODES = 1_000
BLOCK_SHINGLES = 1_000_000
SHINGLES_AT_ONCE = 4_096
SIGNED = "_row long, doc_id long, node long, n int, fp long, bands array<long>"

_random = np.random.default_rng(7)
MULTIPLY = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def band_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The keys of rows of 64-bit hashes; row i, which is not empty, has values[offsets[i]:offsets[i + 1]]."""
    least = np.full((BANDS * ROWS, len(offsets) - 1), np.iinfo(np.uint64).max, np.uint64)
    for first in range(int(offsets[0]), int(offsets[-1]), HASHES_AT_ONCE):
        last = min(first + HASHES_AT_ONCE, int(offsets[-1]))
        rows = slice(np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, last, "left"))
        cuts = np.maximum(offsets[:-1][rows], first) - first
        for k in range(BANDS * ROWS):
            mixed = (values[first:last] ^ MIX[k]) * MULTIPLY[k]
            least[k, rows] = np.minimum(least[k, rows], np.minimum.reduceat(mixed, cuts))
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], least.shape[1], axis=1)
    for k in range(ROWS):
        keys = (keys ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.T


def hashes_of(text: Column, **rest: Column) -> tuple[list[Column], Column]:
    """Columns to select first, and then the shingle hashes as ``hashes``."""
    words = once(space_words(ascii_lower(text.cast("string")))).alias("words")
    return [*(c.alias(name) for name, c in rest.items()), words], shingle_hashes(F.col("words"), WIDTH).alias("hashes")


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: _row, doc_id, node (hash of the set of shingles), n (its size), fp (SimHash fingerprint), bands (none for a
    text without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.slice(begin, 1000)
                lists = part.column("hashes")
                values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
                sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sizes = np.array([len(s) for s in sets], np.int32)
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
                full = [s for s in sets if len(s)]
                keys = band_keys(np.concatenate(full), np.cumsum([0, *map(len, full)])) if full else np.zeros(0, np.uint64)
                ends = np.cumsum([0, *np.where(sizes > 0, BANDS, 0)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                fps = pa.array(majority_bits(values, offsets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("doc_id"), pa.array(nodes.view(np.int64)), pa.array(sizes), fps, bands],
                    names=["_row", "doc_id", "node", "n", "fp", "bands"])

    first, hashes = hashes_of(F.col("`text`"), _row=F.monotonically_increasing_id(), doc_id=F.col("`doc_id`").cast("long"))
    return docs.select(*first).select("_row", "doc_id", hashes).mapInArrow(run, SIGNED)


def pairs_of(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of rows (a, n_a, b, n_b) whose sizes allow the similarity."""
    p, q = SIMILARITY
    fits = (F.col("a") != F.col("b")) & (q * F.least("n_a", "n_b").cast("long") >= p * F.greatest("n_a", "n_b").cast("long"))
    return rows.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, n_a, b, n_b) by SimHash: every node with the least one of its fingerprint, and the least ones of linked
    fingerprints with each other."""
    own = nodes.filter("n > 0").select("node", "n", "fp")
    least = write_and_read(own.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("x")), "least")
    side = lambda name: least.select(F.col("fp").alias(f"fp_{name}"), F.col("x.node").alias(name), F.col("x.n").alias(f"n_{name}"))
    same = own.join(side("b"), F.col("fp") == F.col("fp_b")).select(F.col("node").alias("a"), F.col("n").alias("n_a"), "b", "n_b")
    near = link_fingerprints(least.select("fp")).toDF("fp_a", "fp_b")
    return same.unionByName(near.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "n_a", "b", "n_b"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have the similarity."""
    p, q = SIMILARITY
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(
        q * both >= p * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect all near copies; ``nodes`` has node, n, fp, bands and _row, a row of the text."""
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    lead = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "n")).alias(f"lead{k}") for k in range(LEADS)]
    groups = write_and_read(banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), *lead).filter(
        "low <> high").drop("low", "high"), "groups")
    shared = write_and_read(banded.join(groups, "key").select("node", "n", "key", *(f"lead{k}" for k in range(LEADS))), "shared")
    found = shared.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.explode(
        F.array(*(F.struct(F.col(f"lead{k}.node").alias("b"), F.col(f"lead{k}.n").alias("n_b")) for k in range(LEADS)))).alias("x"))
    pairs = write_and_read(pairs_of(found.select("a", "n_a", "x.b", "x.n_b").unionByName(fingerprint_pairs(nodes))), "pairs")

    compared = shared.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    rows = nodes.join(compared, "node", "left_semi").select("_row", "node")
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("`text`").alias("text")).join(rows, "_row")
    first, hashes = hashes_of(F.col("text"), node=F.col("node"))
    sets = write_and_read(texts.select(*first).select("node", F.array_distinct(hashes).alias("hashes")), "sets")
    linked = write_and_read(verified(pairs, sets), "linked")

    roots = components(linked)
    rooted = shared.select("node", "n", "key").join(roots, "node", "left").select(
        "key", "node", "n", F.coalesce("root", "node").alias("root"))
    return linked.unionByName(links_across(write_and_read(rooted, "rooted"), sets))


def links_across(rooted: DataFrame, sets: DataFrame, block_nodes: int = BLOCK_NODES,
                 block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that connect the components of near copies within every group; ``rooted`` has key, node, n and root."""
    apart = rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("nodes"), F.sum("n").alias("shingles")) \
        .filter("low <> high").select("key", F.greatest(
            F.ceil(F.col("nodes") / block_nodes), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks"))
    rows = rooted.join(apart, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # every two blocks meet in one task group: that of (block, other) and (other, block)
    meets = F.explode(F.expr("filter(sequence(0, blocks - 1), x -> blocks = 1 OR x <> block)")).alias("other")
    rows = rows.select("key", "node", "root", "block", meets).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"), "node", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            meeting = batch.column("meeting").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(meeting)) + 1).tolist(), len(batch)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if held and last > first and held[0].column("meeting")[0].as_py() != meeting[first]:
                    yield forest_of(held)
                    held = []
                if last > first:
                    held.append(batch.slice(first, last - first))
        if held:
            yield forest_of(held)

    parts = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(sets, "node").select("meeting", "node", "root", "hashes").repartition(parts, "meeting") \
        .sortWithinPartitions("meeting").mapInArrow(run, "a long, b long")


def forest_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The links of one group that connect its components."""
    rows = pa.Table.from_batches(held)
    node, root = (rows.column(c).to_numpy() for c in ("node", "root"))
    lists = rows.column("hashes").combine_chunks()
    forest = Forest(len(node))
    _, place = np.unique(root, return_inverse=True)
    firsts: dict[int, int] = {}
    for i, r in enumerate(place.tolist()):  # components known before
        forest.link(firsts.setdefault(r, i), i)
    forest.links.clear()
    common = np.bincount(place).argmax()
    asked = np.flatnonzero(place != common)  # pairs within the largest component need no look
    if len(asked):
        for i, j in similar(asked, lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))):
            forest.link(i, j)
    at = np.array(forest.links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]], pa.int64()), pa.array(node[at[:, 1]], pa.int64())], names=["a", "b"])


def similar(asked: np.ndarray, values: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (asked row, any row) of sets, row i being values[starts[i]:starts[i + 1]], that have the similarity."""
    p, q = SIMILARITY
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, shingle, counts = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1  # what one set alone has is in no intersection
    kept = counts[shingle] > 1
    row, shingle = row[kept], column[shingle[kept]]
    both = np.zeros((len(asked), len(sizes)), np.float32)
    order = np.argsort(shingle, kind="stable")
    row, shingle = row[order], shingle[order]
    for first in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, SHINGLES_AT_ONCE):
        a, b = np.searchsorted(shingle, (first, first + SHINGLES_AT_ONCE))
        has = np.zeros((len(sizes), SHINGLES_AT_ONCE), np.float32)
        has[row[a:b], shingle[a:b] - first] = 1
        both += has[asked] @ has.T
    near = q * both >= p * (sizes[asked][:, None] + sizes[None, :] - both)
    for i, j in np.argwhere(near).tolist():
        yield int(asked[i]), j


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one of least doc_id; all columns kept."""
    docs = repeatable(docs)
    rows = write_and_read(signatures(docs), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "n", "fp", "bands")).alias("least")
    nodes = write_and_read(rows.groupBy("node").agg(least), "nodes")
    roots = components(links(docs, nodes.select("node", "least.n", "least.fp", "least.bands", "least._row")))
    rooted = nodes.join(roots, "node", "left").select(
        F.coalesce("root", "node").alias("root"), F.struct("least.none", "least.doc_id", "least._row").alias("least"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._row").alias("_keep"))
    out = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row"))
    return out.join(stay, out["_row"] == stay["_keep"], "left_semi").select("doc.*")

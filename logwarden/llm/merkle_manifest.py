"""Merkle manifest of a table: a postorder append log written by aligned builders, and proofs read from it.

1. A row is a leaf: the hash of its doc_id, source, lang, n_chars and text, each ``-`` if null, else its UTF-8 byte count,
   ``:`` and its value. Leaves are ordered by one range shuffle of (source, doc_id, leaf) and numbered within their source.
2. Of every source each ``SPAN`` consecutive leaves, an aligned block, go to one builder. It appends the nodes of its
   subtree in the order of their completion, so that a node follows all nodes below it and the root comes last. The log
   is a table with one row, a segment, per block. The roots of the blocks of a source with more than one are the leaves of
   the next round of builders, until every source has one root; the roots of the sources make one more such tree.
3. The place of any node in a segment is known in closed form from the sizes of the subtrees before it
   (``place_in_log``), so a proof is read by address: the siblings of a leaf in its own segment, then those of the segment's
   root in the segment above, up to the root of all.

A tree's nodes are runs of ``FAN`` nodes of the level below, in order; the last run may be shorter, even one node, and is
hashed like any other. A tree of one leaf is that leaf. Sources are ordered by their UTF-8 bytes, null first.

Defined results: nulls are leaves like any other row (null doc_ids come first in their source); rows of one doc_id are
ordered by their leaf, and equal rows have leaves each, with equal hashes; an empty table gives no rows; extra columns,
whatever their names, are ignored. No task holds more than ``SPAN`` leaves, however large a source is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.columns import only
from logwarden.session import write_and_read

FAN = 3
SPAN = FAN ** 7
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "tree long, block long, n long, log binary"
TEXTS = pa.list_(pa.string())
PATH = "tree long, block long, lefts array<string>, rights array<string>"
PROVED = "doc_id long, leaf string, now string, subroot string, lefts array<string>, rights array<string>"


# -- one tree -----------------------------------------------------------------

def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def levels_of(n: int, span: int) -> int:
    """Levels that a segment of a tree of ``n`` nodes has above its own leaves."""
    return height(min(n, span))


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes of a subtree of that many levels in the order of their completion; nodes are digests as hex text."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = sha256(b"".join(open_runs[level])).hexdigest().encode()
        open_runs[level] = []
        log.append(node)
        open_runs[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        level = 0
        while level < levels and len(open_runs[level]) == FAN:
            close(level)
            level += 1
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return log


def place_in_log(level: int, index: np.ndarray, n: int, levels: int) -> np.ndarray:
    """Where the nodes ``index`` of a level stand in the log of a subtree of ``n`` leaves.

    Before a node that ends with leaf e stand the nodes of its own and lower levels that end at e or before, and the nodes
    of higher levels that end before e.
    """
    end = np.minimum((index + 1) * FAN ** level, n)
    upto = sum(-(-end // FAN ** j) for j in range(level + 1))
    return upto + sum((end - 1) // FAN ** j for j in range(level + 1, levels + 1)) - 1


def sibling_texts(log: np.ndarray, n: int, levels: int) -> list[tuple[list[str], list[str]]]:
    """Per level the siblings left and right of each of its nodes, joined as text; ``log`` holds the hex text of nodes."""
    found = []
    for level in range(levels):
        count = -(-n // FAN ** level)
        nodes = log[place_in_log(level, np.arange(count), n, levels)].tolist()
        lefts, rights = [], []
        for first in range(0, count, FAN):
            run = nodes[first:first + FAN]
            for k in range(len(run)):
                lefts.append("".join(run[:k]))
                rights.append("".join(run[k + 1:]))
        found.append((lefts, rights))
    return found


def nodes_of(log: bytes) -> np.ndarray:
    """The digests of a segment as hex text."""
    text = log.hex()
    return np.array([text[i:i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)], dtype=object)


def leaves_in(n: int, block: int, span: int) -> int:
    return min(span, n - block * span)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, as a segment is large."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


# -- the log ------------------------------------------------------------------

def written_out(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row, as bytes; ``changed`` replaces fields."""
    return F.unhex(F.sha2(F.concat(*(written_out(changed.get(name, F.col(name))) for name in FIELDS)), 256))


def in_order(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` as a written table, sorted by ``keys`` over all its parts; ``_at`` grows with the order."""
    return write_and_read(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_at", F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, *group: str) -> DataFrame:
    """Rows of ``in_order`` with ``rank`` (from 0) and ``n`` within their group; the groups must be sorted first.

    Only the counts of each part of each group are gathered.
    """
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    counts = write_and_read(counts.withColumn(
        "_before", F.sum("_count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "n", F.sum("_count").over(whole)), "counts")
    rows, same = rows.withColumn("_part", part).alias("x"), F.col("x._part") == F.col("c._part")
    for g in group:
        same &= F.col(f"x.{g}").eqNullSafe(F.col(f"c.{g}"))
    return rows.join(counts.alias("c"), same).select(
        "x.*", "c.n", (F.col("_at") - F.col("_first") + F.coalesce("_before", F.lit(0))).alias("rank"))


def segments(nodes: DataFrame, span: int, *carried: str) -> DataFrame:
    """One row per aligned block of ``nodes`` (tree, rank, n, hash): ``SEGMENT`` and lists of the carried columns."""
    kept = [nodes.schema[c] for c in carried]
    schema = ", ".join([SEGMENT, *(f"{f.name} array<{f.dataType.simpleString()}>" for f in kept)])
    nodes = nodes.select("tree", F.expr(f"rank div {span}").alias("block"), "rank", "n", "hash", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def segment() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            leaves = [h.hex().encode() for h in rows.column("hash").to_pylist()]
            tree, block, n = (rows.column(c)[0].as_py() for c in ("tree", "block", "n"))
            log = append_log(leaves, levels_of(n, span))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(leaves)], pa.int32()), rows.column(c).combine_chunks())
                     for c in carried]
            return pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int64()), pa.array([block], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([bytes.fromhex(b"".join(log).decode())], pa.binary()), *lists],
                names=["tree", "block", "n", "log", *carried])

        for batch in batches:
            starts = np.flatnonzero(batch.column("rank").to_numpy() % span == 0).tolist()
            for k, (first, last) in enumerate(zip([0, *starts], [*starts, len(batch)], strict=True)):
                if k and held:
                    yield segment()
                    held = []
                if last > first:
                    held.append(batch.slice(first, last - first))
        if held:
            yield segment()

    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(run, schema)


def last_node(log: str = "log") -> Column:
    return F.expr(f"substring({log}, length({log}) - {DIGEST - 1}, {DIGEST})")


def grow(nodes: DataFrame, span: int, *carried: str) -> list[DataFrame]:
    """The written segments of all rounds, lowest first."""
    rounds = [write_and_read(segments(nodes, span, *carried), "segments")]
    while True:
        above = rounds[-1].filter(F.col("n") > span).select(
            "tree", F.col("block").alias("rank"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), last_node().alias("hash"))
        if above.isEmpty():
            return rounds
        rounds.append(write_and_read(segments(above, span), "segments"))


def roots(rounds: list[DataFrame], span: int) -> DataFrame:
    """(tree, hash) of every tree."""
    tops = [r.filter(F.col("n") <= span).select("tree", last_node().alias("hash")) for r in rounds]
    return reduce(DataFrame.unionByName, tops)


@dataclass(frozen=True)
class Manifest:
    """The append log: segments of the sources' trees (``rounds``) and of the tree over the sources (``over``), and the
    sources with the number of their tree."""

    rounds: list[DataFrame]
    over: list[DataFrame]
    sources: DataFrame
    span: int


def build(docs: DataFrame, now: Column | None = None, span: int = SPAN) -> Manifest:
    """The manifest of ``docs``; ``now`` is what the text is found to be later (by default the text). ``span``, the leaves
    of a block, is a power of ``FAN``."""
    docs = only(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    changed = F.lit(None).cast("binary") if now is None else F.when(~now.eqNullSafe(F.col("text")), leaf_hash(text=now))
    leaves = write_and_read(docs.select("doc_id", "source", leaf_hash().alias("hash"), changed.alias("now")).withColumn(
        "_row", F.monotonically_increasing_id()), "leaves")
    leaves = ranked(in_order(leaves, "ordered", "source", "doc_id", "hash", "_row"), "source")
    sources = in_order(leaves.select("source").distinct(), "sources", "source")
    sources = write_and_read(ranked(sources.withColumn("all", F.lit(0)), "all").select(
        F.col("rank").alias("tree"), "source", F.col("n").alias("n_sources")), "sources")
    named = leaves.alias("x").join(sources.alias("s"), F.col("x.source").eqNullSafe(F.col("s.source")))
    rounds = grow(named.select("tree", "rank", "n", "hash", "doc_id", "now"), span, "doc_id", "now")
    subroots = roots(rounds, span).join(sources, "tree")
    over = grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"),
                                F.col("n_sources").alias("n"), "hash"), span)
    return Manifest(rounds, over, sources, span)


# -- proofs -------------------------------------------------------------------

def below(found: DataFrame, span: int) -> DataFrame:
    """``PATH`` of every leaf of the segments ``found``, which have the path of their root: (tree, index, path)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            n, first = leaves_in(row["n"], row["block"], span), row["block"] * span
            lefts, rights = paths_in(row["log"], n, levels_of(row["n"], span), row["lefts"], row["rights"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                 pa.array(lefts, TEXTS), pa.array(rights, TEXTS)], names=["tree", "block", "lefts", "rights"])

    return found.select("tree", "block", "n", "log", "lefts", "rights").mapInArrow(run, PATH)


def paths_in(log: bytes, n: int, levels: int, lefts: list[str], rights: list[str]) -> tuple[list, list]:
    """Siblings to the left and to the right of every leaf of a segment, level by level up to the root of all."""
    steps = sibling_texts(nodes_of(log), n, levels)
    at = [[i // FAN ** level for level in range(levels)] for i in range(n)]
    return ([[steps[j][0][k] for j, k in enumerate(places)] + lefts for places in at],
            [[steps[j][1][k] for j, k in enumerate(places)] + rights for places in at])


def with_paths(rounds: list[DataFrame], tops: DataFrame, span: int) -> DataFrame:
    """The lowest segments with the path of their root; ``tops`` has that of the trees' roots: (tree, lefts, rights)."""
    tops, known = tops.withColumn("block", F.lit(0).cast("long")), None
    for log in reversed(rounds):
        found = log.filter(F.col("n") <= span).join(tops, ["tree", "block"])
        if known is not None:
            found = found.unionByName(log.filter(F.col("n") > span).join(known, ["tree", "block"]))
        known = below(found, span) if log is not rounds[0] else None
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """``PROVED`` and root for every row: its leaf, what the leaf is now (null if unchanged), its source's root, and the
    siblings left and right of the path from the leaf to the root, level by level, as joined hex text."""
    span, none = manifest.span, F.array().cast("array<string>")
    start = manifest.sources.select(F.lit(0).cast("long").alias("tree"), none.alias("lefts"), none.alias("rights")).limit(1)
    of_sources = below(with_paths(manifest.over, start, span), span).select(F.col("block").alias("tree"), "lefts", "rights")
    found = with_paths(manifest.rounds, write_and_read(of_sources, "paths"), span)
    subroots = roots(manifest.rounds, span).select("tree", F.lower(F.hex("hash")).alias("subroot"))
    root = roots(manifest.over, span).select(F.lower(F.hex("hash"))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            n, levels = leaves_in(row["n"], row["block"], span), levels_of(row["n"], span)
            leaves = nodes_of(row["log"])[place_in_log(0, np.arange(n), n, levels)].tolist()
            lefts, rights = paths_in(row["log"], n, levels, row["lefts"], row["rights"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_id"], pa.int64()), pa.array(leaves, pa.string()),
                 pa.array([h and h.hex() for h in row["now"]], pa.string()), pa.array([row["subroot"]] * n, pa.string()),
                 pa.array(lefts, TEXTS), pa.array(rights, TEXTS)],
                names=["doc_id", "leaf", "now", "subroot", "lefts", "rights"])

    return found.join(subroots, "tree").select("block", "n", "log", "doc_id", "now", "subroot", "lefts", "rights") \
        .mapInArrow(run, PROVED).withColumn("root", F.lit(root and root[0]))


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings give."""
    steps = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def audit(docs: DataFrame, now: Column) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the text ``now``) and verified."""
    rows = proofs(build(docs, now)).withColumn("proof_sha256", proof_digest(F.col("lefts"), F.col("rights"))) \
        .withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("lefts"), F.col("rights")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))

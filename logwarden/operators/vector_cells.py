"""Nearest vectors by cells (an inverted file): approximate with few cells probed, exact with all.

Centres of cells are fitted by k-means on a bounded sample; every vector is stored in the cell of its nearest centre.
A query looks into the ``probes`` cells whose centres are nearest and is compared there with the full vectors, so scores
are exact and only which vectors are seen is approximate. How many cells it takes to find ``RECALL`` of the nearest vectors
is measured on the sample when the index is built, and stored with it: few where vectors lie in clusters, most of them where
they do not.

Cells and queries meet in blocks: a cell of more than ``BLOCK_VECTORS`` vectors (equal vectors share one) is cut by hash,
and so are the queries of a cell beyond ``BLOCK_QUERIES``; each two blocks are one task group, which returns its best k per
query. Nothing is gathered on the driver but the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.operators.search import DENSE_TOP_K, TILE, best_rows, merge_best, node_type, top_k, unit
from logwarden.session import write_and_read

SAMPLE = 20_000  # vectors that the centres are fitted on
ROUNDS = 12
MOST_CELLS = 4_096
RECALL = 0.95
MEASURED = 500  # vectors of the sample that are asked of it
BLOCK_VECTORS = 50_000
BLOCK_QUERIES = 4_096
DIGITS = 6


@dataclass(frozen=True)
class CellIndex:
    """vectors(cell, node_id, embedding as unit vector), the centres of the cells (at most ``MOST_CELLS``), and how many of
    them to look into."""

    vectors: DataFrame
    centres: np.ndarray
    probes: int

    @staticmethod
    def read(spark: SparkSession, path: str) -> "CellIndex":
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        probes = spark.read.parquet(f"{path}/about").first().probes
        return CellIndex(spark.read.parquet(f"{path}/vectors"), np.array([r.centre for r in rows], "float64"), probes)


def k_means(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centres by cosine; an empty cell takes the vector that is worst served."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        of = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centres)) == 0)
        worst = np.argsort(near.max(axis=1), kind="stable")[:len(empty)]
        sums[empty[:len(worst)]] = sample[worst]
        centres = unit(sums)
    return centres


def sampled(vectors: DataFrame, most: int) -> np.ndarray:
    """Unit vectors: the ``most`` rows of least hash, in the order of the hash."""
    rows = vectors.select(F.xxhash64("node_id", "embedding").alias("h"), "embedding").orderBy("h").limit(most).collect()
    return unit(np.array([r.embedding for r in rows], "float64").reshape(len(rows), -1)) if rows else np.zeros((0, 0))


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, k: int = DENSE_TOP_K) -> int:
    """The least number of cells in which vectors of the sample find that share of their nearest ones there."""
    asked = sample[:MEASURED]
    near = asked @ sample.T
    best = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell for each vector
    cells = (sample @ centres.T).argmax(axis=1)
    found = np.bincount(np.take_along_axis(place, cells[best], axis=1).ravel(), minlength=len(centres)).cumsum()
    return int(np.searchsorted(found, recall * best.size)) + 1


def with_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(node_id, embedding, cells): the nearest cells of each vector, best first; the vector as unit vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit(np.vstack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype("float64")) \
                if len(batch) else np.zeros((0, centres.shape[1]))
            order = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node_id"), pa.array(list(vectors), pa.list_(pa.float64())),
                 pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=["node_id", "embedding", "cells"])

    kind = node_type(rows)
    return rows.select("node_id", "embedding").mapInArrow(run, f"node_id {kind}, embedding array<double>, cells array<int>")


def write_cells(chunks: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """Fit, assign and store ``chunks(node_id, embedding)``; by default the square root of their number of cells."""
    spark = chunks.sparkSession
    vectors = chunks.filter(F.size("embedding") > 0).select("node_id", "embedding")
    taken = sampled(vectors, sample)
    if cells is None:
        cells = min(MOST_CELLS, max(1, round(vectors.count() ** 0.5)))
    centres = k_means(taken, cells) if len(taken) else np.zeros((0, 0))
    if len(centres):
        stored = with_cells(vectors, centres, 1).select(F.get("cells", F.lit(0)).alias("cell"), "node_id", "embedding")
    else:
        stored = vectors.select(F.lit(0).alias("cell"), "node_id", F.col("embedding").cast("array<double>").alias("embedding"))
    # ordered by cell, so that a scan of some cells skips the rest of a file
    stored.repartitionByRange("cell", "node_id").sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>") \
        .write.parquet(f"{path}/centres")
    spark.createDataFrame([(probes_for(taken, centres) if len(centres) else 0,)], "probes int").write.parquet(f"{path}/about")
    return CellIndex.read(spark, path)


def search_cells(index: CellIndex, queries: DataFrame, k: int = DENSE_TOP_K, probes: int | None = None,
                 threshold: float | None = None) -> DataFrame:
    """Top ``k`` by cosine per query of ``queries(query_id, vector)``: (query_id, node_id, score, rank).

    ``probes`` cells are looked into, by default those of the index; with all of them the result is that of
    ``dense_search``.
    """
    n_cells = len(index.centres)
    probes = min(n_cells, probes or index.probes)
    asked = queries.filter(F.size("vector") > 0).select(
        F.col("query_id").cast("long").alias("node_id"), F.col("vector").alias("embedding"))
    if not n_cells:
        return top_k(asked.limit(0).select(F.col("node_id").alias("query_id"), "node_id", F.lit(0.0).alias("score")), k)
    probed = write_and_read(with_cells(asked, index.centres, probes).select(
        F.col("node_id").alias("query_id"), F.col("embedding").alias("vector"), F.explode("cells").alias("cell")), "probed")
    return top_k(met_in_blocks(index.vectors, probed, k, threshold), k).select("query_id", "node_id", "score", "rank")


def met_in_one_cell(nodes: DataFrame, asked: DataFrame, width: int, k: int, threshold: float | None) -> DataFrame:
    """All of ``nodes`` (node_id, embedding) against all of ``asked`` (query_id, vector), in blocks."""
    centre = np.eye(1, width)
    cell = F.lit(0).alias("cell")
    vectors = with_cells(nodes, centre, 1).select(cell, "node_id", "embedding")
    queries = with_cells(asked.select(F.col("query_id").alias("node_id"), F.col("vector").alias("embedding")), centre, 1)
    return met_in_blocks(vectors, queries.select(cell, F.col("node_id").alias("query_id"), F.col("embedding").alias("vector")),
                         k, threshold)


def met_in_blocks(vectors: DataFrame, probed: DataFrame, k: int, threshold: float | None,
                  block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, node_id, score): the best ``k`` of each two blocks of a cell's vectors and queries."""
    n_vectors = vectors.groupBy("cell").agg(F.ceil(F.count("*") / block_vectors).cast("int").alias("parts"))
    n_queries = probed.groupBy("cell").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("tiles"))
    sizes = write_and_read(n_vectors.join(n_queries, "cell"), "sizes")

    def block(column: str, n: str):
        return F.pmod(F.xxhash64(column), n).cast("int")

    left = vectors.join(sizes, "cell").select(
        "cell", block("node_id", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
        "node_id", "embedding")
    right = probed.join(sizes, "cell").select(
        F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"),
        block("query_id", "tiles").alias("of_tile"), "query_id", "vector")

    def run(key: tuple, nodes: pa.Table, asked: pa.Table) -> pa.Table:
        a, b = (np.array(t.column(c).to_pylist(), "float64") for t, c in ((asked, "vector"), (nodes, "embedding")))
        query_ids, node_ids = asked.column("query_id").to_numpy(), nodes.column("node_id").to_pandas().to_numpy()
        best = pd.DataFrame({"query_id": query_ids[:0], "node_id": node_ids[:0], "score": np.zeros(0)})
        at_once = max(1, TILE // max(1, len(a)))
        for first in range(0, len(b) if len(a) else 0, at_once):
            part = slice(first, first + at_once)
            found = best_rows(query_ids, np.round(a @ b[part].T, DIGITS), node_ids[part], k, threshold)
            best = merge_best(best if len(best) else None, found, k)
        return pa.Table.from_pandas(best, preserve_index=False)

    return left.groupBy("cell", "part", "tile").cogroup(right.groupBy("of", "of_part", "of_tile")).applyInArrow(
        run, f"query_id long, node_id {node_type(vectors)}, score double")

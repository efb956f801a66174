"""Knowledge ingestion: files to chunks with vectors, and a status per file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import is_blank
from logwarden.operators.knowledge import (
    chunk_docs, chunk_payload, embed, hashing_embed, mark_duplicates, validate_docs,
)
from logwarden.operators.updates import merge_chunks
from logwarden.session import write_and_read
from logwarden.sources.documents import (
    JSON_EXTENSIONS, TEXT_EXTENSIONS, extension, json_docs, json_objects, text_docs,
)
from logwarden.sources.tables import read_table, upsert


@dataclass(frozen=True)
class Ingestion:
    chunks: DataFrame
    files: DataFrame


def load_docs(files: DataFrame) -> DataFrame:
    """Documents of all supported files of ``files(path, content)``."""
    return text_docs(files).unionByName(json_docs(json_objects(files)))


def ingest_documents(files: DataFrame, stored: DataFrame | None = None,
                     encoder: Callable | None = None) -> Ingestion:
    """New chunks, and one row per document (or per file without one).

    Status is ``indexed``, ``skipped_duplicate``, ``skipped_unsupported`` or
    ``failed`` with a reason. ``stored`` holds earlier chunks. Without an encoder
    the hashing embedding is used. All documents of a file are indexed.
    """
    item = F.coalesce(F.try_element_at("metadata", F.lit("item")).try_cast("int"), F.lit(0))
    # two files of one path and one text are two documents, of which one is the first: rows are told apart by number
    docs = write_and_read(validate_docs(load_docs(files)).withColumn("_row", F.monotonically_increasing_id()), "documents")
    order = docs.select("_row", "doc_hash", "is_valid", "source_path", item.alias("_item"))
    marks = write_and_read(mark_duplicates(order, stored, "source_path", "_item", "_row").select("_row", "is_duplicate"), "marks")
    checked = docs.join(marks, "_row").drop("_row")
    status = (F.when(~F.col("is_valid"), "failed").when(F.col("is_duplicate"), "skipped_duplicate")
              .otherwise("indexed"))
    marked = checked.withColumn("status", status)

    fresh = marked.filter(F.col("status") == "indexed")
    rows = chunk_payload(chunk_docs(fresh))
    chunks = embed(rows, encoder) if encoder else hashing_embed(rows)
    chunks = write_and_read(chunks, "chunks")

    counts = chunks.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("chunks_indexed"))
    reason = (F.when(F.col("status") == "failed", F.concat(F.lit("Validation: "), F.col("reason")))
              .when(F.col("status") == "skipped_duplicate", "Document already indexed (same SHA-256)"))
    per_doc = marked.join(counts, "doc_hash", "left").select(
        F.col("source_path").alias("path"), "status", "doc_hash", reason.alias("reason"),
        F.when(F.col("status") == "indexed", F.col("chunks_indexed")).otherwise(0).cast("long").alias("chunks_indexed"))
    supported = extension(F.col("path")).isin(*TEXT_EXTENSIONS, *JSON_EXTENSIONS)
    is_text = F.coalesce(extension(F.col("path")).isin(*TEXT_EXTENSIONS), F.lit(False))
    # a text file gives a document unless it is blank, so each file of a repeated path is judged by itself
    given = per_doc.select("path").distinct()
    without = files.filter(is_text & F.coalesce(is_blank(F.col("content")), F.lit(True))).select("path").unionByName(
        files.filter(~is_text).select("path").join(given, "path", "left_anti")).select(
        "path", F.when(supported, "failed").otherwise("skipped_unsupported").alias("status"),
        F.lit(None).cast("string").alias("doc_hash"),
        F.when(supported, "Loader returned 0 documents").alias("reason"),
        F.lit(0).cast("long").alias("chunks_indexed"))
    return Ingestion(chunks, per_doc.unionByName(without))


def ingest_into(files: DataFrame, path: str, encoder: Callable | None = None) -> DataFrame:
    """Ingest files into the chunk table at ``path``: known documents are skipped, new chunks upserted by ``node_id``.

    Returns the file statuses.
    """
    result = ingest_documents(files, read_table(files.sparkSession, path), encoder)
    upsert(result.chunks, path, "node_id", merge_chunks)
    return result.files

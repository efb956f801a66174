"""Documents to chunks: validation, exact deduplication, chunking, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.functions.arrays import l2_normalise, let
from logwarden.functions.text import is_blank, strip, tokens, word_count

MIN_CHARS, MAX_CHARS, MIN_WORDS = 50, 5_000_000, 10
CHUNK_WORDS, OVERLAP_WORDS = 512, 64
EMBEDDING_DIM = 1024
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def validate_docs(docs: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with ``is_valid``, the first failed check as ``reason``, and warnings."""
    staged = docs.withColumn("_content", strip(F.coalesce("content", F.lit(""))))
    staged = staged.withColumn("_chars", F.length("_content")).withColumn("_words", word_count(F.col("_content")))
    chars, n_words = F.col("_chars"), F.col("_words")
    too_long = F.concat(F.lit("Content exceeds maximum size: "), F.format_number(chars, 0),
                        F.lit(f" chars (maximum is {max_chars:,})"))
    reason = (
        F.when(chars == 0, "Content is empty or whitespace-only")
        .when(chars < min_chars, F.concat(F.lit("Content too short: "), chars, F.lit(f" chars (minimum is {min_chars})")))
        .when(chars > max_chars, too_long)
        .when(n_words < min_words, F.concat(F.lit("Too few words: "), n_words, F.lit(f" (minimum is {min_words})")))
        .when(~F.is_valid_utf8("_content"), "UTF-8 encoding error")
        .when(is_blank(F.coalesce("source_path", F.lit(""))), "source_path is required but missing")
        .when(is_blank(F.coalesce("source_type", F.lit(""))), "source_type is required but missing"))
    warnings = F.array_compact(F.array(
        F.when(n_words < 50, F.concat(F.lit("Low word count ("), n_words,
                                      F.lit("); document may produce poor-quality chunks"))),
        F.when(chars < 200, "Very short document; may not chunk meaningfully — consider merging with related content"),
        F.when(F.coalesce("doc_hash", F.lit("")) == "", "doc_hash is empty; deduplication will not work for this document")))
    checked = staged.withColumn("reason", reason)
    return checked.select(
        *docs.columns, F.col("reason").isNull().alias("is_valid"), "reason",
        F.when(F.col("reason").isNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def mark_duplicates(docs: DataFrame, stored_hashes: DataFrame | None, *order: str | Column) -> DataFrame:
    """Documents with ``is_duplicate``: stored before, or a later copy in this batch.

    ``order`` must be unique within a hash. A document without a hash is no
    duplicate. The first copy of each hash comes from a map-side minimum, learns
    whether the hash is stored, and is joined back; a text copied into a third of
    the documents is then split over tasks by the skew join, where ranking its
    copies would sort them all in one.
    """
    keyed = docs.withColumn("_key", F.struct(*order))
    first = keyed.filter("doc_hash IS NOT NULL").groupBy("doc_hash").agg(
        F.min("_key").alias("_first"), F.lit(False).alias("_stored"))
    if stored_hashes is not None:
        known = stored_hashes.select("doc_hash").distinct().withColumn("_known", F.lit(True))
        first = first.drop("_stored").join(known, "doc_hash", "left").withColumn("_stored", F.col("_known").isNotNull())
    marked = keyed.join(first, "doc_hash", "left")
    later = F.coalesce((F.col("_key") > F.col("_first")) | F.col("_stored"), F.lit(False))
    return marked.select(*docs.columns, later.alias("is_duplicate"))


def drop_duplicate_docs(docs: DataFrame, stored_hashes: DataFrame | None, *order: str) -> DataFrame:
    """New documents only: the first copy of each hash that is not stored yet.

    Every task first keeps one copy per hash (group limit below the shuffle), so
    a text copied into a third of the documents is not gathered in one place.
    The stored hashes are looked up after that, with the copies already gone.
    Documents without a hash all stay.
    """
    first = Window.partitionBy("doc_hash").orderBy(*order)
    hashed = docs.filter("doc_hash IS NOT NULL")
    unique = hashed.withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") == 1).drop("_copy")
    if stored_hashes is not None:
        unique = unique.join(stored_hashes.select("doc_hash"), "doc_hash", "left_anti").select(*docs.columns)
    return unique.unionByName(docs.filter("doc_hash IS NULL"))


# -- Chunking -----------------------------------------------------------------

# A piece ends after a sentence mark before whitespace, or after a blank line.
_PIECE_END = r"(?<=[.!?])(?=\s)|(?<=\n\n)"


def _pieces(content: Column, size: int) -> Column:
    """Sentences whose concatenation is the content; over-long ones in windows."""
    window = rf"(?U)(?:\s*+\S++){{1,{size}}}\s*"
    sentences = F.filter(F.split(content, _PIECE_END), lambda s: s != "")
    windows = F.transform(sentences, lambda s: F.when(
        word_count(s) > size, F.regexp_extract_all(s, F.lit(window), 0)).otherwise(F.array(s)))
    return F.flatten(windows)


def _cuts(lens: Column, size: int, overlap: int) -> Column:
    """Greedy packing as a fold: array of (first, last) piece positions, 1-based.

    A full chunk is closed, and the next one starts with the last pieces of the
    closed one that fit the overlap. Every piece with words takes at least one,
    so looking back needs no more than ``overlap`` such pieces.
    """
    pair = "struct<first:int,last:int>"
    state = F.struct(
        F.array().cast(f"array<{pair}>").alias("done"), F.lit(1).alias("first"), F.lit(0).alias("last"),
        F.lit(0).alias("words"))

    def back(s: Column, n: Column) -> Column:
        """(first, words) of the next chunk: overlap taken from the closed one, room for ``n``."""
        lookback = F.least(s["last"] - s["first"], F.lit(overlap))
        tail = F.reverse(F.slice(lens, s["last"] - lookback + 1, lookback))
        start = F.struct(F.lit(0).alias("pieces"), F.lit(0).alias("words"), F.lit(True).alias("open"))

        def take(a: Column, x: Column) -> Column:
            fits = a["open"] & (a["words"] + x <= overlap) & (a["words"] + x + n <= size)
            return F.struct(
                (a["pieces"] + F.when(fits, 1).otherwise(0)).alias("pieces"),
                (a["words"] + F.when(fits, x).otherwise(0)).alias("words"), fits.alias("open"))

        return F.aggregate(tail, start, take)

    def step(s: Column, n: Column) -> Column:
        fits = (s["words"] + n <= size) | (s["words"] == 0)
        grown = F.struct(s["done"].alias("done"), s["first"].alias("first"),
                         (s["last"] + 1).alias("last"), (s["words"] + n).alias("words"))
        closed = let(back(s, n), lambda b: F.struct(
            F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))).alias("done"),
            (s["last"] + 1 - b["pieces"]).alias("first"), (s["last"] + 1).alias("last"),
            (b["words"] + n).alias("words")))
        return F.when(fits, grown).otherwise(closed)

    def finish(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))

    return F.aggregate(lens, state, step, finish)


def chunk_docs(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Sentence-aware chunks of at most ``size`` words, overlapping by up to ``overlap``.

    A chunk is a literal part of the content. Each document is packed in its own
    row; only finished chunks are exploded.
    """
    pieces = docs.filter(~is_blank(F.coalesce("content", F.lit("")))).withColumn("_pieces", _pieces(F.col("content"), size))
    lens = pieces.withColumn("_lens", F.transform("_pieces", word_count))
    cuts = lens.withColumn("_cuts", _cuts(F.col("_lens"), size, overlap))
    texts = cuts.withColumn("_chunks", F.transform("_cuts", lambda c: strip(
        F.array_join(F.slice("_pieces", c["first"], c["last"] - c["first"] + 1), ""))))
    keep = [c for c in docs.columns if c != "content"]
    return (texts.select(*keep, F.size("_chunks").alias("total_chunks"),
                         F.posexplode(F.array_compact("_chunks")).alias("chunk_index", "text"))
            .withColumn("node_id", F.sha2(F.concat_ws("#", "doc_hash", "source_path", "chunk_index"), 256)))


def chunk_payload(chunks: DataFrame) -> DataFrame:
    """What is stored with a vector: position, provenance ('' when unknown), counts."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c)
             for c in ("source_url", "technique_id", "cve_id", "severity")]
    return chunks.select(
        "node_id", "doc_hash", "source_path", "source_type", *blank, "chunk_index", "total_chunks", "text",
        "metadata", word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"))


# -- Embedding ----------------------------------------------------------------

def embed(df: DataFrame, encoder: Callable[[list[str]], "np.ndarray"], text: str = "text",
          prefix: str = "") -> DataFrame:
    """Rows with ``embedding``: unit vectors from a user's encoder, in Arrow batches.

    The encoder is shipped to the tasks; it may load its model on first use.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.asarray(encoder([prefix + t for t in batch[text]]), dtype="float64")
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = np.divide(vectors, norms, out=vectors, where=norms > 0).astype("float32")
                yield batch.assign(embedding=list(unit))

    return df.mapInPandas(encode, schema)


def embed_queries(queries: DataFrame, encoder: Callable[[list[str]], "np.ndarray"]) -> DataFrame:
    """Queries with ``vector``; blank ones are dropped, the instruction is put in front."""
    clean = queries.filter(~is_blank(F.col("query"))).withColumn("query", strip(F.col("query")))
    return embed(clean, encoder, "query", QUERY_PREFIX).withColumnRenamed("embedding", "vector")


def hashing_embed(df: DataFrame, text: str = "text", dim: int = EMBEDDING_DIM, output: str = "embedding") -> DataFrame:
    """A model-free embedding: hashed word counts, L2-normalised, without Python."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(
        df.withColumn("_tokens", tokens(F.col(text))))
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn(output, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


def normalise_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, l2_normalise(F.col(column)))

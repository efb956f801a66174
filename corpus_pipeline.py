"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.

1. language id: a byte network, fitted on labelled rows, rejects texts of no language (null, empty, or without a letter).
2. near duplicates: of texts linked by a Jaccard similarity of 0.8 or more of five-word shingles the one of least doc_id
   stays.
3. substring dedup: sentences of repeated spans go, but for their first occurrence; ``n_chars`` follows the text.
4. decontamination: documents with a twentieth or more of their words inside benchmark windows go.
5. packing: what is left is tokenised, cut and packed; one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import catalog, decontaminate, language_id, near_copies, sentence_dedup
from logwarden.session import write_and_read


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, catalog.language_network(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = sentence_dedup.remove_repeats(docs)
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, catalog.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return catalog.packed(docs).drop("copy")


STAGES = [("language id", language_stage), ("near duplicates", near_duplicate_stage), ("substring dedup", substring_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The language network and the tokenizer cannot be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

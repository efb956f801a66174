"""Incremental log ingestion: new files in a folder, the same jobs per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.operators.incidents import build_incidents
from logwarden.operators.iocs import log_iocs
from logwarden.operators.updates import ioc_rows
from logwarden.plans.log_run import process_lines
from logwarden.sources.logs import MAX_FILE_BYTES, decode, log_lines, read_big_log_lines
from logwarden.sources.tables import event_rows

BYTES_A_TASK = 4_000_000  # of text: some 50,000 lines, each with all the work of parsing, indicators and rules

_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def log_file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New log files as they land, of any size: path, modificationTime, length, content."""
    return (spark.readStream.format("binaryFile").schema(_BINARY_FILE)
            .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder))


def batch_lines(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, bytes_a_task: int = BYTES_A_TASK) -> DataFrame:
    """Numbered lines of a batch's files: whole files up to the limit, larger ones read again in splits.

    A batch has at most ``maxFilesPerTrigger`` files, so the paths of its large ones are few. A split packs files by their
    bytes, up to 128 MB of them in one task; the numbered lines are dealt over tasks of about ``bytes_a_task``.
    """
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // bytes_a_task))
    small = files.filter(F.col("length") <= max_bytes).select(
        F.xxhash64("path").alias("log_id"), decode(F.col("content")).alias("content"))
    large = [r.path for r in files.filter(F.col("length") > max_bytes).select("path").collect()]
    lines = log_lines(small)
    lines = lines.unionByName(read_big_log_lines(files.sparkSession, large)) if large else lines
    return lines.repartition(tasks)


def write_batch(files: DataFrame, batch_id: int, out: str, max_bytes: int = MAX_FILE_BYTES, **options) -> None:
    """Events, indicators and incidents of one micro-batch.

    Every table gets one folder per batch id, overwritten when a batch is
    repeated after a failure, so each file counts once. A file arrives in one
    batch, hence its log's indicators and incidents are complete in it.
    """
    spark = files.sparkSession
    target = {name: f"{out}/{name}/batch_id={batch_id}" for name in ("events", "iocs", "incidents")}
    _, events = process_lines(batch_lines(files, max_bytes), **options)
    event_rows(events).write.mode("overwrite").parquet(target["events"])
    stored = spark.read.schema(event_rows(events).schema).parquet(target["events"])
    rows = ioc_rows(log_iocs(stored), F.current_timestamp())
    rows.write.mode("overwrite").parquet(target["iocs"])
    build_incidents(stored).write.mode("overwrite").parquet(target["incidents"])


def stream_logs(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False,
                max_files: int = 1000, **options) -> StreamingQuery:
    """Start the stream; ``once`` processes what is there and stops."""
    writer = (log_file_stream(spark, folder, max_files).writeStream
              .option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, out, **options)))
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Logs that arrive in pieces: a stream whose tables are those of one run over the whole logs.

A log's pieces are files that end at a line end, such as ``web.log.part3``; their order is the number in their name, and a
piece comes in a later batch than, or in the same batch as, the pieces before it. What a log needs from its earlier pieces
is kept per log in a state table: how many lines it has, its type once that is decided, and, until ``SAMPLE_LINES`` lines
have come to decide it, those lines themselves (``held``). Lines are numbered through all pieces of a log.

Every batch stores, in folders of its own that a repeated batch overwrites: its events by date, the first occurrence of each
of its indicators, the parts of its incidents, and pieces too large to be read whole. Readers merge indicators and parts over
all batches (``stored_iocs``, ``stored_incidents``), so nothing stored earlier is read or written again. A row of the state
keeps what was before its last batch, so a batch repeated after a failure starts from the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.functions.text import is_blank
from logwarden.operators.classify import classify_events
from logwarden.operators.detect import SAMPLE_LINES, detect_log_type
from logwarden.operators.incidents import incident_parts, incidents_of, merge_parts
from logwarden.operators.iocs import add_event_iocs, log_iocs
from logwarden.operators.parse import default_formats, parse_logs
from logwarden.plans.log_run import with_log_type
from logwarden.session import write_and_read
from logwarden.sources.logs import LINE_BREAK, MAX_FILE_BYTES, decode
from logwarden.sources.tables import event_rows, read_table, upsert
from logwarden.streaming.log_stream import log_file_stream

PIECE = r"\.part(\d+)$"
HELD = "array<struct<line_number:int,raw_line:string>>"
KEPT = f"struct<lines:bigint,log_type:string,held:{HELD}>"
STATE = f"log_id long, log string, batch long, before {KEPT}, after {KEPT}"


def pieces_of(files: DataFrame, piece: str, max_bytes: int) -> DataFrame:
    """(log_id, log, number, path, length, lines): the texts of pieces by lines; null lines for a piece too large."""
    log = F.regexp_replace("path", piece, "")
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("path", piece, 1), F.lit("")), F.lit("999999999")), F.lit(0))
    text = F.when(F.col("length") <= max_bytes, decode(F.col("content")))
    lines = F.split(text, LINE_BREAK)
    whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return files.select(F.xxhash64(log).alias("log_id"), log.alias("log"), number.cast("long").alias("number"), "path", "length",
                        whole.alias("lines"))


def state_before(spark: SparkSession, out: str, batch: int, logs: DataFrame) -> DataFrame:
    """(log_id, lines, log_type, held) of the logs as they were before this batch."""
    stored = read_table(spark, f"{out}/state")
    if stored is None:
        stored = spark.createDataFrame([], STATE)
    base = F.when(F.col("batch") == batch, F.col("before")).otherwise(F.col("after")).alias("s")
    return stored.join(logs.select("log_id"), "log_id", "left_semi").select("log_id", base).select("log_id", "s.*")


def write_state(rows: DataFrame, out: str) -> None:
    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("log_id"), "log_id", "left_anti").unionByName(new)

    upsert(rows, f"{out}/state", "log_id", replaced)


def kept(lines: Column, log_type: Column, held: Column) -> Column:
    none = F.array().cast(HELD)
    return F.struct(lines.cast("long").alias("lines"), log_type.cast("string").alias("log_type"), F.coalesce(held, none).alias("held"))


def write_pieces(files: DataFrame, batch: int, out: str, piece: str = PIECE, max_bytes: int = MAX_FILE_BYTES,
                 last: bool = False, **options) -> None:
    """One micro-batch of ``files`` (path, length, content). ``last``: types are decided whatever has come."""
    spark = files.sparkSession
    pieces = pieces_of(files, piece, max_bytes)
    large = pieces.filter("lines IS NULL").select("log_id", "log", "path", "length", F.lit("too_large").alias("reason"))
    large.write.mode("overwrite").parquet(f"{out}/rejected_pieces/batch={batch}")
    pieces = pieces.filter("lines IS NOT NULL").withColumn("n", F.size("lines"))
    sizes = write_and_read(pieces.select("log_id", "log", "number", "path", "n"), "pieces")
    earlier = Window.partitionBy("log_id").orderBy("number", "path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("path", "earlier")
    logs = sizes.groupBy("log_id").agg(F.any_value("log").alias("log"), F.sum("n").alias("n"))
    before = state_before(spark, out, batch, logs)
    known = write_and_read(logs.join(before, "log_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0))), "known")

    numbered = pieces.join(offsets, "path").join(known.select("log_id", F.col("lines").alias("_before")), "log_id").select(
        "log_id", (F.col("_before") + F.col("earlier")).alias("_first"), F.posexplode("lines").alias("_at", "raw_line"))
    line = F.col("_first") + F.col("_at") + 1
    new = numbered.filter(~is_blank(F.col("raw_line"))).select("log_id", line.cast("int").alias("line_number"), "raw_line")
    store_lines(new, known, batch, out, last, **options)


def store_lines(new: DataFrame, known: DataFrame, batch: int, out: str, last: bool, assume_year: int | None = None, include_private: bool = False) -> None:
    """Events, indicators, incident parts and state of a batch: ``new`` lines of the logs ``known`` (log_id, log, n, lines,
    log_type, held)."""
    spark = new.sparkSession
    held = known.select("log_id", F.explode("held").alias("h")).select("log_id", "h.*")
    lines = write_and_read(new.unionByName(held), "lines")
    open_ = known.filter("log_type IS NULL").select("log_id")
    undecided = lines.join(open_, "log_id", "left_semi")
    enough = undecided.groupBy("log_id").agg(F.count("*").alias("c")).filter((F.col("c") >= SAMPLE_LINES) | F.lit(last)).select("log_id")
    found = detect_log_type(undecided.join(enough, "log_id", "left_semi")).select("log_id", "log_type")
    types = write_and_read(known.filter("log_type IS NOT NULL").select("log_id", "log_type").unionByName(found), "types")

    events = parse_logs(with_log_type(lines, types), assume_year, default_formats(assume_year))
    dated = event_rows(add_event_iocs(classify_events(events), include_private))
    target = {name: f"{out}/{name}/batch={batch}" for name in ("events", "iocs", "incident_parts")}
    dated.write.mode("overwrite").partitionBy("event_date").parquet(target["events"])
    stored = spark.read.schema(dated.schema).parquet(target["events"])
    log_iocs(stored).write.mode("overwrite").parquet(target["iocs"])
    incident_parts(stored).write.mode("overwrite").parquet(target["incident_parts"])

    waiting = undecided.join(types, "log_id", "left_anti").groupBy("log_id").agg(
        F.sort_array(F.collect_list(F.struct("line_number", "raw_line"))).alias("waiting"))  # under SAMPLE_LINES of a log
    state = known.join(types.withColumnRenamed("log_type", "now"), "log_id", "left").join(waiting, "log_id", "left")
    write_state(state.select(
        "log_id", "log", F.lit(batch).cast("long").alias("batch"),
        kept(F.col("lines"), F.col("log_type"), F.col("held")).alias("before"),
        kept(F.col("lines") + F.col("n"), F.col("now"), F.col("waiting")).alias("after")), out)


def flush_held(spark: SparkSession, out: str, batch: int, **options) -> None:
    """Decide the types of all logs that still wait for lines, as a batch of that number without pieces."""
    stored = read_table(spark, f"{out}/state")
    if stored is None:
        return
    base = F.when(F.col("batch") == batch, F.col("before")).otherwise(F.col("after")).alias("s")
    known = stored.select("log_id", "log", F.lit(0).cast("long").alias("n"), base).select("log_id", "log", "n", "s.*") \
        .filter("log_type IS NULL")
    none = spark.createDataFrame([], "log_id long, line_number int, raw_line string")
    store_lines(none, write_and_read(known, "known"), batch, out, True, **options)


def stream_pieces(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False, max_files: int = 1000,
                  piece: str = PIECE, **options) -> StreamingQuery:
    """Start the stream; ``once`` processes what is there and stops. A new start goes on where the last one ended."""
    writer = (log_file_stream(spark, folder, max_files).writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, batch: write_pieces(df, batch, out, piece, **options)))
    return (writer.trigger(availableNow=True) if once else writer).start()


# -- readers ------------------------------------------------------------------

def stored_events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/events")


def stored_iocs(spark: SparkSession, out: str) -> DataFrame:
    """As ``log_iocs`` of all events: the first occurrence of each indicator, and in how many events it is."""
    rows = spark.read.parquet(f"{out}/iocs").drop("batch")
    facts = [c for c in rows.columns if c not in ("log_id", "ioc_type", "value", "event_count")]
    merged = rows.groupBy("log_id", "ioc_type", "value").agg(
        F.min(F.struct("line_number", *(c for c in facts if c != "line_number"))).alias("f"), F.sum("event_count").alias("event_count"))
    return merged.select("log_id", "ioc_type", "value", *(F.col(f"f.{c}").alias(c) for c in facts), "event_count")


def stored_incidents(spark: SparkSession, out: str) -> DataFrame:
    return incidents_of(merge_parts(spark.read.parquet(f"{out}/incident_parts").drop("batch")))


def stored_logs(spark: SparkSession, out: str) -> DataFrame:
    """(log_id, log, log_type, line_count)"""
    return spark.read.parquet(f"{out}/state").select(
        "log_id", "log", F.col("after.log_type").alias("log_type"), F.col("after.lines").alias("line_count"))

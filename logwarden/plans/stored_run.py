"""A log run from upload to result tables: status changes, events, indicators, incidents, rejected lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.operators.incidents import build_incidents
from logwarden.operators.iocs import log_iocs
from logwarden.operators.updates import MAX_ERROR, apply_log_status, ioc_rows
from logwarden.plans.log_run import process_lines
from logwarden.session import write_and_read
from logwarden.sources.tables import event_rows, read_table

CHANGES = ("log_id long, status string, changed_at timestamp, log_type string, parsed_event_count long, ioc_count long, "
           "line_count long, error string, run string, step string")
TABLES = ("events", "iocs", "incidents", "rejected_lines")


@dataclass(frozen=True)
class StoredRun:
    logs: DataFrame
    events: DataFrame
    iocs: DataFrame
    incidents: DataFrame
    rejected_lines: DataFrame


def startable(logs: DataFrame) -> DataFrame:
    """Logs that a run may take: neither in processing nor completed."""
    return logs.filter(~F.col("status").isin("processing", "completed"))


def unparsed_lines(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines that gave no event."""
    return lines.join(events.select("log_id", "line_number"), ["log_id", "line_number"], "left_anti").select(
        "log_id", "line_number", "raw_line")


def changes_of(logs: DataFrame, status: str, at: Column, **columns: Column) -> DataFrame:
    """A status change of every log, in the form `apply_log_status` takes."""
    kinds = {"log_type": "string", "parsed_event_count": "long", "ioc_count": "long", "line_count": "long", "error": "string"}
    return logs.select("log_id", F.lit(status).alias("status"), at.alias("changed_at"), *[
        columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def stored_changes(spark: SparkSession, out: str) -> DataFrame:
    """Status changes of all runs: those of `changes_of`, with run and step (begun, ended)."""
    if read_table(spark, f"{out}/status_changes") is None:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(f"{out}/status_changes")


def write_changes(changes: DataFrame, out: str, run_id: str, step: str) -> None:
    changes.write.mode("overwrite").parquet(f"{out}/status_changes/run={run_id}/step={step}")


def claim(logs: DataFrame, out: str, run_id: str, started_at: Column) -> DataFrame:
    """The logs (log_id) that this run takes, stored as in processing before anything else is done.

    Logs that another run has claimed are left alone. Of runs that claim a log at once the one with the earliest start
    (then the least id) has it; the others take their claim back. A run that is repeated takes its own claims again, so a
    crash leaves logs in processing until then.
    """
    spark = logs.sparkSession
    others = stored_changes(spark, out).filter(F.col("run") != run_id).drop("run", "step")
    free = write_and_read(startable(apply_log_status(logs, others)).select("log_id"), "free")
    write_changes(changes_of(free, "processing", started_at), out, run_id, "begun")
    changes = stored_changes(spark, out)
    ended = changes.filter("step = 'ended'").filter(F.col("run") != run_id).select("log_id", "run")
    first = F.min(F.struct("changed_at", "run")).alias("first")
    winners = changes.filter("step = 'begun'").join(ended, ["log_id", "run"], "left_anti").groupBy("log_id").agg(first)
    taken = write_and_read(winners.filter(F.col("first.run") == run_id).select("log_id").join(free, "log_id", "left_semi"), "taken")
    write_changes(changes_of(taken, "processing", started_at), out, run_id, "begun")
    return taken


def run_and_store(logs: DataFrame, lines: DataFrame, out: str, run_id: str, started_at: Column, ended_at: Column,
                  **options) -> StoredRun:
    """Run the startable logs of ``logs(log_id, status, ...)`` and store their results under ``out``.

    Status changes are stored too: logs are in processing (`claim`) before their lines are read, and completed or failed at
    the end. Every table has one folder per run, overwritten when the run is repeated, and a log that completed is not run
    again; so nothing is stored twice, and no table is rewritten for a run. Events lie by date. The key of an indicator
    holds its log, which belongs to one completed run, so runs need no merge. If the run fails in Spark, its logs fail with
    the error and the run has no tables; any other error is raised once they have failed.
    """
    spark = logs.sparkSession
    path = {name: f"{out}/{name}/run={run_id}" for name in TABLES}
    taken = claim(logs, out, run_id, started_at)
    try:
        picked = lines.join(taken, "log_id", "left_semi")
        types, events = process_lines(picked, **options)
        dated = event_rows(events)
        dated.write.mode("overwrite").partitionBy("event_date").parquet(path["events"])
        stored = spark.read.schema(dated.schema).parquet(path["events"])
        ioc_rows(log_iocs(stored), ended_at).write.mode("overwrite").parquet(path["iocs"])
        build_incidents(stored).write.mode("overwrite").parquet(path["incidents"])
        unparsed_lines(picked, stored).write.mode("overwrite").parquet(path["rejected_lines"])
        tables = {name: spark.read.parquet(path[name]) for name in TABLES[1:]}
        counts = taken
        for table, name in ((stored, "events"), (tables["iocs"], "iocs"), (tables["rejected_lines"], "rejected")):
            counts = counts.join(table.groupBy("log_id").agg(F.count(F.lit(1)).alias(name)), "log_id", "left")
        n = {name: F.coalesce(name, F.lit(0)) for name in ("events", "iocs", "rejected")}
        ended = changes_of(counts.join(types.select("log_id", "log_type"), "log_id", "left"), "completed", ended_at,
                           log_type=F.col("log_type"), parsed_event_count=n["events"], ioc_count=n["iocs"],
                           line_count=n["events"] + n["rejected"])
        write_changes(ended, out, run_id, "ended")
    except Exception as error:
        write_changes(changes_of(taken, "failed", ended_at, error=F.lit(str(error)[:MAX_ERROR])), out, run_id, "ended")
        if not isinstance(error, PySparkException):
            raise
        stored, tables = None, dict.fromkeys(TABLES[1:])
    return StoredRun(apply_log_status(logs, stored_changes(spark, out).drop("run", "step")), stored, **tables)

"""State changes of logs and incidents, and merges of indicator and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.schemas import INCIDENT_STATUSES, LOG_STATUSES

MAX_CONTEXT, MAX_ERROR = 500, 2000  # stored widths of texts that are no part of a key


_STATE = ("struct<status:string,started:timestamp,ended:timestamp,type:string,events:long,iocs:long,lines:long,"
          "error:string>")


def _next_state(state: Column, change: Column) -> Column:
    """A log's state after one change: a completed log takes none, and one in processing cannot start again."""
    ended = change["status"].isin("completed", "failed")

    def kept(when: Column, new: str, old: str) -> Column:
        return F.when(when, change[new]).otherwise(state[old]).alias(old)

    completed = change["status"] == "completed"
    new = F.struct(
        change["status"].alias("status"), kept(change["status"] == "processing", "changed_at", "started"),
        kept(ended, "changed_at", "ended"), kept(completed, "log_type", "type"),
        kept(completed, "parsed_event_count", "events"), kept(completed, "ioc_count", "iocs"),
        kept(completed, "line_count", "lines"), kept(change["status"] == "failed", "error", "error")).cast(_STATE)
    refused = (state["status"] == "completed") | ((state["status"] == "processing") & (change["status"] == "processing"))
    return F.when(F.coalesce(refused, F.lit(False)), state).otherwise(new)


def apply_log_status(logs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply status changes to ``logs(log_id, status, ...)``, each log's in the order of time.

    ``changes(log_id, status, changed_at, log_type, parsed_event_count,
    ioc_count, line_count, error)``. A log's changes are a handful of small
    rows, so they are sorted and folded within one row.
    """
    columns = ("changed_at", "status", "log_type", "parsed_event_count", "ioc_count", "line_count", "error")
    news = changes.filter(F.col("status").isin(*LOG_STATUSES)).groupBy("log_id").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("_changes"))
    none = F.lit(None)
    before = F.struct(F.col("status").alias("status"), *[none.alias(n) for n in (
        "started", "ended", "type", "events", "iocs", "lines", "error")]).cast(_STATE)
    merged = logs.join(news, "log_id", "left").withColumn("_after", F.aggregate(
        F.coalesce("_changes", F.array().cast(news.schema["_changes"].dataType)), before, _next_state))
    target = {"status": F.col("_after.status"), "processing_started_at": F.col("_after.started"),
              "processing_completed_at": F.col("_after.ended"), "log_type": F.col("_after.type"),
              "parsed_event_count": F.col("_after.events"), "ioc_count": F.col("_after.iocs"),
              "line_count": F.col("_after.lines"), "parse_error": F.substring("_after.error", 1, MAX_ERROR)}
    return merged.select(*[
        F.coalesce(target[c], F.col(c)).alias(c) if c in target else F.col(c) for c in logs.columns])


def apply_incident_updates(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest valid status and assignee per incident; closing stamps ``closed_at``.

    ``updates(incident_id, status, assigned_to, updated_at)``; either value may
    be null, invalid states are ignored.
    """
    valid = updates.withColumn("status", F.when(F.col("status").isin(*INCIDENT_STATUSES), F.col("status")))

    def latest(column: str) -> Column:
        return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("updated_at")))

    closed = F.max(F.when(F.col("status") == "closed", F.col("updated_at")))
    news = valid.groupBy("incident_id").agg(
        latest("status").alias("_status"), latest("assigned_to").alias("_assignee"), closed.alias("_closed"))
    target = {"status": "_status", "assigned_to": "_assignee", "closed_at": "_closed"}
    return incidents.join(news, "incident_id", "left").select(*[
        F.coalesce(F.col(target[c]), F.col(c)).alias(c) if c in target else F.col(c) for c in incidents.columns])


def ioc_rows(log_iocs: DataFrame, seen_at: Column, true_counts: bool = False) -> DataFrame:
    """Per-log indicators as rows of the indicator table.

    An indicator counts once per log, as the per-log set holds it once;
    ``true_counts`` counts the events it occurs in instead.
    """
    count = F.col("event_count") if true_counts else F.lit(1)
    return log_iocs.select(
        "log_id", F.col("line_number").alias("event_line"), "ioc_type",
        "value", "confidence",
        F.substring("context", 1, MAX_CONTEXT).alias("context"), "source_field",
        count.cast("long").alias("occurrence_count"),
        seen_at.alias("first_seen"), seen_at.alias("last_seen"))


def merge_iocs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (log_id, ioc_type, value): add counts, keep the first row's facts."""
    both = existing.unionByName(new)
    facts = F.min(F.struct("first_seen", "event_line", "confidence", "source_field", "context"))
    merged = both.groupBy("log_id", "ioc_type", "value").agg(
        facts.alias("_f"), F.sum("occurrence_count").alias("occurrence_count"),
        F.max("last_seen").alias("last_seen"))
    return merged.select(
        "log_id", F.col("_f.event_line").alias("event_line"), "ioc_type", "value",
        F.col("_f.confidence").alias("confidence"), F.col("_f.context").alias("context"),
        F.col("_f.source_field").alias("source_field"), "occurrence_count",
        F.col("_f.first_seen").alias("first_seen"), "last_seen")


def merge_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by ``node_id``: new rows replace old ones with the same key."""
    kept = existing.join(new.select("node_id"), "node_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_by_doc_hash(chunks: DataFrame, doc_hash: str) -> tuple[DataFrame, DataFrame]:
    """(remaining chunks, one-row count of the deleted ones)."""
    doomed = F.col("doc_hash") == doc_hash
    return (chunks.filter(~F.coalesce(doomed, F.lit(False))),
            chunks.filter(doomed).agg(F.count(F.lit(1)).alias("deleted")))


def delete_by_doc_hashes(chunks: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `delete_by_doc_hash` for a table of hashes: (remaining, deleted per hash)."""
    doomed = hashes.select("doc_hash").distinct()
    deleted = chunks.join(doomed, "doc_hash", "left_semi").groupBy("doc_hash").agg(F.count(F.lit(1)).alias("deleted"))
    return chunks.join(doomed, "doc_hash", "left_anti"), deleted

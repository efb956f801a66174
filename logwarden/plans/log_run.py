"""The log run: lines to classified events, indicators and incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.operators.classify import classify_events
from logwarden.operators.detect import detect_log_type, detect_with_override
from logwarden.operators.incidents import build_incidents
from logwarden.operators.iocs import add_event_iocs, log_iocs
from logwarden.operators.parse import default_formats, parse_logs
from logwarden.operators.rules import RULES, Rule
from logwarden.session import write_and_read


@dataclass(frozen=True)
class LogRun:
    detected: DataFrame
    events: DataFrame
    iocs: DataFrame
    incidents: DataFrame


MAX_TYPES_SHIPPED = 2_000_000
ROWS_A_TASK = 50_000


def with_log_type(lines: DataFrame, types: DataFrame, most_shipped: int = MAX_TYPES_SHIPPED) -> DataFrame:
    """Lines with their log's type.

    Up to ``most_shipped`` logs (they are counted) travel to the lines, which
    stay in the tasks that read them. Left to estimated sizes, narrow lines are
    shipped themselves, or shuffled into a few tasks that parse them all. More
    logs meet the lines in a shuffle, and the lines are dealt out again by rows,
    so that neither a log with a large share of them nor a full partition is one task.
    """
    known = types.select("log_id", "log_type")
    if known.limit(most_shipped + 1).count() <= most_shipped:
        return lines.join(F.broadcast(known), "log_id")
    return lines.join(known, "log_id").repartition(max(1, -(-lines.count() // ROWS_A_TASK)))


def limit_events(events: DataFrame, max_events: int | None) -> DataFrame:
    """First ``max_events`` events per log; None keeps all."""
    if max_events is None:
        return events
    first = Window.partitionBy("log_id").orderBy("line_number")
    return events.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max_events).drop("_n")


def process_lines(lines: DataFrame, overrides: DataFrame | None = None, assume_year: int | None = None,
                  max_events: int | None = None, include_private: bool = False,
                  rules: tuple[Rule, ...] = RULES, formats: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(detected types, classified events with ``iocs``).

    ``overrides(log_id, force_log_type)`` names forced types. The types, one row
    per log, are detected once and written; the events are lazy.
    """
    detected = write_and_read(detect_log_type(lines), "detected")
    types = detected
    if overrides is not None:
        logs = detected.select("log_id").join(overrides, "log_id", "full_outer")
        types = write_and_read(detect_with_override(logs, detected), "types")
    events = parse_logs(with_log_type(lines, types), assume_year, formats or default_formats(assume_year))
    events = limit_events(events, max_events)
    # classified first, so that a filter on the score also spares the indicator scan
    return types, add_event_iocs(classify_events(events, rules), include_private)


def run_logs(lines: DataFrame, **options) -> LogRun:
    """All outputs of a run. The events are written once to the shared folder,
    because indicators and incidents both start from them."""
    detected, events = process_lines(lines, **options)
    stored = write_and_read(events, "events")
    return LogRun(detected, stored, log_iocs(stored), build_incidents(stored))

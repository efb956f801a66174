"""Filtered, ordered pages. Filters that are null or empty are skipped."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.operators.classify import THREAT_SCORE


def where(df: DataFrame, **equal: Any) -> DataFrame:
    for column, value in equal.items():
        if value is not None and value != "":
            df = df.filter(F.col(column) == value)
    return df


def page(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page; ``order`` must be total, so that pages do not overlap."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_counts(df: DataFrame, page_size: int = 20) -> DataFrame:
    """Total rows and pages; an empty result has one page."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / page_size)).alias("total_pages"))


def page_logs(logs: DataFrame, page_no: int = 1, page_size: int = 20, status: str | None = None,
              log_type: str | None = None, uploaded_by: int | None = None) -> DataFrame:
    picked = where(logs, status=status, log_type=log_type, uploaded_by=uploaded_by)
    return page(picked, [F.desc("created_at"), F.desc("log_id")], page_no, page_size)


def filter_events(events: DataFrame, log_id: int | None = None, severity: str | None = None,
                  event_type: str | None = None, source_ip: str | None = None,
                  technique_id: str | None = None) -> DataFrame:
    return where(events, log_id=log_id, severity=severity, event_type=event_type, source_ip=source_ip,
                 mitre_technique_id=technique_id)


def page_events(events: DataFrame, page_no: int = 1, page_size: int = 50, **filters: Any) -> DataFrame:
    picked = filter_events(events, **filters)
    return page(picked, [F.asc_nulls_last("line_number"), F.asc("log_id")], page_no, page_size)


def page_threats(events: DataFrame, page_no: int = 1, page_size: int = 50, log_id: int | None = None,
                 min_score: int = THREAT_SCORE) -> DataFrame:
    picked = where(events, log_id=log_id).filter(F.col("severity_score") >= min_score)
    return page(picked, [F.desc("severity_score"), F.asc("line_number"), F.asc("log_id")], page_no, page_size)


def page_iocs(iocs: DataFrame, page_no: int = 1, page_size: int = 50, log_id: int | None = None,
              ioc_type: str | None = None) -> DataFrame:
    """Within a log the most frequent first; over all logs the latest seen first."""
    key = [F.asc("log_id"), F.asc("ioc_type"), F.asc("value")]
    order = [F.desc("occurrence_count"), *key] if log_id is not None else [F.desc("last_seen"), *key]
    return page(where(iocs, log_id=log_id, ioc_type=ioc_type), order, page_no, page_size)


def search_iocs(iocs: DataFrame, text: str, ioc_type: str | None = None) -> DataFrame:
    """Values containing the text, ignoring case; ``%`` and ``_`` act as wildcards, a backslash is one."""
    if len(text.strip()) < 2:
        raise ValueError("search text needs at least 2 characters")
    pattern = text.strip().replace("\\", "\\\\")
    return where(iocs.filter(F.col("value").ilike(f"%{pattern}%")), ioc_type=ioc_type)


def page_incidents(incidents: DataFrame, page_no: int = 1, page_size: int = 20, status: str | None = None,
                   severity: str | None = None, assigned_to: int | None = None) -> DataFrame:
    picked = where(incidents, status=status, severity=severity, assigned_to=assigned_to)
    return page(picked, [F.desc("created_at"), F.asc("log_id"), F.asc("event_type"), F.asc("title")],
                page_no, page_size)


def recent_activity(audit: DataFrame, n: int = 50, user_id: int | None = None) -> DataFrame:
    """Newest ``n`` entries of a user, or of every user.

    The rank filter limits every user's rows before the shuffle.
    """
    if user_id is not None:
        return (audit.filter(F.col("user_id") == user_id)
                .orderBy(F.desc("created_at"), F.desc("audit_id")).limit(n))
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("audit_id"))
    return audit.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def scroll_chunks(chunks: DataFrame, filters: dict[str, Any] | None = None, limit: int = 100,
                  after: Any = None) -> DataFrame:
    """Chunks by equality filters in key order; ``after`` is the last key of the page before."""
    picked = where(chunks, **(filters or {}))
    if after is not None:
        picked = picked.filter(F.col("node_id") > after)
    return picked.orderBy("node_id").limit(limit)

"""Group counts, top-N and one-row reports over events, indicators and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.operators.classify import is_threat
from logwarden.operators.iocs import log_iocs
from logwarden.schemas import SEVERITIES
from logwarden.session import write_and_read


def for_log(df: DataFrame, log_id: int | None) -> DataFrame:
    return df if log_id is None else df.filter(F.col("log_id") == log_id)


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value of the columns, null values excluded."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def severity_breakdown(events: DataFrame, log_id: int | None = None) -> DataFrame:
    return group_counts(for_log(events, log_id), "severity")


def severity_breakdown_per_log(events: DataFrame) -> DataFrame:
    return group_counts(events, "log_id", "severity")


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def unique_ioc_values(iocs: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values; the exact count by two group-bys, so no task holds them all."""
    if approximate:
        return iocs.agg(F.approx_count_distinct("value").alias("unique_values"))
    return iocs.select("value").distinct().agg(F.count("value").alias("unique_values"))


def ioc_type_summary(iocs: DataFrame, log_id: int | None = None) -> DataFrame:
    return group_counts(for_log(iocs, log_id), "ioc_type").orderBy(F.desc("count"), "ioc_type")


def log_type_breakdown(logs: DataFrame) -> DataFrame:
    return group_counts(logs, "log_type")


def tactic_breakdown(events: DataFrame) -> DataFrame:
    return group_counts(events, "mitre_tactic")


def _top(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return group_counts(df, *columns).orderBy(F.desc("count"), *columns).limit(n)


def top_source_ips(events: DataFrame, n: int = 10, log_id: int | None = None) -> DataFrame:
    return _top(for_log(events, log_id), n, "source_ip")


def top_event_types(events: DataFrame, n: int = 10, log_id: int | None = None) -> DataFrame:
    return _top(for_log(events, log_id), n, "event_type")


def top_mitre_techniques(events: DataFrame, n: int = 10, log_id: int | None = None) -> DataFrame:
    return _top(for_log(events, log_id), n, "mitre_technique_id", "mitre_technique_name", "mitre_tactic")


def top_per_log(events: DataFrame, n: int, *columns: str) -> DataFrame:
    """The ``n`` most frequent values in every log, with a rank.

    Counting first leaves one row per log and value; the rank filter then limits
    groups before the second shuffle.
    """
    rank = Window.partitionBy("log_id").orderBy(F.desc("count"), *columns)
    return (group_counts(events.filter(F.col("log_id").isNotNull()), "log_id", *columns)
            .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n))


def top_ioc_values(iocs: DataFrame, ioc_type: str, n: int = 10) -> DataFrame:
    return (iocs.filter(F.col("ioc_type") == ioc_type).groupBy("value")
            .agg(F.sum("occurrence_count").alias("total_occurrences"))
            .orderBy(F.desc("total_occurrences"), "value").limit(n))


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s}_events") for s in SEVERITIES]


def pipeline_stats(events: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Run statistics per log: ``events`` classified with ``iocs``, ``line_counts(log_id, total_lines)``."""
    per_event = events.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("parsed_events"),
        F.sum(F.size("iocs").cast("long")).alias("iocs_extracted"),
        F.count_if(is_threat()).alias("threats_detected"),
        *_severity_counts())
    per_type = log_iocs(events).groupBy("log_id", "ioc_type").agg(
        F.count(F.lit(1)).alias("unique"), F.sum("event_count").alias("hits"))
    # at most one entry per indicator type, so the list is bounded
    per_log = per_type.groupBy("log_id").agg(
        F.sum("unique").alias("unique_iocs"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ioc_type", "hits")))).alias("ioc_type_counts"))
    counters = ["parsed_events", "iocs_extracted", "unique_iocs", "threats_detected",
                *[f"{s}_events" for s in SEVERITIES]]
    return (line_counts.join(per_event, "log_id", "left").join(per_log, "log_id", "left")
            .select("log_id", "total_lines",
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counters],
                    F.coalesce("ioc_type_counts", F.create_map().cast("map<string,bigint>")).alias("ioc_type_counts")))


def run_summary(detected: DataFrame, events: DataFrame, stats: DataFrame,
                top_ips: int = 5, top_techniques: int = 10) -> DataFrame:
    """Per log: type, rounded confidence, statistics, top addresses and techniques."""
    def ranked(df: DataFrame, name: str, *columns: str) -> DataFrame:
        # bounded by the rank filter
        entries = F.sort_array(F.collect_list(F.struct("rank", *columns, "count")))
        return df.groupBy("log_id").agg(entries.alias(name))

    ips = ranked(top_per_log(events, top_ips, "source_ip"), "top_source_ips", "source_ip")
    hits = ranked(top_per_log(events, top_techniques, "mitre_technique_id", "mitre_technique_name", "mitre_tactic"),
                  "mitre_hits", "mitre_technique_id", "mitre_technique_name", "mitre_tactic")
    return (detected.select("log_id", "log_type", F.round("confidence", 3).alias("detection_confidence"))
            .join(stats, "log_id", "left").join(ips, "log_id", "left").join(hits, "log_id", "left"))


def counted_sets(df: DataFrame, *sets: list[str], total: str | None = None) -> list[DataFrame]:
    """Rows per value of each set of columns (``count``, and the ``total`` of a column), from one pass over ``df``."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    sums = [F.sum(total).alias("total")] if total else []
    counts = write_and_read(df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("count"), *sums), "counts")
    bits = {c: 1 << k for k, c in enumerate(reversed(columns))}  # set where a column is left out
    return [counts.filter(F.col("_set") == sum(b for c, b in bits.items() if c not in s)).drop("_set") for s in sets]


def statistics(logs: DataFrame, events: DataFrame, iocs: DataFrame, incidents: DataFrame, n: int = 10) -> DataFrame:
    """The platform report as one row.

    Events and indicators are read once each: their groupings are sets of one
    aggregation, which combines on the map side and is written. Each part is one
    row of its own columns; the rows are united and folded, which needs no join.
    """
    def top_list(df: DataFrame, name: str) -> DataFrame:
        order = F.struct((-F.col(df.columns[-1])).alias("o"), *df.columns)
        ranked = F.sort_array(F.collect_list(order))
        return df.agg(F.transform(ranked, lambda r: F.struct(*[r[c].alias(c) for c in df.columns])).alias(name))

    def status(value: str) -> Column:
        return F.count_if(F.col("status") == value)

    techniques = ["mitre_technique_id", "mitre_technique_name", "mitre_tactic"]
    by_severity, by_type, by_technique = counted_sets(events, ["severity"], ["event_type"], techniques)
    by_ioc_type, by_value, by_both = counted_sets(iocs, ["ioc_type"], ["value"], ["ioc_type", "value"], total="occurrence_count")

    def most(counts: DataFrame, name: str, *columns: str) -> DataFrame:
        known = counts.filter(" AND ".join(f"{c} IS NOT NULL" for c in columns)).select(*columns, F.col(name))
        return known.orderBy(F.desc(name), *columns).limit(n)

    def severity(value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("severity") == value, F.col("count"))), F.lit(0)).alias(f"{value}_events")

    addresses = by_both.filter("ioc_type = 'ipv4'").withColumnRenamed("total", "total_occurrences")
    parts = [
        logs.agg(F.count(F.lit(1)).alias("total_logs"), status("pending").alias("logs_pending"),
                 status("processing").alias("logs_processing"), status("completed").alias("logs_completed"),
                 status("failed").alias("logs_failed")),
        by_severity.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_events"), *map(severity, SEVERITIES)),
        by_ioc_type.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_iocs")),
        by_value.agg(F.count("value").alias("unique_ioc_values")),
        top_list(by_ioc_type.filter("ioc_type IS NOT NULL").select("ioc_type", "count"), "ioc_type_summary"),
        incidents.agg(F.count(F.lit(1)).alias("total_incidents"), status("open").alias("open_incidents"),
                      F.count_if(F.col("severity") == "critical").alias("critical_incidents"),
                      F.count_if(F.col("severity") == "high").alias("high_incidents")),
        top_list(most(addresses, "total_occurrences", "value"), "top_source_ips"),
        top_list(most(by_technique, "count", *techniques), "top_mitre_techniques"),
        top_list(most(by_type, "count", "event_type"), "top_event_types"),
    ]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p, allowMissingColumns=True)
    return united.agg(*[F.first(c, ignorenulls=True).alias(c) for c in united.columns])


def ingestion_report(files: DataFrame) -> DataFrame:
    """Counts by file status, chunks and success rate of ``files(status, chunks_indexed)``."""
    def count(value: str) -> Column:
        return F.count_if(F.col("status") == value)

    total = F.count(F.lit(1))
    rate = F.when(total == 0, 0.0).otherwise(F.round(count("indexed") / total * 100, 1))
    return files.agg(
        total.alias("total_files"), count("indexed").alias("indexed_files"),
        count("skipped_duplicate").alias("skipped_duplicates"),
        count("skipped_unsupported").alias("skipped_unsupported"),
        count("failed").alias("failed_files"),
        F.coalesce(F.sum("chunks_indexed"), F.lit(0)).cast("long").alias("total_chunks_indexed"),
        rate.alias("success_rate_pct"))

"""Incidents from high-severity events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_INCIDENT_SCORE = 7
MAX_HOSTS = 1000
KEY = ("log_id", "event_type", "ip")


def _picked(events: DataFrame, min_score: int) -> DataFrame:
    ioc_count = F.size("iocs") if "iocs" in events.columns else F.lit(0)
    return events.filter(F.col("severity_score") >= min_score).select(
        "log_id", F.coalesce("event_type", F.lit("Unknown Event")).alias("event_type"),
        F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown")).alias("ip"),
        "line_number", "severity_score", "severity", "threat_category", "mitre_technique_id",
        "mitre_tactic", F.nullif("hostname", F.lit("")).alias("hostname"), ioc_count.cast("long").alias("n_iocs"))


def incident_hosts(events: DataFrame, min_score: int = MIN_INCIDENT_SCORE) -> DataFrame:
    """Every affected host of every incident, one row each: log_id, event_type, ip ('unknown' without one), hostname."""
    return _picked(events, min_score).filter("hostname IS NOT NULL").select(*KEY, "hostname").distinct()


def incident_parts(events: DataFrame, min_score: int = MIN_INCIDENT_SCORE, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """What the incidents of some of a log's events are made of, one row per key; `merge_parts` adds rows up.

    The events are read once and combine on the map side by key and host, so a group that holds most of a log's events is
    reduced before the shuffle; the second step works on the hosts of a key alone.
    """
    per_host = _picked(events, min_score).groupBy(*KEY, "hostname").agg(
        F.max(F.struct(F.col("severity_score"), (-F.col("line_number")).alias("order"),
                       F.col("severity"), F.col("threat_category"))).alias("primary"),
        F.count(F.lit(1)).alias("event_count"), F.sum("n_iocs").alias("ioc_count"),
        F.sort_array(F.collect_set("mitre_technique_id")).alias("techniques"),
        F.sort_array(F.collect_set("mitre_tactic")).alias("tactics"))
    return _whole(per_host, max_hosts)


def _whole(per_host: DataFrame, max_hosts: int) -> DataFrame:
    """Rows of keys and hosts as one row per key. Techniques and tactics are as few as the rules; of the hosts the first
    ``max_hosts`` stay."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("hostname")))
    listed = F.when(F.col("_n") <= max_hosts, F.col("hostname"))
    return per_host.withColumn("_n", first).groupBy(*KEY).agg(
        F.max("primary").alias("primary"), F.sum("event_count").alias("event_count"), F.sum("ioc_count").alias("ioc_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("techniques")))).alias("techniques"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("tactics")))).alias("tactics"),
        F.sort_array(F.collect_list(listed)).alias("hosts"))


def merge_parts(parts: DataFrame, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """Parts of several batches of events as those of all of them. Counts stay with the first host of a part."""
    rows = parts.select("*", F.posexplode_outer("hosts").alias("_at", "hostname"))
    once = lambda name: F.when(F.coalesce("_at", F.lit(0)) == 0, F.col(name)).otherwise(0)
    per_host = rows.groupBy(*KEY, "hostname").agg(
        F.max("primary").alias("primary"), F.sum(once("event_count")).alias("event_count"),
        F.sum(once("ioc_count")).alias("ioc_count"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("techniques")))).alias("techniques"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("tactics")))).alias("tactics"))
    return _whole(per_host, max_hosts)


def build_incidents(events: DataFrame, min_score: int = MIN_INCIDENT_SCORE, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """One open incident per log, event type and source address.

    ``events`` are classified; an ``iocs`` array is counted when present. Set-valued columns are sorted, and null when
    empty. The first ``max_hosts`` hosts are listed, and `incident_hosts` has them all.
    """
    return incidents_of(incident_parts(events, min_score, max_hosts))


def incidents_of(parts: DataFrame) -> DataFrame:
    def or_null(name: str):
        return F.when(F.size(name) > 0, F.col(name))

    listed = F.coalesce(F.nullif(F.array_join("techniques", ", "), F.lit("")), F.lit("N/A"))
    known_ip = F.when(F.col("ip") != "unknown", F.col("ip"))
    return parts.select(
        "log_id",
        F.concat_ws(" — ", "primary.threat_category", "event_type", known_ip).alias("title"),
        F.format_string("Auto-detected: %d event(s) of type '%s' from %s. MITRE: %s. Pipeline run on log_id=%d.",
                        "event_count", "event_type", "ip", listed, "log_id").alias("description"),
        F.col("primary.severity").alias("severity"),
        F.lit("open").alias("status"),
        "event_type", "event_count", "ioc_count",
        or_null("techniques").alias("mitre_techniques"),
        or_null("tactics").alias("mitre_tactics"),
        F.when(known_ip.isNotNull(), F.array(known_ip)).alias("source_ips"),
        or_null("hosts").alias("affected_hosts"))

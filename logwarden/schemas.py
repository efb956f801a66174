"""Table schemas and value domains, in one place so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The formats, states, indicator kinds and source kinds.
LOG_TYPES = ("windows_event", "linux_syslog", "apache_access", "nginx_access", "sysmon", "unknown")
LOG_STATUSES = ("pending", "processing", "completed", "failed")
IOC_TYPES = (
    "ipv4", "ipv6", "domain", "url", "email", "md5", "sha1", "sha256",
    "filename", "file_path", "cve", "username", "port",
)
INCIDENT_STATUSES = ("open", "investigating", "resolved", "closed", "false_positive")
SEVERITIES = ("critical", "high", "medium", "low", "info")
SOURCE_TYPES = ("mitre", "nvd", "sigma", "owasp", "cisa", "playbook", "custom")

LOG_LINES = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("raw_line", T.StringType()),
])

_STRINGS_MAP = T.MapType(T.StringType(), T.StringType())

EVENT_SCHEMA = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("log_type", T.StringType()),
    T.StructField("raw_line", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("process_name", T.StringType()),
    T.StructField("process_id", T.IntegerType()),
    T.StructField("command_line", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("http_status_code", T.IntegerType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("timestamp_raw", T.StringType()),
    T.StructField("event_timestamp", T.TimestampType()),
    T.StructField("normalized_data", _STRINGS_MAP),
    T.StructField("data_fields", _STRINGS_MAP),
])

# Columns the classifier adds to an event.
CLASSIFICATION_COLUMNS = (
    "severity", "severity_score", "mitre_technique_id", "mitre_technique_name",
    "mitre_tactic", "mitre_tactic_id", "sub_technique_id", "sub_technique_name",
    "threat_category", "confidence", "matched_rules", "tags", "is_classified",
)

IOC_TABLE = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("event_line", T.IntegerType()),
    T.StructField("ioc_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("context", T.StringType()),
    T.StructField("source_field", T.StringType()),
    T.StructField("occurrence_count", T.LongType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
])

DOC_SCHEMA = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("doc_hash", T.StringType()),
    T.StructField("technique_id", T.StringType()),
    T.StructField("cve_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("metadata", _STRINGS_MAP),
])

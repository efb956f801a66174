"""Format detection from the first non-blank lines of each log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.text import contains_any, is_blank, strip

SAMPLE_LINES = 30
CONFIDENCE_THRESHOLD = 0.40

# Per format (pattern, weight); the order of formats breaks ties.
SIGNATURES: dict[str, tuple[tuple[str, float], ...]] = {
    "sysmon": (
        (r"(?i)Microsoft-Windows-Sysmon", 4.0),
        (r"<EventID>(1|2|3|4|5|6|7|8|9|10|11|12|13|14|15|16|17|18|19|20|21|22|23|24|25|26|27|28|29)</EventID>", 3.0),
        (r'(?i)<Data\s+Name="(ProcessGuid|ProcessId|Image|CommandLine|CurrentDirectory|Hashes|ParentImage)"', 3.0),
        (r'(?i)<Data\s+Name="(TargetFilename|CreationUtcTime|SourceIp|DestinationIp|DestinationPort)"', 2.5),
        (r'(?i)<Data\s+Name="RuleName"', 2.5),
        (r"(?i)MD5=[A-Fa-f0-9]{32}|SHA256=[A-Fa-f0-9]{64}", 2.0),
    ),
    "windows_event": (
        (r"(?i)<Event\s+xmlns=", 3.0),
        (r"(?i)<EventID>?\d+</EventID>?", 2.5),
        (r"(?i)<Channel>.*</Channel>", 2.0),
        (r"(?i)<Provider\s+Name=", 2.0),
        (r"(?i)EventID\s*[=:]\s*\d+", 2.5),
        (r"(?i)Keywords\s*[=:]", 1.5),
        (r"(?i)Log Name\s*:", 2.0),
        (r"(?i)Source Name\s*:", 1.5),
        (r"(?i)Event Type\s*:", 1.5),
        (r"(?i)Security\s+ID\s*:", 1.5),
        (r"(?i)Account\s+Name\s*:", 1.0),
        (r"(?i)Logon\s+Type\s*:", 1.5),
        (r"(?i)ElfFile", 2.0),
    ),
    "linux_syslog": (
        (r"(?i)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", 3.0),
        (r"^<\d{1,3}>\d+\s+\d{4}-\d{2}-\d{2}T", 3.0),
        (r"(?i)\b(sshd|sudo|su|kernel|cron|systemd|auth|authpriv)\[?\d*\]?:", 2.5),
        (r"(?i)(Failed password|Accepted password|Invalid user|Disconnected from|authentication failure)", 2.0),
        (r"(?i)(sudo|su)\s*:.*TTY=", 2.0),
        (r"(?i)pam_unix\(", 1.5),
        (r"(?i)kernel:\s+\[[\d.]+\]", 2.0),
    ),
    "apache_access": (
        (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+-\s+-\s+\[\d{2}/\w+/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\]", 4.0),
        (r'"(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT)\s+/', 2.5),
        (r'HTTP/\d\.\d"\s+\d{3}\s+\d+', 2.5),
        (r"(?i)\[error\]|\[warn\]|\[notice\]|\[info\]|\[debug\]", 1.5),
        (r"(?i)AH\d{5}:", 2.0),
        (r'"-"\s+"Mozilla/', 1.0),
    ),
    "nginx_access": (
        (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+-\s+\S+\s+\[\d{2}/\w+/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\]", 3.5),
        (r"(?i)^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[(error|warn|notice|info|debug|crit|emerg|alert)\]", 3.5),
        (r"(?i)upstream|proxy_pass|fastcgi|uwsgi", 2.0),
        (r"(?i)(connect\(\) failed|no live upstreams|recv\(\) failed)", 2.0),
        (r'"(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+/', 1.5),
        (r"(?i)nginx/\d+\.\d+\.\d+", 2.5),
    ),
}

# By pattern, texts of which a line it matches holds one, in lower case. Most lines hold none of most, which spares
# them the pattern. Patterns that are tried at the start of a line alone have none.
_REQUEST = ('"',)
NEEDED: dict[str, tuple[str, ...]] = {
    "Microsoft-Windows-Sysmon": ("microsoft-windows-sysmon",), "<EventID>(1|": ("<eventid>",), "(ProcessGuid|": ('name="',),
    "(TargetFilename|": ('name="',), '"RuleName"': ('name="rulename"',), "MD5=": ("md5=", "sha256="), "xmlns=": ("xmlns=",),
    "<EventID>?": ("<eventid",), "<Channel>": ("<channel>",), "<Provider": ("<provider",), r"EventID\s": ("eventid",),
    "Keywords": ("keywords",), "Log Name": ("log name",), "Source Name": ("source name",), "Event Type": ("event type",),
    "Security": ("security",), "Account": ("account",), "Logon": ("logon",), "ElfFile": ("elffile",),
    "(sshd|": ("sshd", "su", "kernel", "cron", "systemd", "auth"),
    "(Failed password|": ("password", "invalid user", "disconnected from", "authentication failure"), "TTY=": ("tty=",),
    "pam_unix": ("pam_unix(",), r"kernel:\s": ("kernel:",), '"(GET|': _REQUEST, "HTTP/": ("http/",),
    r"(?i)\[error": ("[error]", "[warn]", "[notice]", "[info]", "[debug]"), "AH": ("ah",), '"Mozilla/': ("mozilla/",),
    "upstream|": ("upstream", "proxy_pass", "fastcgi", "uwsgi"), "(connect": ("connect() failed", "no live upstreams", "recv() failed"),
    "nginx/": ("nginx/",),
}


def needed_texts(pattern: str) -> tuple[str, ...]:
    known = [texts for part, texts in NEEDED.items() if part in pattern]
    return known[0] if known and not re.match(r"(\(\?i\))?\^", pattern) else ()


def sample_lines(lines: DataFrame, n: int = SAMPLE_LINES) -> DataFrame:
    """First ``n`` non-blank lines of every log, stripped.

    The rank filter becomes a group limit below the shuffle, so each task sends
    at most ``n`` lines per log however large the log is.
    """
    first = Window.partitionBy("log_id").orderBy("line_number")
    return (lines.filter(~is_blank(F.col("raw_line")))
            .select("log_id", "line_number", "raw_line")
            .withColumn("_rank", F.row_number().over(first))
            .filter(F.col("_rank") <= n)
            .select("log_id", "line_number", strip(F.col("raw_line")).alias("raw_line")))


def score_formats(samples: DataFrame) -> DataFrame:
    """Per log and format: weight of patterns hit by any sample line / all weights.

    A line's hits are the bits of one number, so a log's are their union.
    """
    bits, scores, place = F.lit(0).cast("long"), [], 0
    for log_type, patterns in SIGNATURES.items():
        matched = F.lit(0.0)
        for pattern, weight in patterns:
            hit, texts = F.col("raw_line").rlike(f"(?d){pattern}"), needed_texts(pattern)
            hit = contains_any(F.col("_lower"), *texts) & hit if texts else hit
            bits = bits.bitwiseOR(F.when(hit, F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long")))
            matched = matched + F.when(F.getbit("_bits", F.lit(place)) == 1, weight).otherwise(0.0)
            place += 1
        scores.append((matched / F.lit(sum(weight for _, weight in patterns))).alias(f"score_{log_type}"))
    lines = samples.select("log_id", "raw_line", F.lower("raw_line").alias("_lower")).select("log_id", bits.alias("_bits"))
    return lines.groupBy("log_id").agg(F.bit_or("_bits").alias("_bits")).select("log_id", *scores)


def _best(scores: DataFrame) -> DataFrame:
    best = F.array_max(F.array(*[
        F.struct(F.col(f"score_{t}").alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("type"))
        for i, t in enumerate(SIGNATURES)]))
    scored = scores.withColumn("_best", best)
    return scored.select(
        "log_id",
        F.when(F.col("_best.score") < CONFIDENCE_THRESHOLD, "unknown").otherwise(F.col("_best.type")).alias("log_type"),
        F.col("_best.score").alias("confidence"),
        *[f"score_{t}" for t in SIGNATURES])


def detect_log_type(lines: DataFrame, n: int = SAMPLE_LINES) -> DataFrame:
    """Detected type, confidence and all scores from the first ``n`` lines, one row per log with any text."""
    return _best(score_formats(sample_lines(lines, n)))


def detect_with_override(logs: DataFrame, detected: DataFrame) -> DataFrame:
    """Type and confidence of ``logs(log_id, force_log_type)``.

    A forced type wins with confidence 1; ``unknown`` counts as not forced; a
    log without text is unknown with confidence 0.
    """
    forced = F.nullif(F.col("force_log_type"), F.lit("unknown"))
    return (logs.select("log_id", "force_log_type")
            .join(detected.select("log_id", "log_type", "confidence"), "log_id", "left")
            .select("log_id",
                    F.coalesce(forced, F.col("log_type"), F.lit("unknown")).alias("log_type"),
                    F.when(forced.isNotNull(), 1.0)
                    .otherwise(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("confidence")))

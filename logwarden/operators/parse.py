"""Parsing by detected format, in one pass over the lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.operators.formats import LogFormat, parse_lines
from logwarden.operators.parse_sysmon import sysmon
from logwarden.operators.parse_syslog import linux_syslog
from logwarden.operators.parse_web import apache_access, nginx_access
from logwarden.operators.parse_windows import windows_event


def default_formats(assume_year: int | None = None) -> list[LogFormat]:
    return [windows_event(), linux_syslog(assume_year), apache_access(), nginx_access(), sysmon()]


def parse_syslog(lines: DataFrame, assume_year: int | None = None) -> DataFrame:
    return parse_lines(lines, [linux_syslog(assume_year)])


def parse_apache(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, [apache_access()])


def parse_nginx(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, [nginx_access()])


def parse_sysmon(lines: DataFrame, both_quotes: bool = False) -> DataFrame:
    return parse_lines(lines, [sysmon(both_quotes)])


def parse_windows(lines: DataFrame, both_quotes: bool = False) -> DataFrame:
    return parse_lines(lines, [windows_event(both_quotes)])


def parse_logs(lines: DataFrame, assume_year: int | None = None,
               formats: Sequence[LogFormat] | None = None,
               extra_parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Events of lines that carry their ``log_type``; other types give none.

    ``formats`` replaces the built-in formats; ``extra_parsers`` maps further
    log types to DataFrame -> DataFrame parsers of the caller.
    """
    events = parse_lines(lines, formats or default_formats(assume_year))
    for log_type, parser in (extra_parsers or {}).items():
        events = events.unionByName(parser(lines.filter(F.col("log_type") == log_type)),
                                    allowMissingColumns=True)
    return events

"""What a log format is, and how lines become events.

A format gives expression builders. `parse_lines` evaluates them in stages
so that every pattern runs once per line, and one pass serves all formats: each
stage is a CASE on the log type instead of one scan per format.

  header(line)                 packed header match, or null to drop the line
  data(line)                   map of named data fields (XML formats), or None
  detail(line, h, data)        packed second-level match, or None
  verdict(line, h, data, d)    event type
  fields(line, h, data, d, v)  event columns by name
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import explode_match, is_blank, unmark, unpack
from logwarden.schemas import EVENT_SCHEMA
from logwarden.session import once_per_session


@dataclass(frozen=True)
class LogFormat:
    name: str
    header: Callable[[Column], Column]
    verdict: Callable[[Column, Column, Column, Column], Column]
    fields: Callable[[Column, Column, Column, Column, Column], dict[str, Column]]
    data: Callable[[Column], Column] | None = None
    detail: Callable[[Column, Column, Column], Column] | None = None


def _by_type(formats: tuple[LogFormat, ...], pick: Callable[[LogFormat], Column | None]) -> Column | None:
    """CASE over the log type; a plain expression when there is one format."""
    branches = [(f.name, pick(f)) for f in formats]
    branches = [(name, col) for name, col in branches if col is not None]
    if not branches:
        return None
    if len(formats) == 1:
        return branches[0][1]
    case = F.when(F.col("log_type") == branches[0][0], branches[0][1])
    for name, col in branches[1:]:
        case = case.when(F.col("log_type") == name, col)
    return case


@once_per_session
def _stages(formats: tuple[LogFormat, ...]) -> tuple[Column, Column, Column, Column, list[Column]]:
    """The columns of all stages: header, data, detail, verdict, event columns."""
    line, h, data, d, v = (F.col(c) for c in ("_line", "_h", "_data", "_d", "_v"))
    header = _by_type(formats, lambda f: f.header(line))
    data_case = _by_type(formats, lambda f: f.data(line) if f.data else None)
    detail = _by_type(formats, lambda f: f.detail(line, h, data) if f.detail else None)
    verdict = _by_type(formats, lambda f: f.verdict(line, h, data, d))

    per_format = {f.name: f.fields(line, h, data, d, v) for f in formats}
    columns = [F.col("log_id"), F.col("log_type")]
    for field in EVENT_SCHEMA.fields[2:]:
        if field.name == "line_number":
            columns.append(F.col("line_number"))
            continue
        if field.name == "event_type":
            columns.append(v.alias("event_type"))
            continue
        default = line if field.name == "raw_line" else F.lit(None)
        value = _by_type(formats, lambda f, n=field.name, dflt=default: per_format[f.name].get(n, dflt))
        columns.append(value.cast(field.dataType).alias(field.name))
    none = F.lit(None)
    return (
        explode_match(header).alias("_packed"),
        none.cast("map<string,string>") if data_case is None else data_case,
        unpack(none.cast("string") if detail is None else detail),
        F.explode(F.array(verdict)).alias("_v"),
        columns)


def parse_lines(lines: DataFrame, formats: Iterable[LogFormat]) -> DataFrame:
    """Events of ``lines(log_id, line_number, raw_line[, log_type])``.

    With several formats each line is parsed by the one its ``log_type`` names;
    lines of other types give no event. With one format the column is not
    needed. Narrow transformation: no shuffle, no Python.

    The event type comes from a generator for the same reason as the header: a
    later filter on it must not repeat the patterns that decide it.
    """
    formats = tuple(formats)
    header, data, detail, verdict, columns = _stages(formats)
    log_type = F.lit(formats[0].name) if len(formats) == 1 else F.col("log_type")
    return (lines.filter(~is_blank(F.col("raw_line")))
            .select(F.col("log_id").cast("long").alias("log_id"),
                    F.col("line_number").cast("int").alias("line_number"),
                    log_type.alias("log_type"),
                    unmark(F.col("raw_line")).alias("_line"))
            .select("*", header)
            .withColumn("_h", unpack(F.col("_packed"))).drop("_packed")
            .withColumn("_data", data).withColumn("_d", detail).select("*", verdict)
            .select(*columns))

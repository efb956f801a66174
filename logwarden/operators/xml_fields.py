"""Named data elements of one-line XML events, shared by Sysmon and Windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.arrays import let
from logwarden.functions.text import strip

# Fixed values: <Data Name='..'>value</Data>; `BOTH_QUOTES` also takes Name="..".
SINGLE_QUOTES = r"(?i)<Data\s+Name='([^']+)'>([^<]*)</Data>"
BOTH_QUOTES = r"(?i)<Data\s+Name=['\"]([^'\"]+)['\"]>([^<]*)</Data>"
EVENT_ID = r"(?i)<EventID>(\d+)</EventID>"
COMPUTER = r"(?i)<Computer>([^<]+)</Computer>"
SYSTEM_TIME = r"(?i)SystemTime='([^']+)'"
SYSTEM_TIME_BOTH = r"(?i)SystemTime=['\"]([^'\"]+)['\"]"


def data_map(line: Column, pattern: str, strip_values: bool) -> Column:
    """Lower-cased name -> value; the last of repeated names wins.

    Built from distinct names, so it does not depend on the session's policy
    for duplicate map keys.
    """
    names = F.reverse(F.transform(F.regexp_extract_all(line, F.lit(pattern), 1), F.lower))
    values = F.reverse(F.regexp_extract_all(line, F.lit(pattern), 2))

    def build(p: Column) -> Column:
        def last_value(k: Column) -> Column:
            value = F.get(p["v"], (F.array_position(p["n"], k) - 1).cast("int"))
            return strip(value) if strip_values else value

        keys = F.array_distinct(p["n"])
        return F.map_from_arrays(keys, F.transform(keys, last_value))

    return let(F.struct(names.alias("n"), values.alias("v")), build)


def field(data: Column, name: str) -> Column:
    """Value of a field, '' when it is empty, null when it is absent."""
    return F.try_element_at(data, F.lit(name))


def field_or_blank(data: Column, name: str) -> Column:
    return F.coalesce(field(data, name), F.lit(""))


def digits(text: Column) -> Column:
    """Decimal number text without leading zeros."""
    return F.regexp_replace(text, r"^0+(?=\d)", "")


def literal_map(pairs: dict[int, str]) -> Column:
    entries: list[Column] = []
    for key, value in pairs.items():
        entries += [F.lit(str(key)), F.lit(value)]
    return F.create_map(*entries)

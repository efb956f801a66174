"""Windows event log: one-line XML, lines with an event id, and field lines."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.text import capture, first_group, iso_timestamp, packed, strip, to_int
from logwarden.operators import xml_fields as X
from logwarden.operators.formats import LogFormat

# Event id -> type.
EVENT_TYPES = {
    4624: "Successful Login", 4625: "Failed Login", 4627: "Group Membership",
    4648: "Explicit Credential Logon", 4656: "Object Access", 4663: "Object Access",
    4672: "Privilege Escalation", 4688: "Process Creation", 4698: "Scheduled Task Created",
    4699: "Scheduled Task Deleted", 4702: "Scheduled Task Modified", 4720: "User Account Created",
    4722: "User Account Enabled", 4724: "Password Reset", 4725: "User Account Disabled",
    4726: "User Account Deleted", 4732: "Security Group Modified", 4740: "Account Lockout",
    4768: "Kerberos TGT Request", 4769: "Kerberos Service Ticket", 4771: "Kerberos Pre-auth Failure",
    4776: "NTLM Authentication", 7045: "Service Installed", 4657: "Registry Value Modified",
    4660: "Object Deleted", 4670: "Permissions Changed",
}
# Line and field patterns.
ID_LINE = r"(?i)Event\s*ID\s*[:\s=]\s*(\d+)"
XML_ID = r"(?i)<EventID[^>]*>(\d+)</EventID>"
ACCOUNT_NAME = r"(?i)Account\s+Name\s*:\s*(\S+)"
SOURCE_IP = r"(?i)(?:Source Network Address|Client Address|Network Address)\s*:\s*([\d.:a-fA-F]+)"
SOURCE_PORT = r"(?i)(?:Source Port|Client Port)\s*:\s*(\d+)"
PROCESS_NAME = r"(?i)(?:Process Name|New Process Name)\s*:\s*(.+)"
PROCESS_ID = r"(?i)(?:New Process ID|Process ID)\s*:\s*0x([0-9a-fA-F]+)"
COMMAND_LINE = r"(?i)(?:Command Line|Process Command Line)\s*:\s*(.+)"
DEST_ADDRESS = r"(?i)(?:Destination Address|Network Destination Address)\s*:\s*([\d.:a-fA-F]+)"
DEST_PORT = r"(?i)(?:Destination Port)\s*:\s*(\d+)"
DATE_TIME = (r"(?i)(?:Date|Date and Time|Logged)\s*:\s*"
             r"(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM)?)")
ISO_TIME = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))"
IGNORED_ACCOUNTS = ("-", "SYSTEM")
IGNORED_SOURCES = ("-", "::1", "127.0.0.1")

_KIND, _ID = range(2)


def _unless(value: Column, ignored: tuple[str, ...]) -> Column:
    return F.when(~value.isin(*ignored), value)


def _username(line: Column) -> Column:
    return _unless(first_group(line, ACCOUNT_NAME), IGNORED_ACCOUNTS)


def _source_ip(line: Column) -> Column:
    return _unless(first_group(line, SOURCE_IP), IGNORED_SOURCES)


def _stripped(line: Column, pattern: str) -> Column:
    return F.nullif(strip(first_group(line, pattern)), F.lit(""))


def _header(line: Column) -> Column:
    """Kind of line and its id; a field line counts only if a main field is usable."""
    usable = F.coalesce(_username(line), _source_ip(line), _stripped(line, PROCESS_NAME),
                        _stripped(line, COMMAND_LINE))
    return F.when(strip(line).startswith("<Event"), capture(line, XML_ID, ["xml", "$1"], search=True)).otherwise(
        F.coalesce(capture(line, ID_LINE, ["id", "$1"], search=True),
                   F.when(line.contains(":") & usable.isNotNull(), packed("field", ""))))


def windows_timestamp(text: Column) -> Column:
    """US date with 12- or 24-hour time, else ISO."""
    us = F.concat(F.regexp_replace(strip(text), r"\s+", " "), F.lit(" +0000"))
    return F.coalesce(F.try_to_timestamp(us, F.lit("M/d/yyyy h:m:s a Z")),
                      F.try_to_timestamp(us, F.lit("M/d/yyyy H:m:s Z")),
                      iso_timestamp(strip(text)))


def _data(pattern: str):
    def data(line: Column) -> Column:
        return F.when(strip(line).startswith("<Event"), X.data_map(line, pattern, strip_values=False))

    return data


def _event_id(h: Column) -> Column:
    return X.digits(F.nullif(F.get(h, F.lit(_ID)), F.lit("")))


def _verdict(line: Column, h: Column, data: Column, d: Column) -> Column:
    return F.coalesce(F.try_element_at(X.literal_map(EVENT_TYPES), _event_id(h)), F.lit("Windows Event"))


def _fields_for(system_time: str):
    def fields(line: Column, h: Column, data: Column, d: Column, v: Column) -> dict[str, Column]:
        kind = F.get(h, F.lit(_KIND))
        is_xml = kind == "xml"
        event_id = _event_id(h)

        def pick(first: str, second: str) -> Column:
            return F.coalesce(F.nullif(X.field(data, first), F.lit("")), X.field(data, second))

        xml_time = first_group(line, system_time)
        text_time = F.when(kind == "id", F.coalesce(first_group(line, DATE_TIME), first_group(line, ISO_TIME)))
        raw_time = F.when(is_xml, xml_time).otherwise(text_time)
        xml_port = pick("ipport", "sourceport")
        return {
            "hostname": F.when(is_xml, first_group(line, X.COMPUTER)),
            "timestamp_raw": raw_time,
            "event_timestamp": windows_timestamp(raw_time),
            "username": F.when(is_xml, pick("targetusername", "subjectusername")).otherwise(_username(line)),
            "source_ip": F.when(is_xml, pick("ipaddress", "sourceaddress")).otherwise(_source_ip(line)),
            "source_port": F.when(is_xml, F.when(xml_port.rlike(r"^\d+$"), to_int(xml_port)))
                            .otherwise(to_int(first_group(line, SOURCE_PORT))),
            "process_name": F.when(is_xml, pick("newprocessname", "processname"))
                             .otherwise(_stripped(line, PROCESS_NAME)),
            "process_id": F.when(~is_xml, F.conv(first_group(line, PROCESS_ID), 16, 10).try_cast("int")),
            "command_line": F.when(is_xml, X.field(data, "commandline"))
                             .otherwise(_stripped(line, COMMAND_LINE)),
            "dest_ip": F.when(~is_xml, first_group(line, DEST_ADDRESS)),
            "dest_port": F.when(~is_xml, to_int(first_group(line, DEST_PORT))),
            "data_fields": data,
            "normalized_data": F.when(event_id.isNotNull(), F.create_map(F.lit("event_id"), event_id)),
        }

    return fields


@cache
def windows_event(both_quotes: bool = False) -> LogFormat:
    pattern = X.BOTH_QUOTES if both_quotes else X.SINGLE_QUOTES
    return LogFormat("windows_event", _header, _verdict,
                     _fields_for(X.SYSTEM_TIME_BOTH if both_quotes else X.SYSTEM_TIME), data=_data(pattern))

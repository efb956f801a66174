"""Sysmon XML events, one per line."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.text import capture, first_group, iso_timestamp, part, strip, to_int
from logwarden.operators import xml_fields as X
from logwarden.operators.formats import LogFormat

# Event id -> type.
EVENT_TYPES = {
    1: "Process Creation", 2: "File Timestamp Modified", 3: "Network Connection",
    5: "Process Terminated", 7: "DLL Loaded", 8: "Remote Thread Created", 10: "Process Access",
    11: "File Created", 12: "Registry Key Created", 13: "Registry Value Set",
    15: "Alternate Data Stream", 17: "Pipe Created", 18: "Pipe Connected", 22: "DNS Query",
    23: "File Deleted", 25: "Process Tampering",
}
# Detection patterns.
LOLBIN = (r"(?i)\\(powershell|cmd|wscript|cscript|mshta|rundll32|regsvr32|certutil|bitsadmin|msiexec|wmic|"
          r"msbuild|installutil|cmstp|odbcconf|regasm|regsvcs|xwizard|appsyncpublishingserver)\.exe")
OFFICE_PARENT = r"(?i)\\(word|excel|outlook|winword|powerpnt)\.exe"
LSASS = r"(?i)lsass\.exe"
ENCODED_COMMAND = r"(?i)-(?:enc|encode|encodedcommand)\s+[A-Za-z0-9+/=]{4,}"
SUSPICIOUS_PATH = (r"(?i)(\\temp\\|\\appdata\\|\\public\\|\\programdata\\|\\windows\\temp\\|/tmp/|"
                   r"\\users\\public\\)")
CREDENTIAL_TOOL = r"(?i)(sekurlsa|kerberos::ptt|lsadump|privilege::debug|token::elevate)"
C2_PORTS = (4444, 5555, 8080, 8443, 1337, 31337, 6666, 6667)
PERSISTENCE_KEYS = (r"\software\microsoft\windows\currentversion\run", r"\system\currentcontrolset\services")

_ID, = range(1)


def _header(line: Column) -> Column:
    return capture(line, X.EVENT_ID, ["$1"], search=True)


def _basename(path: Column) -> Column:
    return F.when(path != "", F.substring_index(path, "\\", -1))


def event_type(event_id: Column, data: Column) -> Column:
    """Type by id, refined by the event's fields; the first condition wins."""
    image, parent = X.field_or_blank(data, "image"), X.field_or_blank(data, "parentimage")
    command, target = X.field_or_blank(data, "commandline"), X.field_or_blank(data, "targetimage")
    signature = F.lower(X.field_or_blank(data, "signaturestatus"))
    loaded = F.coalesce(F.nullif(X.field(data, "imagepath"), F.lit("")), X.field(data, "imageloaded"))
    key = F.lower(X.field_or_blank(data, "targetobject"))

    def when_id(*ids: int) -> Column:
        return event_id.isin([str(i) for i in ids])

    process = (F.when(command.rlike(CREDENTIAL_TOOL), "Credential Dumping Attempt")
               .when(command.rlike(ENCODED_COMMAND), "Encoded PowerShell")
               .when(parent.rlike(OFFICE_PARENT) & image.rlike(LOLBIN), "Suspicious Child Process")
               .when(image.rlike(LOLBIN), "LOLBin Execution"))
    refined = (
        F.when(when_id(1), process)
        .when(when_id(3), F.when(to_int(strip(X.field(data, "destinationport"))).isin(*C2_PORTS),
                                 "Suspicious Network Connection"))
        .when(when_id(7), F.when(loaded.rlike(SUSPICIOUS_PATH), "DLL from Suspicious Path")
              .when(~signature.isin("valid", ""), "Unsigned DLL Loaded"))
        .when(when_id(8), F.when(target.rlike(LSASS), "LSASS Injection"))
        .when(when_id(10), F.when(target.rlike(LSASS), "LSASS Access (Credential Dump)"))
        .when(when_id(11), F.when(X.field(data, "targetfilename").rlike(SUSPICIOUS_PATH),
                                  "File Created in Suspicious Location"))
        .when(when_id(12, 13), F.when(key.contains(PERSISTENCE_KEYS[0]) | key.contains(PERSISTENCE_KEYS[1]),
                                      "Registry Persistence")))
    by_id = F.try_element_at(X.literal_map(EVENT_TYPES), event_id)
    return F.coalesce(refined, by_id, F.concat(F.lit("Sysmon Event "), event_id))


def _id(h: Column) -> Column:
    return X.digits(F.get(h, F.lit(_ID)))


def _verdict(line: Column, h: Column, data: Column, d: Column) -> Column:
    return event_type(_id(h), data)


def _fields_for(system_time: str):
    def fields(line: Column, h: Column, data: Column, d: Column, v: Column) -> dict[str, Column]:
        def is_id(*ids: int) -> Column:
            return _id(h).isin([str(i) for i in ids])

        def get(name: str) -> Column:
            return X.field(data, name)

        def text(name: str) -> Column:
            return X.field_or_blank(data, name)

        def number(name: str) -> Column:
            return to_int(strip(get(name)))

        image_events = is_id(1, 3, 7, 11, 12, 13, 22, 23)
        thread_events = is_id(8, 10)
        raw_time = first_group(line, system_time)
        return {
            "hostname": F.coalesce(
                F.when(is_id(3), F.nullif(get("destinationhostname"), F.lit(""))),
                strip(first_group(line, X.COMPUTER))),
            "timestamp_raw": F.coalesce(raw_time, F.lit("")),
            "event_timestamp": iso_timestamp(raw_time),
            "process_name": F.when(image_events, _basename(get("image")))
                             .when(thread_events, _basename(get("sourceimage"))),
            "process_id": F.when(is_id(1), number("processid")),
            "command_line": F.when(is_id(1), get("commandline")),
            "username": F.when(is_id(1, 3), get("user")),
            "source_ip": F.when(is_id(3), get("sourceip")),
            "dest_ip": F.when(is_id(3), get("destinationip")),
            "source_port": F.when(is_id(3), number("sourceport")),
            "dest_port": F.when(is_id(3), number("destinationport")),
            "protocol": F.when(is_id(3), F.upper(F.coalesce(get("protocol"), F.lit("tcp")))),
            "file_path": F.when(is_id(1), get("image"))
                          .when(is_id(7), F.coalesce(F.nullif(get("imagepath"), F.lit("")), get("imageloaded")))
                          .when(is_id(11, 23), get("targetfilename"))
                          .when(is_id(12, 13), get("targetobject")),
            "url": F.when(is_id(22), get("queryname")),
            "data_fields": data,
            "normalized_data": F.create_map(
                F.lit("event_id"), _id(h),
                F.lit("suspicious_path"), F.when(is_id(1) & text("image").rlike(SUSPICIOUS_PATH), "true"),
                F.lit("signature_status"), F.when(is_id(7), text("signaturestatus")),
                F.lit("hashes"), F.when(is_id(1, 7), text("hashes")),
                F.lit("parent_image"), F.when(is_id(1), text("parentimage")),
                F.lit("source_image"), F.when(is_id(8), text("sourceimage")),
                F.lit("target_image"), F.when(thread_events, text("targetimage")),
                F.lit("start_address"), F.when(is_id(8), text("startaddress")),
                F.lit("granted_access"), F.when(is_id(10), text("grantedaccess")),
                F.lit("registry_value"), F.when(is_id(12, 13), text("details")),
                F.lit("query_type"), F.when(is_id(22), text("querytype")),
                F.lit("query_results"), F.when(is_id(22), text("queryresults"))),
        }

    return fields


@cache
def sysmon(both_quotes: bool = False) -> LogFormat:
    """Data fields with single-quoted names, as stored; optionally both quotes."""
    pattern = X.BOTH_QUOTES if both_quotes else X.SINGLE_QUOTES
    return LogFormat("sysmon", _header, _verdict, _fields_for(X.SYSTEM_TIME_BOTH if both_quotes else X.SYSTEM_TIME),
                     data=lambda line: X.data_map(line, pattern, strip_values=True))

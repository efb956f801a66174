"""Linux syslog: RFC 3164, RFC 5424 and journald lines."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.text import capture, iso_timestamp, packed, part, to_int
from logwarden.operators.formats import LogFormat

# Header and message patterns.
RFC3164 = (r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
           r"\s+(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s+(.+)$")
RFC5424 = (r"<\d{1,3}>(\d+)\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\S*)\s+(\S+)\s+(\S+)\s+(\S+)"
           r"\s+\S+\s+\S+\s+(.+)$")
JOURNALD = (r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\S*)\s+(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s+(.+)$")
SSH_FAILED = (r"(?i)Failed (?:password|publickey|keyboard-interactive) for (?:invalid user )?(\S+)"
              r" from ([\d.:a-fA-F]+)(?:\s+port\s+(\d+))?")
SSH_ACCEPTED = (r"(?i)Accepted (?:password|publickey|keyboard-interactive) for (\S+)"
                r" from ([\d.:a-fA-F]+)(?:\s+port\s+(\d+))?")
SSH_INVALID = r"(?i)Invalid user (\S+) from ([\d.:a-fA-F]+)"
SSH_MAX_AUTH = r"(?i)error: maximum authentication attempts exceeded"
SUDO = (r"(?i)(\S+)\s*:\s*TTY=(\S+)\s*;\s*PWD=(\S+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)$")
# The groups follow lazy gaps and are optional, so they capture only when glued on.
PAM_FAILURE = (r"(?i)pam_unix\([^)]*\): authentication failure.*?(?:user=(\S+))?.*?"
               r"(?:rhost=([\d.:a-fA-F]+))?")
OOM = r"(?i)Out of memory: Kill process (\d+) \(([^)]+)\)"
KERNEL_PANIC = r"(?i)Kernel panic|kernel BUG|BUG: soft lockup"

# Process name part -> service, first hit wins.
SERVICES = (
    ("sshd", "SSH"), ("ssh", "SSH"), ("sudo", "sudo"), ("su", "su"), ("cron", "cron"),
    ("crond", "cron"), ("httpd", "HTTP"), ("apache2", "HTTP"), ("nginx", "HTTP"),
    ("mysqld", "MySQL"), ("postgres", "PostgreSQL"), ("kernel", "kernel"), ("systemd", "systemd"),
)

# Header parts.
_TIME, _ISO, _HOST, _PROCESS, _PID, _MESSAGE = range(6)
# Detail parts.
(_TYPE, _USER, _IP, _PORT, _SERVICE, _COMMAND, _TTY, _PWD, _TARGET,
 _OOM_PROCESS, _OOM_PID, _FLAG) = range(12)


def _header(line: Column) -> Column:
    return F.coalesce(
        capture(line, RFC3164, ["$1 $2 $3", "", "$4", "$5", "$6", "$7"]),
        capture(line, RFC5424, ["", "$2", "$3", "$4", "$5", "$6"]),
        capture(line, JOURNALD, ["", "$1", "$2", "$3", "$4", "$5"]))


def _detail(line: Column, h: Column, data: Column) -> Column:
    """Ordered rules, first hit wins; guards keep the patterns off most lines."""
    message = F.get(h, F.lit(_MESSAGE))
    process = F.lower(F.get(h, F.lit(_PROCESS)))
    ssh = F.coalesce(
        capture(message, SSH_FAILED, ["Failed Login", "$1", "$2", "$3", "SSH"], search=True),
        capture(message, SSH_ACCEPTED, ["Successful Login", "$1", "$2", "$3", "SSH"], search=True),
        capture(message, SSH_INVALID, ["Invalid User", "$1", "$2", "", "SSH"], search=True),
        F.when(message.rlike(SSH_MAX_AUTH), packed("Brute Force", "", "", "", "SSH")))
    return F.coalesce(
        F.when(process.contains("sshd"), ssh),
        F.when(process.contains("sudo"), capture(
            message, SUDO, ["Privilege Escalation", "$1", "", "", "sudo", "$5", "$2", "$3", "$4"],
            search=True)),
        F.when(F.lower(message).contains("pam_unix"), capture(
            message, PAM_FAILURE, ["Authentication Failure", "$1", "$2"], search=True)),
        F.when(message.rlike("(?i)out of memory"), capture(
            message, OOM, ["System Event", "", "", "", "", "", "", "", "", "$2", "$1", "oom_kill"],
            search=True)),
        F.when(message.rlike(KERNEL_PANIC),
               packed("System Event", "", "", "", "", "", "", "", "", "", "", "kernel_panic")),
        packed("System Log"))


def _verdict(line: Column, h: Column, data: Column, d: Column) -> Column:
    return part(d, _TYPE)


def detect_service(process: Column) -> Column:
    case = F.when(process.contains(SERVICES[0][0]), SERVICES[0][1])
    for needle, service in SERVICES[1:]:
        case = case.when(process.contains(needle), service)
    return case


def _fields_for(assume_year: int | None):
    def fields(line: Column, h: Column, data: Column, d: Column, v: Column) -> dict[str, Column]:
        year = F.lit(str(assume_year)) if assume_year else F.date_format(F.current_timestamp(), "yyyy")
        rfc3164_time = F.try_to_timestamp(
            F.concat(year, F.lit(" "), part(h, _TIME), F.lit(" +0000")), F.lit("yyyy MMM d HH:mm:ss Z"))
        flag = part(d, _FLAG)
        sudo = part(d, _TTY).isNotNull()
        return {
            "username": part(d, _USER),
            "source_ip": part(d, _IP),
            "source_port": to_int(part(d, _PORT)),
            "service": F.coalesce(part(d, _SERVICE), detect_service(F.lower(part(h, _PROCESS)))),
            "hostname": part(h, _HOST),
            "process_name": F.coalesce(part(d, _OOM_PROCESS), part(h, _PROCESS)),
            "process_id": F.coalesce(to_int(part(d, _OOM_PID)),
                                     F.when(part(h, _PID).rlike(r"^\d+$"), to_int(part(h, _PID)))),
            "command_line": part(d, _COMMAND),
            "timestamp_raw": F.coalesce(part(h, _TIME), part(h, _ISO)),
            "event_timestamp": F.coalesce(rfc3164_time, iso_timestamp(part(h, _ISO))),
            "normalized_data": F.when(sudo, F.create_map(
                F.lit("tty"), part(d, _TTY), F.lit("working_dir"), part(d, _PWD),
                F.lit("target_user"), part(d, _TARGET),
            )).when(flag.isNotNull(), F.create_map(flag, F.lit("true"))),
        }

    return fields


@cache
def linux_syslog(assume_year: int | None = None) -> LogFormat:
    """RFC 3164 lines carry no year: ``assume_year``, or the current UTC year."""
    return LogFormat("linux_syslog", _header, _verdict, _fields_for(assume_year), detail=_detail)

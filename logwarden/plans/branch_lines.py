"""One line template per outcome of each parser, filled with the numbers of the ``events`` table.

Event ``n`` takes the template at place ``n % number of templates``; ``{n}`` stands for the number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _access(path: str, status: int = 200, size: str = "10", agent: str = "Mozilla/5.0", request: str = "") -> str:
    request = request or f"GET {path} HTTP/1.1"
    return f'1.2.3.4 - u{{n}} [01/Jul/2025:12:23:11 +0200] "{request}" {status} {size} "-" "{agent}"'


def _sysmon(event_id: str, **fields: str) -> str:
    data = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in fields.items())
    return f"<Event><System><EventID>{event_id}</EventID><Computer>WS{{n}}</Computer></System><EventData>{data}</EventData></Event>"


WEB = (
    _access("/a?q=1%20or%201=1"), _access("/?a=%3Cscript%3E"), _access("/%252e%252e/x"), _access("/?c=;cat%20x"),
    _access("/", agent="sqlmap/1"), _access("/admin"), _access("/", size="10000001"), _access("/", 401), _access("/", 403),
    _access("/", 404), _access("/", 500), _access("/{n}"),
)
BRANCHES = {
    "linux_syslog": (
        "Jul  1 10:23:11 s{n} sshd[9]: error: maximum authentication attempts exceeded for root",
        "Jul  1 10:23:11 s{n} login: pam_unix(x): authentication failure; user=z rhost=1.1.1.1",
        "Jul 31 10:23:11 s{n} kernel: Out of memory: Kill process 77 (java) score 1",
        "Jul 31 10:23:11 s{n} kernel: Kernel panic - not syncing",
        "<13>1 2025-07-01T10:23:11+00:00 s{n} app - - - message",
        "2025-07-01T10:23:11.123Z s{n} cron[3]: hello",
        "Jul  1 10:23:11 s{n} sshd[9]: Accepted publickey for al from 1.2.3.4 port 5 ssh2",
        "no log line {n}",
    ),
    "apache_access": WEB,
    "nginx_access": (*WEB, _access("", 400, "0", request="\\x16\\x03"),
                     "2025/07/01 10:23:11 [error] 1#1: open() failed {n}", "2025/07/01 10:23:11 [warn] 1#1: low, server: web{n}",
                     "2025/07/01 10:23:11 [info] 1#1: fine {n}"),
    "sysmon": (
        _sysmon("8", TargetImage="C:\\lsass.exe", SourceImage="C:\\a\\b{n}.exe"), _sysmon("8", TargetImage="C:\\x.exe"),
        _sysmon("10", TargetImage="C:\\x.exe", SourceImage="C:\\a\\c.exe"),
        _sysmon("1", Image="C:\\x.exe", CommandLine="sekurlsa::logonpasswords"),
        _sysmon("1", Image="C:\\cmd.exe", ParentImage="C:\\winword.exe"), _sysmon("1", Image="C:\\Temp\\cmd.exe"),
        _sysmon("1", Image="C:\\x{n}.exe"), _sysmon("7", ImageLoaded="C:\\a{n}.dll", SignatureStatus="Expired"),
        _sysmon("7", ImageLoaded="C:\\Temp\\a.dll", SignatureStatus="Expired"),
        _sysmon("7", Image="C:\\p.exe", ImageLoaded="C:\\a.dll", SignatureStatus="Valid"),
        _sysmon("11", TargetFilename="C:\\Users\\Public\\a{n}.exe"), _sysmon("11", TargetFilename="C:\\a{n}.txt"),
        _sysmon("23", TargetFilename="C:\\d{n}"), _sysmon("12", TargetObject="HKLM\\x{n}"), _sysmon("099"),
    ),
    "windows_event": (
        "Account Name: bob New Process Name: C:\\x{n}.exe ", "Event ID: 9 Logged: 7/1/2025 1:02:03 PM",
        "EventID 4688 New Process ID: 0x1f 2025-07-01T10:23:11.5Z", "Account Name: SYSTEM",
        "<Event xmlns='x'><System><EventID Q='1'>4624</EventID><Computer>PC{n}</Computer></System><EventData>"
        "<Data Name='TargetUserName'></Data><Data Name='SubjectUserName'>al</Data></EventData></Event>",
        "<Event>no id {n}</Event>",
    ),
}


def branch_lines(events: DataFrame, log_type: str) -> DataFrame:
    templates = F.array(*map(F.lit, BRANCHES[log_type]))
    n = len(BRANCHES[log_type])
    text = F.replace(F.get(templates, (F.col("event_id") % n).cast("int")), F.lit("{n}"), F.col("event_id").cast("string"))
    return events.select(F.col("user_id").alias("log_id"), (F.col("event_id") + 1).cast("int").alias("line_number"),
                         text.alias("raw_line"), F.lit(log_type).alias("log_type"))

"""One hand-written line per parser branch."""

import datetime as dt

from logwarden.operators import parse as P


def events(df):
    return [r.asDict() for r in df.orderBy("line_number").collect()]


def test_syslog_ssh(lines):
    got = events(P.parse_syslog(lines(
        "linux_syslog",
        "Jul  1 10:23:11 server sshd[1234]: Failed password for root from 185.24.18.15 port 52431 ssh2",
        "Jul  1 10:23:11 server sshd[1234]: Failed password for invalid user bob from ::1",
        "Jul  1 10:23:11 server sshd[9]: Accepted publickey for al from 1.2.3.4 port 5 ssh2",
        "Jul  1 10:23:11 server sshd[9]: Invalid user x from 1.2.3.4 port 9",
        "Jul  1 10:23:11 server sshd[9]: error: maximum authentication attempts exceeded for root",
        "Jul  1 10:23:11 server sshd[9]: Connection closed"), 2025))
    assert [e["event_type"] for e in got] == [
        "Failed Login", "Failed Login", "Successful Login", "Invalid User", "Brute Force", "System Log"]
    first = got[0]
    assert (first["username"], first["source_ip"], first["source_port"], first["service"]) == (
        "root", "185.24.18.15", 52431, "SSH")
    assert (first["hostname"], first["process_name"], first["process_id"]) == ("server", "sshd", 1234)
    assert first["timestamp_raw"] == "Jul 1 10:23:11"
    assert first["event_timestamp"] == dt.datetime(2025, 7, 1, 10, 23, 11)
    assert (got[1]["username"], got[1]["source_ip"]) == ("bob", "::1")
    assert got[3]["source_port"] is None


def test_syslog_other(lines):
    got = events(P.parse_syslog(lines(
        "linux_syslog",
        "Jul  1 10:23:11 s sudo: bob : TTY=pts/0 ; PWD=/home/bob ; USER=root ; COMMAND=/bin/cat /etc/shadow",
        "Feb 29 10:00:00 s login: pam_unix(x): authentication failure; user=z rhost=1.1.1.1",
        "Jul 31 10:23:11 s kernel: Out of memory: Kill process 77 (java) score 1",
        "Jul 31 10:23:11 s kernel: Kernel panic - not syncing",
        "<13>1 2025-07-01T10:23:11+00:00 server app - - - message",
        "2025-07-01T10:23:11.123Z h cron[3]: hello",
        "THIS IS NOT A LOG LINE @@@@###$$$", "   "), 2025))
    assert [e["line_number"] for e in got] == [1, 2, 3, 4, 5, 6]
    assert [e["event_type"] for e in got] == [
        "Privilege Escalation", "Authentication Failure", "System Event", "System Event", "System Log", "System Log"]
    assert got[0]["command_line"] == "/bin/cat /etc/shadow"
    assert got[0]["normalized_data"] == {"tty": "pts/0", "working_dir": "/home/bob", "target_user": "root"}
    assert (got[1]["username"], got[1]["source_ip"], got[1]["event_timestamp"]) == (None, None, None)
    assert (got[2]["process_name"], got[2]["process_id"], got[2]["normalized_data"]) == ("java", 77, {"oom_kill": "true"})
    assert got[4]["process_id"] is None and got[4]["event_timestamp"] == dt.datetime(2025, 7, 1, 10, 23, 11)
    assert got[5]["service"] == "cron" and got[5]["event_timestamp"].microsecond == 123000


def access(path, status=200, size="10", agent="Mozilla/5.0"):
    return f'1.2.3.4 - frank [01/Jul/2025:12:23:11 +0200] "GET {path} HTTP/1.1" {status} {size} "-" "{agent}"'


def test_web_request_types(lines):
    cases = [
        (access("/a?q=1%20or%201=1"), "SQL Injection Attempt"), (access("/x--"), "HTTP Request"),
        (access("/x--y"), "SQL Injection Attempt"), (access("/?a=%3Cscript%3E"), "XSS Attempt"),
        (access("/%252e%252e/x"), "Directory Traversal"), (access("/..%2fetc"), "Directory Traversal"),
        (access("/?c=;cat%20x"), "Command Injection Attempt"), (access("/", agent="sqlmap/1"), "Web Scanner"),
        (access("/admin"), "Web Scanning"), (access("/", size="10000001"), "Large Data Transfer"),
        (access("/", 401), "Unauthorized Access Attempt"), (access("/", 403), "Forbidden Access Attempt"),
        (access("/", 404), "HTTP Client Error"), (access("/", 500), "HTTP Client Error"), (access("/", size="-"), "HTTP Request")]
    got = events(P.parse_apache(lines("apache_access", *[c for c, _ in cases])))
    assert [e["event_type"] for e in got] == [t for _, t in cases]
    assert got[0]["event_timestamp"] == dt.datetime(2025, 7, 1, 10, 23, 11)
    assert (got[0]["username"], got[0]["dest_port"], got[0]["protocol"], got[0]["service"]) == ("frank", 80, "HTTP", "HTTP")
    # the nginx comment rule needs no following character
    assert events(P.parse_nginx(lines("nginx_access", access("/x--"))))[0]["event_type"] == "SQL Injection Attempt"


def test_apache_error(lines):
    got = events(P.parse_apache(lines(
        "apache_access", "[Fri Jul 01 10:23:11.123456 2025] [error] [pid 1234] [client 1.2.3.4] message",
        "[Fri Jul 01 10:23:11 2025] [notice] restart", "junk")))
    assert [e["event_type"] for e in got] == ["Web Server Error", "Web Server Error"]
    assert (got[0]["source_ip"], got[0]["process_id"]) == ("1.2.3.4", 1234)
    assert got[0]["event_timestamp"] == dt.datetime(2025, 7, 1, 10, 23, 11, 123456)
    assert got[0]["normalized_data"]["is_error"] == "true" and got[1]["normalized_data"]["is_error"] == "false"


def test_nginx(lines):
    got = events(P.parse_nginx(lines(
        "nginx_access",
        '2025/07/01 10:23:11 [error] 1234#5678: *91 connect() failed, client: 1.2.3.4, server: web, request: "GET /x HTTP/1.1", '
        'upstream: "http://10.0.0.1/", host: "h1"',
        "2025/07/01 10:23:11 [error] 1#1: open() failed", "2025/07/01 10:23:11 [warn] 1#1: low, server: web",
        "2025/07/01 10:23:11 [info] 1#1: fine",
        '1.2.3.4 - - [01/Jul/2025:10:23:11 +0000] "\\x16\\x03" 400 0 "-" ""')))
    assert [e["event_type"] for e in got] == [
        "Upstream Proxy Error", "Web Server Error", "Web Server Warning", "Web Server Event", "HTTP Client Error"]
    assert (got[0]["source_ip"], got[0]["http_method"], got[0]["url"], got[0]["hostname"]) == ("1.2.3.4", "GET", "/x", "h1")
    assert got[0]["normalized_data"]["upstream"] == "http://10.0.0.1/"
    assert got[2]["hostname"] == "web"
    assert (got[4]["url"], got[4]["http_method"], got[4]["user_agent"]) == ("\\x16\\x03", None, "")


def test_windows(lines):
    got = events(P.parse_windows(lines(
        "windows_event",
        "EventID=4625 Account Name: bob Source Network Address: 203.0.113.7 Source Port: 99",
        "Account Name: SYSTEM", "New Process Name: C:\\x.exe ", "Event ID: 9 Logged: 7/1/2025 1:02:03 PM",
        "Process ID: 0x1f", "EventID 4688 New Process ID: 0x1f 2025-07-01T10:23:11.5Z",
        "<Event xmlns='x'><System><EventID Q='1'>4624</EventID><Computer>PC</Computer>"
        "<TimeCreated SystemTime='2025-07-01T10:23:11.1234567Z'/></System><EventData><Data Name='TargetUserName'></Data>"
        "<Data Name='SubjectUserName'>al</Data><Data Name='IpPort'>99</Data></EventData></Event>",
        "<Event>no id</Event>")))
    assert [e["line_number"] for e in got] == [1, 3, 4, 6, 7]
    assert [e["event_type"] for e in got] == [
        "Failed Login", "Windows Event", "Windows Event", "Process Creation", "Successful Login"]
    assert (got[0]["username"], got[0]["source_ip"], got[0]["source_port"]) == ("bob", "203.0.113.7", 99)
    assert got[1]["process_name"] == "C:\\x.exe"
    assert got[2]["event_timestamp"] == dt.datetime(2025, 7, 1, 13, 2, 3)
    assert got[3]["process_id"] == 31
    assert (got[4]["username"], got[4]["hostname"], got[4]["source_port"]) == ("al", "PC", 99)
    assert got[4]["event_timestamp"].microsecond == 123456


def sysmon(event_id, **fields):
    data = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in fields.items())
    return f"<Event><System><EventID>{event_id}</EventID><Computer>WS01</Computer></System><EventData>{data}</EventData></Event>"


def test_sysmon_types(lines):
    cases = [
        (sysmon(10, TargetImage="C:\\Windows\\System32\\lsass.exe"), "LSASS Access (Credential Dump)"),
        (sysmon(8, TargetImage="C:\\lsass.exe", SourceImage="C:\\a\\b.exe"), "LSASS Injection"),
        (sysmon(1, Image="C:\\x.exe", CommandLine="sekurlsa::logonpasswords"), "Credential Dumping Attempt"),
        (sysmon(1, Image="C:\\x.exe", CommandLine="p -enc AAAA=="), "Encoded PowerShell"),
        (sysmon(1, Image="C:\\cmd.exe", ParentImage="C:\\winword.exe"), "Suspicious Child Process"),
        (sysmon(1, Image="C:\\Temp\\cmd.exe"), "LOLBin Execution"), (sysmon(1, Image="C:\\x.exe"), "Process Creation"),
        (sysmon(3, DestinationPort="4444"), "Suspicious Network Connection"), (sysmon(3, DestinationPort="44"), "Network Connection"),
        (sysmon(7, ImageLoaded="C:\\a.dll", SignatureStatus="Expired"), "Unsigned DLL Loaded"),
        (sysmon(7, ImageLoaded="C:\\Temp\\a.dll", SignatureStatus="Expired"), "DLL from Suspicious Path"),
        (sysmon(7, ImageLoaded="C:\\a.dll", SignatureStatus="Valid"), "DLL Loaded"),
        (sysmon(11, TargetFilename="C:\\Users\\Public\\a.exe"), "File Created in Suspicious Location"),
        (sysmon(13, TargetObject="HKLM\\software\\Microsoft\\Windows\\CurrentVersion\\RunOnce"), "Registry Persistence"),
        (sysmon(12, TargetObject="HKLM\\x"), "Registry Key Created"), (sysmon(22, QueryName="a.b"), "DNS Query"),
        (sysmon(23, TargetFilename="C:\\a"), "File Deleted"), (sysmon("099"), "Sysmon Event 99")]
    got = events(P.parse_sysmon(lines("sysmon", *[c for c, _ in cases], "no event id")))
    assert [e["event_type"] for e in got] == [t for _, t in cases]
    assert got[1]["process_name"] == "b.exe" and got[0]["hostname"] == "WS01"
    assert got[5]["normalized_data"]["suspicious_path"] == "true"
    assert got[7]["protocol"] == "TCP" and got[7]["dest_port"] == 4444


def test_sysmon_last_duplicate_field_wins_and_xml_stays_whole(lines):
    line = sysmon(1, Image="C:\\a.exe").replace("</EventData>", "<Data Name='image'> C:\\b.exe </Data></EventData>") + "x" * 600
    got = events(P.parse_sysmon(lines("sysmon", line)))[0]
    assert got["process_name"] == "b.exe" and got["raw_line"] == line
    assert events(P.parse_sysmon(lines("sysmon", line.replace("'", '"'))))[0]["process_name"] is None
    assert events(P.parse_sysmon(lines("sysmon", line.replace("'", '"')), both_quotes=True))[0]["process_name"] == "b.exe"


def test_dispatch_and_extra_parser(lines):
    mixed = lines("linux_syslog", "Jul  1 10:23:11 s cron[1]: x").unionByName(lines("apache_access", access("/admin"))) \
        .unionByName(lines("unknown", access("/admin"))).unionByName(lines("mine", "Jul  1 10:23:11 s cron[1]: x"))
    extra = {"mine": lambda df: P.parse_syslog(df.drop("log_type"), 2025)}
    got = P.parse_logs(mixed, 2025, extra_parsers=extra)
    assert sorted(r.event_type for r in got.collect()) == ["System Log", "System Log", "Web Scanning"]

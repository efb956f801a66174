"""Detection scores and rule results as literal numbers, worked out by hand from the weights and the rule table."""

import pytest

from logwarden.operators import classify as C
from logwarden.operators import detect as D

LINES = [
    ("Jul  1 10:23:11 server sshd[1234]: Failed password for root from 185.24.18.15 port 52431 ssh2",
     "linux_syslog", 7.5 / 16, {"sysmon": 0, "windows_event": 0, "linux_syslog": 7.5 / 16, "apache_access": 0, "nginx_access": 0}),
    ('192.168.1.1 - frank [01/Jul/2025:10:23:11 +0000] "GET /admin HTTP/1.1" 200 4823 "-" "Mozilla/5.0"',
     "apache_access", 4 / 9, {"apache_access": 4 / 9, "nginx_access": 1 / 3, "linux_syslog": 0}),
    ("<Event><System><Provider Name='Microsoft-Windows-Sysmon'/><EventID>10</EventID></System></Event>",
     "sysmon", 7 / 17, {"sysmon": 7 / 17, "windows_event": 9 / 49}),
    ("EventID=4625 Account Name: bob Source Network Address: 203.0.113.7", "unknown", 1 / 7, {"windows_event": 1 / 7}),
    ('2025/07/01 10:23:11 [error] 1234#5678: *91 connect() failed, client: 10.0.0.1, upstream: "http://10.0.0.1/"',
     "nginx_access", 1 / 2, {"nginx_access": 1 / 2, "apache_access": 1 / 9}),
    ("THIS IS NOT A LOG LINE @@@@###$$$", "unknown", 0, {"sysmon": 0, "nginx_access": 0}),
]
RULED = [
    ("linux_syslog", "Successful Login", ["LO-005"], 2, "info", "T1078", None, 0.72),
    ("linux_syslog", "Invalid User", ["ME-002"], 5, "medium", "T1110", "T1110.003", 0.72),
    ("linux_syslog", "Privilege Escalation", ["HI-006"], 7, "high", "T1548", "T1548.003", 0.82),
    ("linux_syslog", "Brute Force Attempt", ["ME-003"], 6, "medium", "T1110", None, 0.72),
    ("apache_access", "SQL Injection Attempt", ["HI-013"], 7, "high", "T1190", None, 0.72),
    ("apache_access", "Directory Traversal", ["ME-009"], 5, "medium", "T1083", None, 0.72),
    ("apache_access", "XSS Attempt", ["ME-008"], 5, "medium", "T1059", "T1059.007", 0.72),
    ("apache_access", "Forbidden Access Attempt", ["ME-007"], 4, "low", "T1083", None, 0.72),
    ("apache_access", "Command Injection Attempt", ["HI-014"], 8, "high", "T1190", None, 0.72),
    ("sysmon", "LSASS Access (Credential Dump)", ["CR-001"], 10, "critical", "T1003", "T1003.001", 0.72),
    ("sysmon", "Encoded PowerShell", ["HI-001"], 8, "high", "T1059", "T1059.001", 0.72),
    ("sysmon", "Registry Persistence", ["HI-003"], 8, "high", "T1547", "T1547.001", 0.72),
    ("sysmon", "LOLBin Execution", ["HI-002"], 7, "high", "T1218", None, 0.72),
    ("sysmon", "Credential Dumping Attempt", ["CR-001", "CR-002"], 10, "critical", "T1003", "T1003.001", 0.74),
    ("windows_event", "Failed Login", ["ME-001"], 5, "medium", "T1110", "T1110.001", 0.72),
    ("windows_event", "Nothing Known", [], 1, "info", None, None, 0.0),
]


def test_scores(spark):
    rows = [(i, 1, line) for i, (line, *_) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "log_id long, line_number int, raw_line string")
    got = {r.log_id: r for r in D.detect_log_type(df).collect()}
    for i, (_, kind, confidence, scores) in enumerate(LINES):
        assert got[i].log_type == kind and got[i].confidence == pytest.approx(confidence)
        assert {k: got[i][f"score_{k}"] for k in scores} == pytest.approx(scores)


def test_rules(spark):
    events = spark.createDataFrame([r[:2] for r in RULED], "log_type string, event_type string")
    got = {(r.log_type, r.event_type): (r.matched_rules, r.severity_score, r.severity, r.mitre_technique_id,
                                        r.sub_technique_id, float(r.confidence)) for r in C.classify_events(events).collect()}
    assert got == {r[:2]: r[2:] for r in RULED}

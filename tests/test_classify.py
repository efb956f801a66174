import pytest
from pyspark.sql import functions as F

from logwarden.operators import classify as C
from logwarden.operators.incidents import build_incidents
from logwarden.operators.rules import RULES, SUB_TECHNIQUES, TACTICS, TECHNIQUES, Rule, load_rules, rules_df


def classified(spark, *types, rules=RULES):
    df = spark.createDataFrame([(1, i, t, lt) for i, (t, lt) in enumerate(types)],
                               "log_id long, line_number int, event_type string, log_type string")
    return C.classify_events(df, rules).orderBy("line_number").collect()


def test_rule_table():
    assert len(RULES) == 47 and len({r.rule_id for r in RULES}) == 47
    for r in RULES:
        assert 1 <= r.severity_score <= 10 and r.patterns and r.tactic_id in TACTICS
        assert r.technique.split(".")[0] in TECHNIQUES and ("." not in r.technique or r.technique in SUB_TECHNIQUES)


@pytest.mark.parametrize("event_type,log_type,technique,severity", [
    ("Failed Login", "linux_syslog", "T1110", "medium"), ("Privilege Escalation", "linux_syslog", "T1548", "high"),
    ("LSASS Access (Credential Dump)", "sysmon", "T1003", "critical"), ("Remote Thread Created", "sysmon", "T1055", "critical"),
    ("Encoded PowerShell", "sysmon", "T1059", "high"), ("Registry Persistence", "sysmon", "T1547", "high"),
    ("HTTP Request", "apache_access", "T1595", "info"), ("DNS Query", "sysmon", "T1071", "low"),
    ("Network Connection", "sysmon", None, "info"), (None, "sysmon", None, "info")])
def test_techniques(spark, event_type, log_type, technique, severity):
    got = classified(spark, (event_type, log_type))[0]
    assert (got.mitre_technique_id, got.severity) == (technique, severity)
    assert 0 <= got.confidence <= 1 and got.is_classified == (technique is not None)


def test_details(spark):
    sudo, other, dump, none = classified(
        spark, ("privilege escalation", "linux_syslog"), ("Privilege Escalation", "apache_access"),
        ("Credential Dumping Attempt", "sysmon"), ("Web Server Event", "nginx_access"))
    assert sudo.matched_rules == ["HI-006"] and sudo.confidence == 0.82
    assert other.matched_rules == [] and other.threat_category == "Unclassified"
    assert dump.matched_rules == ["CR-001", "CR-002"] and dump.confidence == 0.74
    assert dump.tags == ["mimikatz", "lsass", "credential_access"] and dump.sub_technique_id == "T1003.001"
    assert (none.severity_score, none.confidence, none.tags) == (1, 0.0, [])


def test_rules_from_a_table(spark):
    mine = (Rule("X-1", ("Odd Thing",), "TA0001", "T1190", 9, "Odd", ("odd",), 5),)
    assert load_rules(rules_df(spark, mine))[0].rule_id == "X-1"
    assert set(r.rule_id for r in load_rules(rules_df(spark))) == {r.rule_id for r in RULES}
    assert classified(spark, ("some odd thing", "sysmon"), rules=load_rules(rules_df(spark, mine)))[0].severity == "critical"


def test_incidents(spark):
    rows = [(1, 1, "SQL Injection Attempt", "apache_access", "1.1.1.1", "h2"), (1, 2, "SQL Injection Attempt", "apache_access", "1.1.1.1", "h1"),
            (1, 3, "SQL Injection Attempt", "apache_access", None, None), (1, 4, "XSS Attempt", "apache_access", "1.1.1.1", "h1")]
    df = spark.createDataFrame(rows, "log_id long, line_number int, event_type string, log_type string, source_ip string, hostname string")
    got = {r.source_ips[0] if r.source_ips else None: r for r in build_incidents(C.classify_events(df)).collect()}
    assert set(got) == {"1.1.1.1", None}
    one = got["1.1.1.1"]
    assert one.title == "Web Application Attack — SQL Injection Attempt — 1.1.1.1" and one.event_count == 2
    assert one.affected_hosts == ["h1", "h2"] and one.mitre_techniques == ["T1190"] and one.status == "open"
    assert got[None].affected_hosts is None and "from unknown" in got[None].description
    assert C.classify_events(df).filter(C.is_threat() & F.col("source_ip").isNotNull()).count() == 3

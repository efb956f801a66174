"""The ATT&CK rule table.

A rule matches an event when any of its patterns is contained (ignoring case) in
the event type and its log types are empty or contain the event's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Tactic, technique and sub-technique names by id.
TACTICS = {
    "TA0001": "Initial Access", "TA0002": "Execution", "TA0003": "Persistence",
    "TA0004": "Privilege Escalation", "TA0005": "Defense Evasion", "TA0006": "Credential Access",
    "TA0007": "Discovery", "TA0008": "Lateral Movement", "TA0010": "Exfiltration",
    "TA0011": "Command and Control", "TA0040": "Impact", "TA0043": "Reconnaissance",
}
TECHNIQUES = {
    "T1003": "OS Credential Dumping", "T1041": "Exfiltration Over C2 Channel",
    "T1053": "Scheduled Task/Job", "T1055": "Process Injection",
    "T1059": "Command and Scripting Interpreter", "T1070": "Indicator Removal",
    "T1071": "Application Layer Protocol", "T1078": "Valid Accounts",
    "T1082": "System Information Discovery", "T1083": "File and Directory Discovery",
    "T1098": "Account Manipulation", "T1105": "Ingress Tool Transfer", "T1110": "Brute Force",
    "T1136": "Create Account", "T1190": "Exploit Public-Facing Application",
    "T1218": "System Binary Proxy Execution", "T1499": "Endpoint Denial of Service",
    "T1543": "Create or Modify System Process", "T1547": "Boot or Logon Autostart Execution",
    "T1548": "Abuse Elevation Control Mechanism", "T1550": "Use Alternate Authentication Material",
    "T1557": "Adversary-in-the-Middle", "T1558": "Steal or Forge Kerberos Tickets",
    "T1562": "Impair Defenses", "T1564": "Hide Artifacts", "T1574": "Hijack Execution Flow",
    "T1595": "Active Scanning",
}
SUB_TECHNIQUES = {
    "T1003.001": "LSASS Memory", "T1053.005": "Scheduled Task", "T1055.003": "Thread Execution Hijacking",
    "T1059.001": "PowerShell", "T1059.007": "JavaScript", "T1070.004": "File Deletion",
    "T1070.006": "Timestomp", "T1071.004": "DNS", "T1098.001": "Additional Cloud Credentials",
    "T1110.001": "Password Guessing", "T1110.003": "Password Spraying", "T1136.001": "Local Account",
    "T1543.003": "Windows Service", "T1547.001": "Registry Run Keys", "T1548.003": "Sudo and Sudo Caching",
    "T1550.002": "Pass the Hash", "T1557.001": "LLMNR/NBT-NS Poisoning", "T1558.003": "Kerberoasting",
    "T1564.004": "NTFS File Attributes", "T1574.001": "DLL Search Order Hijacking",
    "T1595.002": "Vulnerability Scanning",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    patterns: tuple[str, ...]
    tactic_id: str
    technique: str  # technique or sub-technique id
    severity_score: int
    threat_category: str
    tags: tuple[str, ...]
    priority: int = 50
    log_types: tuple[str, ...] = ()
    tactic_name: str | None = None
    technique_name: str | None = None
    sub_technique_name: str | None = None

    def row(self, seq: int) -> tuple:
        technique_id = self.technique.split(".")[0]
        sub_id = self.technique if "." in self.technique else None
        return (
            self.rule_id, list(self.patterns), list(self.log_types), self.tactic_id,
            self.tactic_name or TACTICS.get(self.tactic_id), technique_id,
            self.technique_name or TECHNIQUES.get(technique_id), sub_id,
            self.sub_technique_name or (SUB_TECHNIQUES.get(sub_id) if sub_id else None),
            self.severity_score, self.threat_category, list(self.tags), self.priority, seq,
        )


RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("log_types", T.ArrayType(T.StringType())),
    T.StructField("tactic_id", T.StringType()),
    T.StructField("tactic_name", T.StringType()),
    T.StructField("technique_id", T.StringType()),
    T.StructField("technique_name", T.StringType()),
    T.StructField("sub_technique_id", T.StringType()),
    T.StructField("sub_technique_name", T.StringType()),
    T.StructField("severity_score", T.IntegerType()),
    T.StructField("threat_category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("priority", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
])

# The 47 rules, in definition order.
RULES: tuple[Rule, ...] = (
    Rule("CR-001", ("LSASS Access", "LSASS Injection", "Credential Dumping"), "TA0006", "T1003.001", 10,
         "Credential Dumping", ("mimikatz", "lsass", "credential_access"), 10),
    Rule("CR-002", ("Credential Dumping Attempt",), "TA0006", "T1003", 10,
         "Credential Dumping", ("mimikatz", "credential_access"), 10),
    Rule("CR-003", ("Remote Thread Created",), "TA0005", "T1055.003", 9,
         "Process Injection", ("injection", "evasion", "sysmon"), 10),
    Rule("HI-001", ("Encoded PowerShell",), "TA0002", "T1059.001", 8,
         "Malicious PowerShell", ("powershell", "encoded", "execution", "lolbin"), 15),
    Rule("HI-002", ("LOLBin Execution", "Suspicious Child Process"), "TA0005", "T1218", 7,
         "LOLBin Execution", ("lolbin", "evasion", "execution", "sysmon"), 15),
    Rule("HI-003", ("Registry Persistence",), "TA0003", "T1547.001", 8,
         "Registry Persistence", ("persistence", "registry", "startup", "sysmon"), 15),
    Rule("HI-004", ("Scheduled Task Created", "Scheduled Task Modified"), "TA0003", "T1053.005", 8,
         "Scheduled Task Persistence", ("persistence", "scheduled_task", "windows"), 15),
    Rule("HI-005", ("Service Installed",), "TA0003", "T1543.003", 8,
         "Malicious Service", ("persistence", "service", "windows"), 15),
    Rule("HI-006", ("Privilege Escalation",), "TA0004", "T1548.003", 7,
         "Privilege Escalation", ("privilege_escalation", "sudo", "linux"), 20, ("linux_syslog",)),
    Rule("HI-007", ("Privilege Escalation", "Special Priv"), "TA0004", "T1548", 7,
         "Privilege Escalation", ("privilege_escalation", "windows", "event_4672"), 20, ("windows_event",)),
    Rule("HI-008", ("Suspicious Network Connection",), "TA0011", "T1071", 8,
         "C2 Communication", ("c2", "network", "sysmon"), 15),
    Rule("HI-009", ("Unsigned DLL Loaded", "DLL from Suspicious Path"), "TA0005", "T1574.001", 7,
         "DLL Hijacking", ("dll", "hijacking", "evasion", "sysmon"), 20),
    Rule("HI-010", ("User Account Created",), "TA0003", "T1136.001", 7,
         "Account Creation", ("persistence", "account", "windows"), 20),
    Rule("HI-011", ("Explicit Credential Logon",), "TA0008", "T1550.002", 8,
         "Lateral Movement", ("lateral_movement", "pass_the_hash", "windows"), 20),
    Rule("HI-012", ("Large Data Transfer",), "TA0010", "T1041", 7,
         "Data Exfiltration", ("exfiltration", "http", "large_transfer"), 20),
    Rule("HI-013", ("SQL Injection Attempt",), "TA0001", "T1190", 7,
         "Web Application Attack", ("sqli", "web", "initial_access"), 20),
    Rule("HI-014", ("Command Injection Attempt",), "TA0001", "T1190", 8,
         "Web Application Attack", ("command_injection", "web", "initial_access"), 20),
    Rule("HI-015", ("Process Tampering",), "TA0005", "T1562", 8,
         "Defense Evasion", ("defense_evasion", "tampering", "sysmon"), 15),
    Rule("HI-016", ("Alternate Data Stream",), "TA0005", "T1564.004", 7,
         "Defense Evasion", ("ads", "ntfs", "hiding", "sysmon"), 20),
    Rule("HI-017", ("Kerberos Pre-auth Failure", "Kerberos TGT Request", "Kerberos Service Ticket"),
         "TA0006", "T1558.003", 7, "Kerberoasting", ("kerberos", "credential_access", "windows"), 20),
    Rule("ME-001", ("Failed Login",), "TA0006", "T1110.001", 5,
         "Brute Force", ("brute_force", "authentication", "failed_login"), 30),
    Rule("ME-002", ("Invalid User",), "TA0006", "T1110.003", 5,
         "Brute Force", ("brute_force", "ssh", "invalid_user"), 30),
    Rule("ME-003", ("Brute Force",), "TA0006", "T1110", 6,
         "Brute Force", ("brute_force", "ssh", "max_attempts"), 25),
    Rule("ME-004", ("Account Lockout",), "TA0006", "T1110.001", 6,
         "Account Lockout", ("brute_force", "lockout", "windows"), 25),
    Rule("ME-005", ("Authentication Failure",), "TA0006", "T1110", 4,
         "Authentication Failure", ("authentication", "failed", "pam"), 35),
    Rule("ME-006", ("Unauthorized Access Attempt",), "TA0001", "T1190", 5,
         "Unauthorized Access", ("http", "401", "unauthorized"), 30),
    Rule("ME-007", ("Forbidden Access Attempt",), "TA0007", "T1083", 4,
         "Access Control Violation", ("http", "403", "forbidden"), 35),
    Rule("ME-008", ("XSS Attempt",), "TA0001", "T1059.007", 5,
         "Web Application Attack", ("xss", "web", "injection"), 30),
    Rule("ME-009", ("Directory Traversal",), "TA0007", "T1083", 5,
         "Web Application Attack", ("traversal", "web", "path_manipulation"), 30),
    Rule("ME-010", ("Security Group Modified",), "TA0003", "T1098.001", 6,
         "Account Manipulation", ("account", "group", "windows"), 30),
    Rule("ME-011", ("File Created in Suspicious Location",), "TA0002", "T1105", 6,
         "Suspicious File Activity", ("file_creation", "suspicious_path", "sysmon"), 30),
    Rule("ME-012", ("File Timestamp Modified",), "TA0005", "T1070.006", 6,
         "Anti-Forensics", ("timestomping", "evasion", "sysmon"), 30),
    Rule("ME-013", ("File Deleted",), "TA0005", "T1070.004", 5,
         "Anti-Forensics", ("file_deletion", "evasion", "sysmon"), 35),
    Rule("ME-014", ("NTLM Authentication",), "TA0006", "T1557.001", 5,
         "Credential Relay", ("ntlm", "credential_access", "windows"), 35),
    Rule("ME-015", ("Password Reset",), "TA0003", "T1098", 5,
         "Account Manipulation", ("account", "password_reset", "windows"), 35),
    Rule("ME-016", ("Upstream Proxy Error",), "TA0043", "T1595", 3,
         "Reconnaissance", ("proxy", "scanning", "nginx"), 40),
    Rule("LO-001", ("Web Scanner",), "TA0043", "T1595.002", 4,
         "Vulnerability Scanning", ("scanner", "recon", "web"), 40),
    Rule("LO-002", ("Web Scanning",), "TA0043", "T1595", 4,
         "Path Scanning", ("path_scan", "recon", "web"), 40),
    Rule("LO-003", ("Object Access",), "TA0007", "T1083", 3,
         "File Discovery", ("file_access", "audit", "windows"), 45),
    Rule("LO-004", ("DNS Query",), "TA0011", "T1071.004", 3,
         "DNS Activity", ("dns", "c2_potential", "sysmon"), 45),
    Rule("LO-005", ("Successful Login",), "TA0001", "T1078", 2,
         "Authentication", ("authentication", "successful_login", "audit"), 50),
    Rule("IN-001", ("HTTP Request",), "TA0043", "T1595", 1,
         "Web Traffic", ("http", "audit"), 90),
    Rule("IN-002", ("System Log", "System Event"), "TA0040", "T1499", 2,
         "System Event", ("system", "audit"), 90),
    Rule("IN-003", ("HTTP Server Error", "HTTP Client Error", "Web Server Error", "Web Server Warning"),
         "TA0043", "T1595", 2, "Web Error", ("http", "error", "monitoring"), 80),
    Rule("IN-004", ("Windows Event",), "TA0007", "T1082", 1,
         "Audit Event", ("windows", "audit"), 90),
    Rule("IN-005", ("Sysmon Event",), "TA0007", "T1082", 1,
         "Sysmon Event", ("sysmon", "audit"), 90),
    Rule("IN-006", ("Process Creation",), "TA0002", "T1059", 2,
         "Process Execution", ("process", "audit", "sysmon"), 80),
)


def rules_df(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([r.row(i) for i, r in enumerate(rules)], RULE_SCHEMA)


MAX_RULES = 5_000


def load_rules(df: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table; its size is checked because rules become expressions. ``classify_events`` takes a larger table
    as it is."""
    rows = df.orderBy("seq").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return tuple(
        Rule(r.rule_id, tuple(r.patterns), r.tactic_id, r.sub_technique_id or r.technique_id,
             r.severity_score, r.threat_category, tuple(r.tags), r.priority, tuple(r.log_types),
             r.tactic_name, r.technique_name, r.sub_technique_name)
        for r in rows)

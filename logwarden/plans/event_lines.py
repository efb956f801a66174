"""Log lines of five formats, written by formula from an ``events`` table.

One log per user. The line texts are SQL expressions that mean the same in every
SQL dialect apart from the time formats, so expected results can be computed
from the table without a parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER = "('user' || CAST(user_id AS STRING))"
IP = "('185.24.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 250 + 1 AS STRING))"
PID = "CAST(1000 + event_id % 9000 AS STRING)"
PORT = "CAST(1024 + event_id % 60000 AS STRING)"
HOST = "('host' || CAST(user_id % 7 AS STRING))"
DIGIT = "CAST(user_id % 10 AS STRING)"

SYSLOG = f"""{{syslog_time}} || ' ' || {HOST} || ' ' || CASE event_type
  WHEN 'error' THEN 'sshd[' || {PID} || ']: Failed password for ' || {USER} || ' from ' || {IP} || ' port ' || {PORT} || ' ssh2'
  WHEN 'signup' THEN 'sshd[' || {PID} || ']: Accepted password for ' || {USER} || ' from ' || {IP} || ' port ' || {PORT} || ' ssh2'
  WHEN 'click' THEN 'sshd[' || {PID} || ']: Invalid user ' || {USER} || ' from ' || {IP}
  WHEN 'purchase' THEN 'sudo: ' || {USER} || ' : TTY=pts/0 ; PWD=/home/' || {USER} || ' ; USER=root ; COMMAND=/bin/cat /etc/shadow'
  ELSE 'cron[' || {PID} || ']: job done' END"""

WEB_PATH = """(CASE event_type
  WHEN 'error' THEN '/item?id=1%20UNION%20SELECT%20a'
  WHEN 'signup' THEN '/../../etc/passwd'
  WHEN 'click' THEN '/search?q=%3Cscript%3Ex'
  WHEN 'purchase' THEN '/wp-login.php'
  ELSE '/page/' || CAST(event_id % 100 AS STRING) END)"""
WEB_STATUS = "(CASE WHEN event_id % 10 = 0 THEN '403' ELSE '200' END)"

APACHE = f"""{IP} || ' - ' || {USER} || ' [' || {{web_time}} || ' +0000] "GET ' || {WEB_PATH} || ' HTTP/1.1" '
  || {WEB_STATUS} || ' ' || CAST(event_id % 5000 AS STRING) || ' "-" "Mozilla/5.0"'"""

APACHE_ERROR = f"""'[' || {{error_time}} || '] [error] [pid ' || {PID} || '] [client ' || {IP} || '] AH00128: File does not exist: /srv/' || {USER}"""

NGINX_ERROR = f"""{{nginx_time}} || ' [error] ' || {PID} || '#1: *1 connect() failed, client: ' || {IP}
  || ', server: web, request: "GET /x HTTP/1.1", upstream: "http://10.0.0.1/", host: "web"'"""

SYSMON_ID = """(CASE event_type WHEN 'error' THEN '10' WHEN 'signup' THEN '1' WHEN 'click' THEN '3'
  WHEN 'purchase' THEN '13' ELSE '22' END)"""
SYSMON_PORT = "(CASE WHEN event_id % 2 = 0 THEN '4444' ELSE '443' END)"
SYSMON = rf"""'<Event><System><Provider Name=''Microsoft-Windows-Sysmon''/><EventID>' || {SYSMON_ID}
  || '</EventID><TimeCreated SystemTime=''' || {{iso_time}} || 'Z''/><Computer>' || {HOST} || '</Computer></System><EventData>' || CASE event_type
  WHEN 'error' THEN '<Data Name=''SourceImage''>C:\Tools\dump.exe</Data><Data Name=''TargetImage''>C:\Windows\System32\lsass.exe</Data><Data Name=''GrantedAccess''>0x1010</Data>'
  WHEN 'signup' THEN '<Data Name=''ProcessId''>' || {PID} || '</Data><Data Name=''Image''>C:\Windows\System32\powershell.exe</Data><Data Name=''CommandLine''>powershell.exe -enc SQBFAFgA</Data><Data Name=''User''>' || {USER} || '</Data><Data Name=''ParentImage''>C:\Windows\explorer.exe</Data><Data Name=''Hashes''>MD5=' || md5({USER}) || '</Data>'
  WHEN 'click' THEN '<Data Name=''Image''>C:\Windows\System32\svchost.exe</Data><Data Name=''User''>' || {USER} || '</Data><Data Name=''Protocol''>tcp</Data><Data Name=''SourceIp''>' || {IP} || '</Data><Data Name=''SourcePort''>' || {PORT} || '</Data><Data Name=''DestinationIp''>93.184.216.34</Data><Data Name=''DestinationPort''>' || {SYSMON_PORT} || '</Data>'
  WHEN 'purchase' THEN '<Data Name=''Image''>C:\Windows\regedit.exe</Data><Data Name=''TargetObject''>HKLM\SOFTWARE\Microsoft\Windows\CurrentVersion\Run\' || {USER} || '</Data><Data Name=''Details''>on</Data>'
  ELSE '<Data Name=''Image''>C:\Windows\System32\svchost.exe</Data><Data Name=''QueryName''>' || {USER} || '.evil-c2.xyz</Data><Data Name=''QueryType''>A</Data><Data Name=''QueryResults''>' || {IP} || '</Data>' END
  || '</EventData></Event>'"""

WINDOWS_ID = """(CASE event_type WHEN 'error' THEN '4625' WHEN 'signup' THEN '4624' WHEN 'click' THEN '4648'
  WHEN 'purchase' THEN '4672' ELSE '4688' END)"""
WINDOWS = f"""'Log Name: Security Source Name: Audit Event Type: Audit Keywords: none EventID=' || {WINDOWS_ID}
  || ' Security ID: S-1 Logon Type: 3 Account Name: ' || {USER} || ' Source Network Address: ' || {IP}
  || ' Source Port: ' || {PORT} || ' Logged: ' || {{us_time}}"""
WINDOWS_XML = f"""'<Event xmlns=''evt''><System><EventID>' || {WINDOWS_ID} || '</EventID><Computer>' || {HOST}
  || '</Computer><TimeCreated SystemTime=''' || {{iso_time}} || 'Z''/></System><EventData><Data Name=''TargetUserName''>'
  || {USER} || '</Data><Data Name=''IpAddress''>' || {IP} || '</Data><Data Name=''IpPort''>' || {PORT} || '</Data></EventData></Event>'"""

THREAT_NOTE = rf"""'peer 2001:0DB8:0:0:0:0:0:' || {{hex_id}} || ' used CVE-2024-' || CAST(10000 + event_id % 90000 AS STRING)
  || ' mail ' || {USER} || '@evil-' || {DIGIT} || '.xyz file "C:\Users\' || {USER} || '\payload.exe" wrote /tmp/' || {USER}
  || '/drop.sh key "HKLM\Software\Run\' || {USER} || '" md5 ' || md5({USER}) || ' ip 185[.]24[.]'
  || CAST(user_id % 256 AS STRING) || '[.]' || CAST(event_id % 250 + 1 AS STRING) || ' url hxxp://c2-' || {DIGIT} || '.net/a'"""

SPARK_TIMES = {
    "syslog_time": "date_format(ts, 'MMM d HH:mm:ss')",
    "web_time": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "error_time": "date_format(ts, 'EEE MMM dd HH:mm:ss.SSSSSS yyyy')",
    "nginx_time": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')",
    "iso_time": "date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS')",
    "us_time": "date_format(ts, 'M/d/yyyy H:mm:ss')",
    "hex_id": "lower(hex(event_id % 60000 + 1))",
}


def spark_text(template: str) -> str:
    return template.replace("\\", "\\\\").format(**SPARK_TIMES)


def lines_of(events: DataFrame, template: str, log_type: str | None = None, offset: int = 0,
             logs_per_user: int = 1) -> DataFrame:
    """Lines of one format: a log per user, numbered by event."""
    columns = [
        (F.col("user_id") * logs_per_user + offset).alias("log_id"),
        (F.col("event_id") + 1).cast("int").alias("line_number"),
        F.expr(spark_text(template)).alias("raw_line")]
    if log_type:
        columns.append(F.lit(log_type).alias("log_type"))
    return events.select(*columns)


FORMATS = {"linux_syslog": SYSLOG, "apache_access": APACHE, "nginx_access": APACHE, "sysmon": SYSMON,
           "windows_event": WINDOWS}


def all_lines(events: DataFrame) -> DataFrame:
    """Lines of all formats with their type, a log per user and format."""
    parts = [lines_of(events, t, name, i, len(FORMATS)) for i, (name, t) in enumerate(FORMATS.items())]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return united

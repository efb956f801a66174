"""The catalog's expected results as SQL over the same tables.

Results of parsing are computed from the ``events`` table directly, without any
parser; the others are plain SQL formulations of the job.
"""

from __future__ import annotations

from logwarden.operators.detect import SIGNATURES
from logwarden.operators.iocs import BENIGN_HASHES, BENIGN_IPS, BORING_PORTS
from logwarden.operators.rules import RULES
from logwarden.plans import event_lines as E

TIMES = {
    "syslog_time": "strftime(ts, '%b %-d %H:%M:%S')",
    "web_time": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "error_time": "strftime(ts, '%a %b %d %H:%M:%S.%f %Y')",
    "nginx_time": "strftime(ts, '%Y/%m/%d %H:%M:%S')",
    "iso_time": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
    "us_time": "strftime(ts, '%-m/%-d/%Y %-H:%M:%S')",
    "hex_id": "format('{:x}', event_id % 60000 + 1)",
}
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
BORING = ", ".join(str(p) for p in BORING_PORTS)


def line(template: str) -> str:
    return template.format(**TIMES)


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda x: x <> '')"


# What each line template must give, by place; None where the line is no event. {n} is the event's number.
BRANCH_RESULTS = {
    "syslog_branches": (("event_type", "process_name", "file_path", "process_id"), (
        ("Brute Force", "sshd", "", 9), ("Authentication Failure", "login", "", -1), ("System Event", "java", "", 77),
        ("System Event", "kernel", "", -1), ("System Log", "app", "", -1), ("System Log", "cron", "", 3),
        ("Successful Login", "sshd", "", 9), None)),
    "apache_branches": (("event_type",), (
        ("SQL Injection Attempt",), ("XSS Attempt",), ("Directory Traversal",), ("Command Injection Attempt",), ("Web Scanner",),
        ("Web Scanning",), ("Large Data Transfer",), ("Unauthorized Access Attempt",), ("Forbidden Access Attempt",),
        ("HTTP Client Error",), ("HTTP Client Error",), ("HTTP Request",))),
    "nginx_branches": (("event_type",), (
        ("SQL Injection Attempt",), ("XSS Attempt",), ("Directory Traversal",), ("Command Injection Attempt",), ("Web Scanner",),
        ("Web Scanning",), ("Large Data Transfer",), ("Unauthorized Access Attempt",), ("Forbidden Access Attempt",),
        ("HTTP Client Error",), ("HTTP Client Error",), ("HTTP Request",), ("HTTP Client Error",), ("Web Server Error",),
        ("Web Server Warning",), ("Web Server Event",))),
    "sysmon_branches": (("event_type", "process_name", "file_path"), (
        ("LSASS Injection", "b{n}.exe", ""), ("Remote Thread Created", "", ""), ("Process Access", "c.exe", ""),
        ("Credential Dumping Attempt", "x.exe", "C:\\x.exe"), ("Suspicious Child Process", "cmd.exe", "C:\\cmd.exe"),
        ("LOLBin Execution", "cmd.exe", "C:\\Temp\\cmd.exe"), ("Process Creation", "x{n}.exe", "C:\\x{n}.exe"),
        ("Unsigned DLL Loaded", "", "C:\\a{n}.dll"), ("DLL from Suspicious Path", "", "C:\\Temp\\a.dll"),
        ("DLL Loaded", "p.exe", "C:\\a.dll"), ("File Created in Suspicious Location", "", "C:\\Users\\Public\\a{n}.exe"),
        ("File Created", "", "C:\\a{n}.txt"), ("File Deleted", "", "C:\\d{n}"), ("Registry Key Created", "", "HKLM\\x{n}"),
        ("Sysmon Event 99", "", ""))),
    "windows_branches": (("event_type", "process_name", "process_id"), (
        ("Windows Event", "C:\\x{n}.exe", -1), ("Windows Event", "", -1), ("Process Creation", "", 31), None,
        ("Successful Login", "", -1), None)),
}


def branch_sql(columns: tuple, results: tuple) -> str:
    def value(x: object) -> str:
        return str(x) if isinstance(x, int) else f"replace({quoted(str(x))}, '{{n}}', CAST(event_id AS VARCHAR))"

    rows = [f"SELECT event_id, user_id, {', '.join(f'{value(v)} AS {c}' for c, v in zip(columns, r))} FROM events "
            f"WHERE event_id % {len(results)} = {i}" for i, r in enumerate(results) if r is not None]
    return (f"SELECT user_id AS log_id, CAST(event_id + 1 AS INTEGER) AS line_number, {', '.join(columns)} "
            f"FROM ({' UNION ALL '.join(rows)})")


EVENTS = f"""e AS (SELECT event_id, ts, user_id, event_type AS et, {E.USER} AS u, {E.IP} AS ip, {E.HOST} AS host,
  CAST({E.PORT} AS INTEGER) AS port, CAST({E.PID} AS INTEGER) AS pid, {E.DIGIT} AS dg,
  CAST(event_id + 1 AS INTEGER) AS ln, epoch_us(date_trunc('second', ts)) AS sec, epoch_us(ts) AS us FROM events)"""

SYSLOG_TYPE = """CASE et WHEN 'error' THEN 'Failed Login' WHEN 'signup' THEN 'Successful Login'
  WHEN 'click' THEN 'Invalid User' WHEN 'purchase' THEN 'Privilege Escalation' ELSE 'System Log' END"""
WEB_TYPE = """CASE et WHEN 'error' THEN 'SQL Injection Attempt' WHEN 'signup' THEN 'Directory Traversal'
  WHEN 'click' THEN 'XSS Attempt' WHEN 'purchase' THEN 'Web Scanning'
  ELSE CASE WHEN event_id % 10 = 0 THEN 'Forbidden Access Attempt' ELSE 'HTTP Request' END END"""
WEB_PATH = """CASE et WHEN 'error' THEN '/item?id=1%20UNION%20SELECT%20a' WHEN 'signup' THEN '/../../etc/passwd'
  WHEN 'click' THEN '/search?q=%3Cscript%3Ex' WHEN 'purchase' THEN '/wp-login.php'
  ELSE '/page/' || (event_id % 100)::VARCHAR END"""
SYSMON_TYPE = """CASE et WHEN 'error' THEN 'LSASS Access (Credential Dump)' WHEN 'signup' THEN 'Encoded PowerShell'
  WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Suspicious Network Connection' ELSE 'Network Connection' END
  WHEN 'purchase' THEN 'Registry Persistence' ELSE 'DNS Query' END"""
WINDOWS_TYPE = """CASE et WHEN 'error' THEN 'Failed Login' WHEN 'signup' THEN 'Successful Login'
  WHEN 'click' THEN 'Explicit Credential Logon' WHEN 'purchase' THEN 'Privilege Escalation' ELSE 'Process Creation' END"""
WINDOWS_ID = "CASE et WHEN 'error' THEN '4625' WHEN 'signup' THEN '4624' WHEN 'click' THEN '4648' WHEN 'purchase' THEN '4672' ELSE '4688' END"

ALL = f"""{EVENTS}, x5 AS (
  SELECT user_id * 5 AS log_id, ln AS line_number, 'linux_syslog' AS log_type, {SYSLOG_TYPE} AS event_type,
    CASE WHEN et IN ('error', 'signup', 'click') THEN ip END AS source_ip, CASE WHEN et <> 'view' THEN u END AS username FROM e
  UNION ALL SELECT user_id * 5 + 1, ln, 'apache_access', {WEB_TYPE}, ip, u FROM e
  UNION ALL SELECT user_id * 5 + 2, ln, 'nginx_access', {WEB_TYPE}, ip, u FROM e
  UNION ALL SELECT user_id * 5 + 3, ln, 'sysmon', {SYSMON_TYPE}, CASE WHEN et = 'click' THEN ip END,
    CASE WHEN et IN ('signup', 'click') THEN u END FROM e
  UNION ALL SELECT user_id * 5 + 4, ln, 'windows_event', {WINDOWS_TYPE}, ip, u FROM e)"""

SYSLOG = f"""{EVENTS}, s AS (SELECT user_id AS log_id, ln AS line_number, 'linux_syslog' AS log_type, {SYSLOG_TYPE} AS event_type,
    CASE WHEN et IN ('error', 'signup', 'click') THEN ip END AS source_ip, e.* FROM e)"""


def _rule_rows() -> str:
    rows = []
    for seq, rule in enumerate(RULES):
        r = rule.row(seq)
        for pattern in rule.patterns:
            for log_type in rule.log_types or (None,):
                tags = "[" + ", ".join(quoted(t) for t in rule.tags) + "]"
                rows.append(f"({quoted(r[0])}, {quoted(pattern.lower())}, {quoted(log_type)}, {quoted(r[3])}, {quoted(r[4])}, "
                            f"{quoted(r[5])}, {quoted(r[6])}, {quoted(r[7])}, {r[9]}, {quoted(r[10])}, {tags}, {r[12] * 1000 + seq})")
    return ",\n".join(rows)


def classified(source: str) -> str:
    """CTEs ``rules``, ``cls`` (per type) and ``c`` (events of ``source`` classified)."""
    return f"""rules(rule_id, pattern, rule_log, tactic_id, tactic, tech, tech_name, sub, score, category, tags, ord) AS (VALUES
{_rule_rows()}),
  types AS (SELECT DISTINCT log_type, event_type FROM {source}),
  m AS (SELECT DISTINCT t.log_type, t.event_type, r.rule_id, rule_log, tactic, tech, tech_name, sub, score, category, tags, ord
    FROM types t JOIN rules r ON contains(lower(t.event_type), r.pattern) AND (r.rule_log IS NULL OR r.rule_log = t.log_type)),
  cls AS (SELECT log_type, event_type, max(score) AS score, count(*) AS n, string_agg(rule_id, '|' ORDER BY ord) AS matched_rules,
    arg_min(tactic, ord) AS tactic, arg_min(tech, ord) AS tech, arg_min(tech_name, ord) AS tech_name, arg_min(sub, ord) AS sub,
    arg_min(category, ord) AS category, arg_min(rule_log IS NOT NULL, ord) AS narrowed,
    array_to_string(flatten(list(tags ORDER BY ord)), '|') AS tags FROM m GROUP BY 1, 2),
  c AS (SELECT x.*, CASE WHEN coalesce(score, 1) >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'medium'
      WHEN score >= 3 THEN 'low' ELSE 'info' END AS severity, coalesce(score, 1) AS severity_score, tech AS mitre_technique_id,
      tech_name AS mitre_technique_name, tactic AS mitre_tactic, sub AS sub_technique_id, coalesce(category, 'Unclassified') AS threat_category,
      CASE WHEN n > 0 THEN round(0.7 + CASE WHEN narrowed THEN 0.1 ELSE 0 END + least(0.1, 0.02 * n), 2) ELSE 0.0 END AS confidence,
      coalesce(matched_rules, '') AS matched_rules, coalesce(tags, '') AS tags, n IS NOT NULL AS is_classified
    FROM {source} x LEFT JOIN cls USING (log_type, event_type))"""


C5 = f"WITH {ALL}, {classified('x5')}"
CS = f"WITH {SYSLOG}, {classified('s')}"


def hit(kind: str, value: str, confidence: float, field: str) -> str:
    return f"{{'t': '{kind}', 'v': {value}, 'c': {confidence}, 'f': '{field}'}}"


PORT_HIT = f"CASE WHEN port NOT IN ({BORING}) AND port BETWEEN 1 AND 65535 THEN {hit('port', 'port::VARCHAR', 0.9, 'source_port')} END"
_IP, _USER, _HOST = hit("ipv4", "ip", 1.0, "source_ip"), hit("username", "u", 0.9, "username"), hit("domain", "host", 0.8, "hostname")
_PATHS = ", ".join([hit("file_path", "'/bin/cat'", 0.85, "command_line"), hit("file_path", "'/etc/shadow'", 0.85, "command_line"),
                    hit("file_path", "'/home/' || u", 0.85, "normalized_data.working_dir")])
SYSLOG_IOCS = f"""{SYSLOG}, hl AS (SELECT log_id, line_number, list_filter(CASE
      WHEN et IN ('error', 'signup') THEN [{_IP}, {_USER}, {_HOST}, {PORT_HIT}]
      WHEN et = 'click' THEN [{_IP}, {_USER}, {_HOST}]
      WHEN et = 'purchase' THEN [{_USER}, {_HOST}, {_PATHS}]
      ELSE [{_HOST}] END, lambda h: h IS NOT NULL) AS hits FROM s),
  si AS (SELECT log_id, line_number, generate_subscripts(hits, 1) - 1 AS position, unnest(hits) AS h FROM hl),
  sf AS (SELECT log_id, h.t AS ioc_type, h.v AS value, arg_min(line_number, line_number * 100 + position) AS line_number,
    arg_min(h.f, line_number * 100 + position) AS source_field, count(*) AS event_count FROM si GROUP BY 1, 2, 3)"""

WINDOWS_IOCS = f"""wl AS (SELECT user_id AS log_id, ln AS line_number,
    list_filter([{_IP}, {_USER}, {PORT_HIT}], lambda h: h IS NOT NULL) AS hits FROM e),
  wi AS (SELECT log_id, unnest(hits) AS h FROM wl), wf AS (SELECT DISTINCT log_id, h.t AS ioc_type, h.v AS value FROM wi)"""

INCIDENTS = f"""{SYSLOG_IOCS}, {WINDOWS_IOCS}, iv AS (
  SELECT user_id AS log_id, 'Privilege Escalation' AS event_type, NULL AS ip, host, 'T1548' AS tech, 'Privilege Escalation' AS tactic,
    'Privilege Escalation' AS category, 'high' AS severity, len(hits) AS n FROM e JOIN hl ON hl.line_number = e.ln WHERE et = 'purchase'
  UNION ALL SELECT user_id + 1000000000, 'Explicit Credential Logon', ip, NULL, 'T1550', 'Lateral Movement', 'Lateral Movement', 'high',
    len(hits) FROM e JOIN wl ON wl.line_number = e.ln WHERE et = 'click'
  UNION ALL SELECT user_id + 1000000000, 'Privilege Escalation', ip, NULL, 'T1548', 'Privilege Escalation', 'Privilege Escalation', 'high',
    len(hits) FROM e JOIN wl ON wl.line_number = e.ln WHERE et = 'purchase'),
  inc AS (SELECT log_id, category || ' — ' || event_type || coalesce(' — ' || ip, '') AS title,
    'Auto-detected: ' || count(*) || ' event(s) of type ''' || event_type || ''' from ' || coalesce(ip, 'unknown') || '. MITRE: ' || tech
      || '. Pipeline run on log_id=' || log_id || '.' AS description, severity, 'open' AS status, event_type, count(*) AS event_count,
    sum(n)::BIGINT AS ioc_count, tech AS mitre_techniques, tactic AS mitre_tactics, ip AS source_ips, max(host) AS affected_hosts
    FROM iv GROUP BY log_id, event_type, ip, tech, tactic, category, severity)"""

LOGS = f"""logs AS (SELECT user_id AS log_id, CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' ELSE 'completed' END AS status,
    CASE user_id % 5 WHEN 0 THEN 'linux_syslog' WHEN 1 THEN 'apache_access' WHEN 2 THEN 'nginx_access' WHEN 3 THEN 'sysmon' ELSE 'windows_event' END AS log_type,
    epoch_us(min(ts)) AS created_at FROM events GROUP BY user_id)"""

LINES5 = "l5 AS (" + "\n UNION ALL ".join(
    f"SELECT user_id * 5 + {i} AS log_id, CAST(event_id + 1 AS INTEGER) AS line_number, {line(t)} AS raw_line FROM events"
    for i, t in enumerate(E.FORMATS.values())) + """),
  smp AS (SELECT log_id, line_number, trim(raw_line) AS raw_line FROM l5 QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_number) <= 30)"""


def _scores() -> str:
    out = []
    for log_type, patterns in SIGNATURES.items():
        total = sum(w for _, w in patterns)
        terms = " + ".join(f"CASE WHEN bool_or(regexp_matches(raw_line, {quoted(p)})) THEN {w} ELSE 0 END" for p, w in patterns)
        out.append(f"({terms}) / {total}::DOUBLE AS score_{log_type}")
    return ",\n  ".join(out)


def _best() -> str:
    names = list(SIGNATURES)
    top = "greatest(" + ", ".join(f"score_{t}" for t in names) + ")"
    case = " ".join(f"WHEN score_{t} = {top} THEN '{t}'" for t in names)
    return f"SELECT log_id, CASE WHEN {top} < 0.4 THEN 'unknown' ELSE CASE {case} END END AS log_type, {top} AS confidence FROM sc"


DETECT = f"{LINES5}, sc AS (SELECT log_id, {_scores()} FROM smp GROUP BY log_id), det AS ({_best()})"

VALIDATION = f"""d AS (SELECT *, {strip('text')} AS content FROM documents),
  v AS (SELECT *, length(content) AS chars, len({words('content')}) AS wc FROM d),
  vr AS (SELECT *, CASE WHEN chars = 0 THEN 'Content is empty or whitespace-only'
    WHEN chars < 50 THEN 'Content too short: ' || chars || ' chars (minimum is 50)'
    WHEN wc < 10 THEN 'Too few words: ' || wc || ' (minimum is 10)' ELSE '' END AS reason FROM v)"""

BM25 = f"""tok AS (SELECT node_id, text, {words('lower(text)')} AS ws FROM nodes WHERE text IS NOT NULL AND text <> ''),
  p AS (SELECT term, node_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT node_id, unnest(ws) AS term, len(ws) AS dl FROM tok) GROUP BY 1, 2),
  n AS (SELECT count(*) AS n_nodes, avg(len(ws)) AS avg_len FROM tok),
  t AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  r AS (SELECT term, df, ln(n_nodes - df + 0.5) - ln(df + 0.5) AS raw FROM t, n),
  mi AS (SELECT round(avg(raw), 10) AS m FROM r),
  idf AS (SELECT term, df, CASE WHEN raw < 0 THEN m * 0.25 ELSE raw END AS idf FROM r, mi)"""


def bm25_top(queries: str) -> str:
    """The best 30 nodes of the queries: (query_id, text)."""
    return f"""{BM25},
  q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words('lower(text)')}) AS term FROM ({queries})) GROUP BY 1, 2),
  sp AS (SELECT query_id, node_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
    FROM p JOIN q USING (term) JOIN idf USING (term), n GROUP BY 1, 2),
  sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM sp) WHERE rank <= 30 AND score > 0)"""


BM25_TOP = bm25_top("SELECT item_id AS query_id, text FROM benchmark")
DOC_NODES = "nodes AS (SELECT doc_id AS node_id, text FROM documents)"
ALL_NODES = """nodes AS (SELECT coalesce(doc_id, vec_id) AS node_id, text, source AS source_type, embedding
    FROM documents FULL OUTER JOIN embeddings ON doc_id = vec_id)"""
CENTROIDS = """cp AS (SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x
    FROM embeddings) GROUP BY 1, 2),
  ce AS (SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS vector FROM cp GROUP BY label)"""


def dense(queries: str, nodes: str, k: int, where: str = "true") -> str:
    return f"""dn AS (SELECT query_id, node_id, round(list_inner_product(vector, embedding::DOUBLE[]) /
      (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS score
      FROM {queries}, {nodes} WHERE embedding IS NOT NULL AND {where}),
  dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM dn) WHERE rank <= {k})"""


FUSED = f"""{ALL_NODES}, {BM25_TOP}, {CENTROIDS},
  hq AS (SELECT item_id AS query_id, vector FROM benchmark JOIN ce ON ce.query_id = item_id % 10), {dense('hq', 'nodes', 30)},
  fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.node_id, b.node_id) AS node_id,
    round(coalesce(0.7 / (60 + a.rank), 0.0) + coalesce(0.3 / (60 + b.rank), 0.0), 8) AS rrf_score
    FROM dense a FULL OUTER JOIN sparse b ON a.query_id = b.query_id AND a.node_id = b.node_id),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, node_id) AS rank FROM fu)"""

TEXT_IOC_TYPES = ["md5", "ipv4", "ipv6", "cve", "email", "url", "domain", "domain", "domain", "file_path", "file_path",
                  "file_path", "file_path", "file_path", "filename", "filename"]
TEXT_IOC_VALUES = [
    "md5(u)", "ip", "'2001:db8::' || format('{:x}', event_id % 60000 + 1)", "'CVE-2024-' || (10000 + event_id % 90000)",
    "u || '@evil-' || dg || '.xyz'", "'http://c2-' || dg || '.net/a'", "dg || '.xyz'", "'payload.exe'", "dg || '.net'",
    r"'C:\Users\' || u || '\payload.exe'", "'p://c2-' || dg || '.net/a'", "'/tmp/' || u || '/drop.sh'",
    "'//c2-' || dg || '.net/a'", r"'HKLM\Software\Run\' || u", "'ayload.exe'", "'rop.sh'"]
TEXT_IOC_CONFIDENCE = [0.9, 1.0, 1.0, 1.0, 0.95, 0.95, 0.8, 0.8, 0.8, 0.9, 0.9, 0.85, 0.85, 1.0, 0.75, 0.75]

_IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)(?:\[?\.\]?|\(?\.?\)?)){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)"
_REFANGED = (r"regexp_replace(regexp_replace({t}, '\[\.?\]|\(\.?\)|\{{\.?\}}', '.', 'g'), '(?i)h(?:xx|__)p(s?)', 'http\1', 'g')")


def refanged(text: str) -> str:
    return _REFANGED.format(t=text)


def _hash_sql(kind: str, n: int) -> str:
    benign = ", ".join(quoted(h) for h in BENIGN_HASHES)
    return (f"SELECT DISTINCT doc_id, '{kind}' AS ioc_type, lower(h) AS value FROM (SELECT doc_id, unnest(regexp_extract_all("
            rf"regexp_replace({refanged('text')}, '([^0-9a-fA-F])', '\1\1', 'g'), '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{{{n}}})(?:$|[^0-9a-fA-F])', 1)) AS h"
            f" FROM documents) WHERE lower(h) NOT IN ({benign})")


_A = "split_part(v, '.', 1)::INT"
_B = "split_part(v, '.', 2)::INT"
_C = "split_part(v, '.', 3)::INT"
_PRIVATE = f"""({_A} IN (0, 10, 127) OR {_A} >= 224 OR ({_A} = 169 AND {_B} = 254) OR ({_A} = 172 AND {_B} BETWEEN 16 AND 31)
  OR ({_A} = 192 AND {_B} = 0 AND {_C} IN (0, 2) AND v NOT IN ('192.0.0.9', '192.0.0.10')) OR ({_A} = 192 AND {_B} = 168)
  OR ({_A} = 198 AND {_B} IN (18, 19)) OR ({_A} = 198 AND {_B} = 51 AND {_C} = 100) OR ({_A} = 203 AND {_B} = 0 AND {_C} = 113))"""


def severities(prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_events" for s in ("critical", "high", "medium", "low", "info"))


def oracle_sql() -> dict[str, str]:
    break_ = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    folder = "CASE lang WHEN 'de' THEN 'playbooks' WHEN 'fr' THEN 'NVD' WHEN 'es' THEN 'rules' ELSE source END"
    path = f"'/kb/' || {folder} || '/' || source || '/T' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || CASE WHEN lang = 'es' THEN '.pdf' ELSE '.md' END"
    top_ip = "string_agg(source_ip || '=' || n, '|' ORDER BY n DESC, source_ip)"
    return {
        "read_log_lines": f"""WITH f AS (SELECT doc_id AS log_id, regexp_split_to_array(text, '{break_}') AS parts FROM documents),
            g AS (SELECT log_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS raw_line FROM f)
            SELECT log_id, i::INTEGER AS line_number, raw_line FROM g WHERE regexp_matches(raw_line, '{NOT_WS}')""",
        "log_file_stats": f"""SELECT doc_id AS log_id, (length(text) - length(replace(text, chr(10), '')) +
            CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS line_count, strlen(text)::BIGINT AS file_size_bytes,
            CASE WHEN NOT regexp_matches(text, '{NOT_WS}') THEN 'empty' WHEN strlen(text) > 104857600 THEN 'too_large' ELSE '' END AS rejected FROM documents""",
        "read_big_log_lines": f"""SELECT md5(t) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents WHERE text <> '')
            WHERE regexp_matches(t, '{NOT_WS}') GROUP BY 1""",
        "line_numbers": f"""SELECT count(*) AS lines, 0::BIGINT AS different FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents WHERE text <> '')
            WHERE regexp_matches(t, '{NOT_WS}')""",
        "rejected_files": f"""SELECT (SELECT count(DISTINCT source) FROM documents) AS files, true AS some_rejected, (SELECT count(DISTINCT source) FROM documents) AS files_with_lines,
            count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents WHERE text <> '') WHERE regexp_matches(t, '{NOT_WS}')""",
        "write_events": f"""WITH {SYSLOG}, t AS (SELECT *, {line(E.SYSLOG).replace('event_type', 'et')} AS raw FROM s)
            SELECT strftime(ts, '%Y-%m-%d') AS event_date, event_type, count(*) AS n, max(length(raw))::BIGINT AS longest FROM t GROUP BY 1, 2""",
        "upsert_iocs": f"""WITH {SYSLOG_IOCS}, {WINDOWS_IOCS}, both_ AS (
              SELECT log_id, ioc_type, value, 1704067200000000 AS seen FROM sf UNION ALL SELECT log_id, ioc_type, value, 1704153600000000 FROM wf)
            SELECT log_id, ioc_type, value, count(*) AS occurrence_count, min(seen) AS first_seen, max(seen) AS last_seen FROM both_ GROUP BY 1, 2, 3""",
        "upsert_iocs_stored": f"""WITH {SYSLOG_IOCS}, {WINDOWS_IOCS}, both_ AS (
              SELECT log_id, ioc_type, value, 1704067200000000 AS seen FROM sf UNION ALL SELECT log_id, ioc_type, value, 1704153600000000 FROM wf)
            SELECT log_id, ioc_type, value, count(*) AS occurrence_count, min(seen) AS first_seen, max(seen) AS last_seen FROM both_ GROUP BY 1, 2, 3""",
        "upsert_chunks": """SELECT 'd' || doc_id AS node_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS version,
            md5(CASE WHEN l.doc_id IS NULL THEN text ELSE lower(text) END) AS text_md5 FROM documents LEFT JOIN labels l USING (doc_id)""".replace("'d' || doc_id", "'d' || documents.doc_id"),
        "delete_by_doc_hash": "SELECT doc_id, sha256(text) AS doc_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'es')",
        "deleted_counts": "SELECT sha256(text) AS doc_hash, count(*) AS deleted FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'es') GROUP BY 1",
        "text_docs": f"""SELECT {path} AS source_path, CASE lang WHEN 'de' THEN 'playbook' WHEN 'fr' THEN 'nvd' ELSE 'custom' END AS source_type,
            sha256({strip('text')}) AS doc_hash, 'T' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS technique_id, '.md' AS file_extension,
            length({strip('text')})::BIGINT AS chars FROM documents WHERE lang <> 'es' AND regexp_matches(text, '{NOT_WS}')""",
        "json_docs": f"""SELECT sha256({strip('text')}) AS doc_hash, 'nvd' AS source_type, 'http://kb/' || source AS source_url,
            'CVE-2024-' || (doc_id + 10000) AS cve_id, CASE WHEN lang = 'de' THEN 'medium' ELSE 'high' END AS severity, lang, n_chars::VARCHAR AS n_chars FROM documents""",
        "scroll_chunks": "SELECT doc_id AS node_id, source AS source_type, lang FROM documents WHERE source = 'src3' AND doc_id > 50 ORDER BY doc_id LIMIT 100",
        "recent_activity": """SELECT * FROM (SELECT user_id, event_id AS audit_id, event_type AS action,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50""",
        "sample_lines": f"WITH {LINES5} SELECT log_id, line_number, raw_line FROM smp",
        "score_formats": f"WITH {DETECT} SELECT log_id, {', '.join(f'round(score_{t}, 6) AS score_{t}' for t in SIGNATURES)} FROM sc",
        "detect_formats": f"WITH {DETECT} SELECT log_id, log_type, round(confidence, 6) AS confidence FROM det",
        "detect_with_override": f"""WITH {DETECT} SELECT log_id, CASE WHEN log_id % 5 = 2 THEN 'nginx_access' ELSE log_type END AS log_type,
            CASE WHEN log_id % 5 = 2 THEN 1.0 ELSE round(confidence, 6) END AS confidence FROM det""",
        "syslog_parse": f"""WITH {EVENTS} SELECT user_id AS log_id, ln AS line_number, {SYSLOG_TYPE} AS event_type, CASE WHEN et <> 'view' THEN u END AS username,
            CASE WHEN et IN ('error', 'signup', 'click') THEN ip END AS source_ip, CASE WHEN et IN ('error', 'signup') THEN port END AS source_port,
            CASE et WHEN 'purchase' THEN 'sudo' WHEN 'view' THEN 'cron' ELSE 'SSH' END AS service, host AS hostname,
            CASE et WHEN 'purchase' THEN 'sudo' WHEN 'view' THEN 'cron' ELSE 'sshd' END AS process_name, CASE WHEN et <> 'purchase' THEN pid END AS process_id,
            CASE WHEN et = 'purchase' THEN '/bin/cat /etc/shadow' END AS command_line, CASE WHEN et = 'purchase' THEN '/home/' || u END AS working_dir,
            sec AS event_timestamp FROM e""",
        "apache_parse": f"""WITH {EVENTS}, w AS (SELECT *, {WEB_TYPE} AS event_type, {WEB_PATH} AS url FROM e)
            SELECT user_id AS log_id, ln AS line_number, event_type, u AS username, ip AS source_ip, 80 AS dest_port, 'HTTP' AS protocol, url, 'GET' AS http_method,
            CASE WHEN event_id % 10 = 0 THEN 403 ELSE 200 END AS http_status_code, 'Mozilla/5.0' AS user_agent, (event_id % 5000)::VARCHAR AS bytes,
            CASE et WHEN 'error' THEN 'sql_injection' WHEN 'signup' THEN 'directory_traversal' WHEN 'click' THEN 'xss' END AS attack_type,
            CASE et WHEN 'error' THEN '/item?id=1 UNION SELECT a' WHEN 'click' THEN '/search?q=<script>x' END AS decoded_path, sec AS event_timestamp FROM w""",
        "apache_error_parse": f"""WITH {EVENTS} SELECT user_id AS log_id, ln AS line_number, 'Web Server Error' AS event_type, NULL::VARCHAR AS username, ip AS source_ip,
            pid AS process_id, 'HTTP' AS service, 'AH00128: File does not exist: /srv/' || u AS message, 'true' AS is_error, us AS event_timestamp FROM e""",
        "nginx_parse": f"""WITH {EVENTS} SELECT user_id AS log_id, ln AS line_number, {WEB_TYPE} AS event_type, u AS username, ip AS source_ip, {WEB_PATH} AS url,
            CASE WHEN event_id % 10 = 0 THEN 403 ELSE 200 END AS http_status_code, 'Mozilla/5.0' AS user_agent, NULL::VARCHAR AS referer, sec AS event_timestamp FROM e""",
        "nginx_error_parse": f"""WITH {EVENTS} SELECT user_id AS log_id, ln AS line_number, 'Upstream Proxy Error' AS event_type, NULL::VARCHAR AS username, ip AS source_ip,
            'GET' AS http_method, '/x' AS url, 'web' AS hostname, pid AS process_id, 'http://10.0.0.1/' AS upstream, sec AS event_timestamp FROM e""",
        "sysmon_parse": rf"""WITH {EVENTS} SELECT user_id AS log_id, ln AS line_number, {SYSMON_TYPE} AS event_type, CASE WHEN et IN ('signup', 'click') THEN u END AS username,
            CASE WHEN et = 'click' THEN ip END AS source_ip, CASE WHEN et = 'click' THEN '93.184.216.34' END AS dest_ip, CASE WHEN et = 'click' THEN port END AS source_port,
            CASE WHEN et = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 4444 ELSE 443 END END AS dest_port, CASE WHEN et = 'click' THEN 'TCP' END AS protocol,
            host AS hostname, CASE et WHEN 'error' THEN 'dump.exe' WHEN 'signup' THEN 'powershell.exe' WHEN 'purchase' THEN 'regedit.exe' ELSE 'svchost.exe' END AS process_name,
            CASE WHEN et = 'signup' THEN pid END AS process_id, CASE WHEN et = 'signup' THEN 'powershell.exe -enc SQBFAFgA' END AS command_line,
            CASE et WHEN 'signup' THEN 'C:\Windows\System32\powershell.exe' WHEN 'purchase' THEN 'HKLM\SOFTWARE\Microsoft\Windows\CurrentVersion\Run\' || u END AS file_path,
            CASE WHEN et = 'view' THEN u || '.evil-c2.xyz' END AS url, CASE et WHEN 'error' THEN '10' WHEN 'signup' THEN '1' WHEN 'click' THEN '3' WHEN 'purchase' THEN '13' ELSE '22' END AS event_id,
            CASE WHEN et = 'signup' THEN 'MD5=' || md5(u) END AS hashes, CASE et WHEN 'error' THEN 3 WHEN 'signup' THEN 6 WHEN 'click' THEN 7 WHEN 'purchase' THEN 3 ELSE 4 END::BIGINT AS n_fields,
            us AS event_timestamp FROM e""",
        "windows_parse": f"""WITH {EVENTS} SELECT user_id AS log_id, ln AS line_number, {WINDOWS_TYPE} AS event_type, u AS username, ip AS source_ip, port AS source_port,
            {WINDOWS_ID} AS event_id, sec AS event_timestamp FROM e""",
        "windows_xml_parse": f"""WITH {EVENTS} SELECT user_id AS log_id, ln AS line_number, {WINDOWS_TYPE} AS event_type, u AS username, ip AS source_ip, port AS source_port,
            host AS hostname, {WINDOWS_ID} AS event_id, us AS event_timestamp FROM e""",
        "parse_dispatch": f"WITH {ALL} SELECT log_id, line_number, log_type, event_type, source_ip, username FROM x5",
        "url_decode": "SELECT page_id, url || '+%zz' AS decoded FROM pages",
        "refang": "SELECT page_id, url FROM pages",
        "ioc_email": f"""SELECT DISTINCT doc_id, 'email' AS ioc_type, lower(m) AS value FROM (SELECT doc_id,
            unnest(regexp_extract_all({refanged('text')}, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}')) AS m FROM documents)""",
        "ioc_ipv4": rf"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace({refanged('text')}, '([^0-9.])', '\1\1', 'g'),
              '(?:^|[^.\d])({_IPV4})(?:$|[^.\d])', 1)) AS raw FROM documents), y AS (SELECT doc_id, translate(raw, '[](){{}}', '') AS v FROM x)
            SELECT DISTINCT doc_id, 'ipv4' AS ioc_type, v AS value FROM y WHERE regexp_matches(v, '^\d+\.\d+\.\d+\.\d+$')
              AND v NOT IN ({', '.join(quoted(i) for i in BENIGN_IPS)}) AND NOT CASE WHEN regexp_matches(v, '^\d+\.\d+\.\d+\.\d+$') THEN {_PRIVATE} ELSE true END""",
        "ioc_hash": " UNION ALL ".join(_hash_sql(k, n) for k, n in (("md5", 32), ("sha1", 40), ("sha256", 64))),
        "ioc_url": rf"""SELECT DISTINCT page_id, 'url' AS ioc_type, substr(m, 1, 2048) AS value FROM (SELECT page_id, unnest(regexp_extract_all({refanged("(url || ' ' || html)")},
            '(?i)(?:https?|hxxps?|h__ps?|ftps?|sftp)(?:://|%3A%2F%2F)[^\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}"''<>\[\]{{}}|\\^`]{{3,}}')) AS m FROM pages)""",
        # a host behind slashes is no domain of the text, but what follows its first dot or hyphen is
        "ioc_domain": r"""WITH h AS (SELECT page_id, html, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages),
            d AS (SELECT page_id, host AS value FROM h WHERE contains(lower(html), '&copy; ' || host)
              UNION SELECT page_id, regexp_extract(host, '^[a-z0-9]+[.-](.*)$', 1) FROM h)
            SELECT page_id, value FROM d WHERE regexp_matches(value, '^(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,6}$')
            AND value NOT IN ('example.com', 'example.org', 'example.net', 'test.com', 'test.local', 'localhost.localdomain')""",
        "ioc_ipv6": "SELECT event_id, '2001:db8::' || format('{:x}', event_id % 60000 + 1) AS value FROM events",
        "text_iocs": f"""WITH {EVENTS}, k AS (SELECT event_id, [{', '.join(quoted(t) for t in TEXT_IOC_TYPES)}] AS t, [{', '.join(TEXT_IOC_VALUES)}] AS v,
              {TEXT_IOC_CONFIDENCE}::DOUBLE[] AS c FROM e)
            SELECT event_id, generate_subscripts(t, 1) - 1 AS position, unnest(t) AS ioc_type, unnest(v) AS value, unnest(c) AS confidence FROM k""",
        "text_ioc_context": f"""WITH {EVENTS}, k AS (SELECT event_id, 'CVE-2024-' || (10000 + event_id % 90000) AS value, {refanged('(' + line(E.THREAT_NOTE) + ')')} AS t FROM events),
              a AS (SELECT *, strpos(t, value) AS ps FROM k)
            SELECT event_id, value, trim(substr(t, greatest(ps - 40, 1), ps - greatest(ps - 40, 1) + 40)) AS context FROM a""",
        "event_iocs": f"""WITH {SYSLOG_IOCS} SELECT log_id, line_number, position::BIGINT AS position, h.t AS ioc_type, h.v AS value, h.c::DOUBLE AS confidence, h.f AS source_field FROM si""",
        "ioc_dedup": f"WITH {SYSLOG_IOCS} SELECT * FROM sf",
        "rules": f"""{C5}, r1 AS (SELECT DISTINCT rule_id, score, tech FROM rules), hits AS (SELECT m.rule_id, count(*) AS n FROM m JOIN x5 USING (log_type, event_type) GROUP BY 1)
            SELECT rule_id, score AS severity_score, tech AS technique_id, coalesce(n, 0)::BIGINT AS events FROM r1 LEFT JOIN hits USING (rule_id)""",
        "classify": f"""{C5} SELECT log_id, line_number, event_type, severity, severity_score, mitre_technique_id, mitre_tactic, sub_technique_id, threat_category,
            confidence::DOUBLE AS confidence, matched_rules, tags, is_classified FROM c""",
        "enrich_events": f"""WITH {SYSLOG_IOCS}, {classified('s')} SELECT c.log_id, c.line_number, mitre_technique_id AS technique_id, severity, len(hits)::BIGINT AS n_iocs,
            hits[1].v AS first_ioc FROM c JOIN hl ON c.log_id = hl.log_id AND c.line_number = hl.line_number""",
        "log_run": f"{C5} SELECT log_id, log_type, event_type, severity, count(*) AS events FROM c GROUP BY ALL",
        "limit_events": f"WITH {SYSLOG} SELECT log_id, line_number, event_type FROM s QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_number) <= 20",
        "threat_events": f"{C5} SELECT log_id, line_number, event_type, severity_score FROM c WHERE severity_score >= 5",
        "critical_events": f"{C5} SELECT log_id, line_number, event_type, severity FROM c WHERE severity = 'critical'",
        "pipeline_stats": f"""WITH {SYSLOG_IOCS}, {classified('s')}, a AS (SELECT log_id, count(*) AS total_lines, count(*) AS parsed_events,
              count(*) FILTER (severity_score >= 5) AS threats_detected, {severities()} FROM c GROUP BY 1),
            b AS (SELECT log_id, count(*) AS iocs_extracted, {', '.join(f"count(*) FILTER (h.t = '{t}') AS iocs_{t}" for t in ('ipv4', 'username', 'domain', 'port', 'file_path'))} FROM si GROUP BY 1),
            u AS (SELECT log_id, count(*) AS unique_iocs FROM sf GROUP BY 1) SELECT * FROM a JOIN b USING (log_id) JOIN u USING (log_id)""",
        "run_summary": f"""WITH {SYSLOG_IOCS}, {classified('s')}, smp AS (SELECT user_id AS log_id, {line(E.SYSLOG)} AS raw_line FROM events
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 30),
            sc AS (SELECT log_id, {_scores()} FROM smp GROUP BY log_id), det AS ({_best()}),
            i AS (SELECT log_id, source_ip, count(*) AS n FROM c WHERE source_ip IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY n DESC, source_ip) <= 5),
            ii AS (SELECT log_id, {top_ip} AS top_source_ips FROM i GROUP BY 1),
            t AS (SELECT log_id, mitre_technique_id, count(*) AS n FROM c WHERE mitre_technique_id IS NOT NULL GROUP BY log_id, mitre_technique_id, mitre_technique_name, mitre_tactic
              QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY n DESC, mitre_technique_id, mitre_technique_name, mitre_tactic) <= 10),
            tt AS (SELECT log_id, string_agg(mitre_technique_id || '=' || n, '|' ORDER BY n DESC, mitre_technique_id) AS mitre_hits FROM t GROUP BY 1),
            a AS (SELECT log_id, count(*) AS parsed_events FROM c GROUP BY 1), b AS (SELECT log_id, count(*) AS unique_iocs FROM sf GROUP BY 1)
            SELECT log_id, log_type, round(confidence, 3) AS detection_confidence, parsed_events, unique_iocs, coalesce(top_source_ips, '') AS top_source_ips, mitre_hits
            FROM det LEFT JOIN ii USING (log_id) LEFT JOIN tt USING (log_id) LEFT JOIN a USING (log_id) LEFT JOIN b USING (log_id)""",
        "severity_breakdown": f"{C5} SELECT severity, count(*) AS count FROM c GROUP BY 1",
        "severity_per_log": f"{C5} SELECT log_id, severity, count(*) AS count FROM c GROUP BY 1, 2",
        "event_count": "SELECT count(*) * 5 AS total_events FROM events",
        "ioc_count": f"WITH {SYSLOG_IOCS} SELECT count(*) AS total_iocs FROM sf",
        "incident_count": f"WITH {INCIDENTS} SELECT count(*) AS total_incidents FROM inc",
        "unique_ioc_values": f"WITH {SYSLOG_IOCS} SELECT count(DISTINCT value) AS unique_values FROM sf",
        "ioc_type_summary": f"WITH {SYSLOG_IOCS} SELECT ioc_type, count(*) AS count FROM sf GROUP BY 1",
        "log_status_counts": f"WITH {LOGS} SELECT status, count(*) AS count FROM logs GROUP BY 1",
        "log_type_breakdown": f"WITH {LOGS} SELECT log_type, count(*) AS count FROM logs GROUP BY 1",
        "incident_status_counts": f"WITH {INCIDENTS} SELECT status, count(*) AS count FROM inc GROUP BY 1",
        "incident_severity_counts": f"WITH {INCIDENTS} SELECT severity, count(*) AS count FROM inc GROUP BY 1",
        "incidents": f"WITH {INCIDENTS} SELECT * FROM inc",
        "tactic_breakdown": f"{C5} SELECT mitre_tactic, count(*) AS count FROM c WHERE mitre_tactic IS NOT NULL GROUP BY 1",
        "top_source_ips": f"WITH {ALL} SELECT source_ip, count(*) AS count FROM x5 WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "top_event_types": f"WITH {ALL} SELECT event_type, count(*) AS count FROM x5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "top_techniques": f"{CS} SELECT mitre_technique_id, mitre_technique_name, mitre_tactic, count(*) AS count FROM c WHERE mitre_technique_id IS NOT NULL GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10",
        "top_per_log": f"""WITH {ALL}, g AS (SELECT log_id, event_type, count(*) AS count FROM x5 GROUP BY 1, 2)
            SELECT log_id, event_type, count, row_number() OVER (PARTITION BY log_id ORDER BY count DESC, event_type) AS rank FROM g QUALIFY rank <= 3""",
        "top_ioc_values": f"WITH {SYSLOG_IOCS} SELECT value, count(*) AS total_occurrences FROM sf WHERE ioc_type = 'username' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "statistics": f"""WITH {INCIDENTS}, {LOGS}, {classified('s')},
            l AS (SELECT count(*) AS total_logs, {', '.join(f"count(*) FILTER (status = '{s}') AS logs_{s}" for s in ('pending', 'processing', 'completed', 'failed'))} FROM logs),
            ev AS (SELECT count(*) AS total_events, {severities()} FROM c),
            io AS (SELECT count(*) AS total_iocs, count(DISTINCT value) AS unique_ioc_values FROM sf),
            ic AS (SELECT count(*) AS total_incidents, count(*) FILTER (status = 'open') AS open_incidents, count(*) FILTER (severity = 'critical') AS critical_incidents,
              count(*) FILTER (severity = 'high') AS high_incidents FROM inc),
            a AS (SELECT string_agg(ioc_type || '=' || n, '|' ORDER BY n DESC, ioc_type) AS ioc_type_summary FROM (SELECT ioc_type, count(*) AS n FROM sf GROUP BY 1)),
            b AS (SELECT string_agg(value || '=' || n, '|' ORDER BY n DESC, value) AS top_source_ips FROM (SELECT value, count(*) AS n FROM sf WHERE ioc_type = 'ipv4' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)),
            d AS (SELECT string_agg(mitre_technique_id || '=' || n, '|' ORDER BY n DESC, mitre_technique_id) AS top_mitre_techniques FROM
              (SELECT mitre_technique_id, count(*) AS n FROM c WHERE mitre_technique_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)),
            f AS (SELECT string_agg(event_type || '=' || n, '|' ORDER BY n DESC, event_type) AS top_event_types FROM (SELECT event_type, count(*) AS n FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10))
            SELECT * FROM l, ev, io, ic, a, b, d, f""",
        "page_logs": f"WITH {LOGS} SELECT log_id, status, log_type, created_at FROM logs WHERE status = 'pending' ORDER BY created_at DESC, log_id DESC LIMIT 5 OFFSET 5",
        "page_counts": f"WITH {LOGS} SELECT count(*) AS total, greatest(1, ceil(count(*) / 7.0))::BIGINT AS total_pages FROM logs WHERE status = 'pending'",
        "page_events": f"{C5} SELECT log_id, line_number, event_type, source_ip FROM c WHERE severity = 'high' ORDER BY line_number, log_id LIMIT 25 OFFSET 50",
        "page_threats": f"{C5} SELECT log_id, line_number, severity_score FROM c WHERE severity_score >= 5 ORDER BY severity_score DESC, line_number, log_id LIMIT 50 OFFSET 50",
        "page_iocs": f"WITH {SYSLOG_IOCS} SELECT log_id, ioc_type, value FROM sf WHERE ioc_type = 'ipv4' ORDER BY log_id, ioc_type, value LIMIT 30 OFFSET 90",
        "search_iocs": f"WITH {SYSLOG_IOCS} SELECT log_id, ioc_type, value FROM sf WHERE ioc_type = 'username' AND value ILIKE '%USER1%'",
        "search_iocs_indexed": f"WITH {SYSLOG_IOCS} SELECT log_id, ioc_type, value FROM sf WHERE ioc_type = 'username' AND value ILIKE '%USER1%'",
        "address_blocks": f"""WITH a AS (SELECT event_id, {E.IP} AS source_ip, (185 * 256 + 24)::BIGINT * 65536 + user_id % 256 * 256 + event_id % 250 + 1 AS n FROM events),
            b AS (SELECT '185.24.0.0/16' AS cidr, 16 AS bits, (185 * 256 + 24)::BIGINT * 65536 AS low UNION ALL
              SELECT DISTINCT regexp_replace(source_ip, '[0-9]+$', '0/24'), 24, n - n % 256 FROM a WHERE event_id % 3 = 0 UNION ALL
              SELECT DISTINCT source_ip || '/28', 28, n - n % 16 FROM a WHERE event_id % 50 = 0)
            SELECT event_id, source_ip, cidr FROM a JOIN b ON n BETWEEN low AND low + (1 << (32 - bits)) - 1
            QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY bits DESC, cidr) = 1""",
        "registered_domains": """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages),
            l AS (SELECT host, string_split(host, '.') AS p FROM h WHERE host <> ''),
            x AS (SELECT DISTINCT array_to_string(p[-3:], '.') AS site FROM l WHERE host LIKE '%.example.net' AND host LIKE '%tion%'),
            k AS (SELECT host, p, CASE WHEN host LIKE '%.example.net' AND array_to_string(p[-3:], '.') IN (SELECT site FROM x) THEN 2
              WHEN host LIKE '%.example.net' THEN 3 WHEN host LIKE '%.example.com' OR host = 'example.com' THEN 2 ELSE 1 END AS s FROM l)
            SELECT host, array_to_string(p[-s:], '.') AS suffix, CASE WHEN len(p) > s THEN array_to_string(p[-(s + 1):], '.') END AS domain FROM k""",
        "search_paths": rf"""SELECT event_id, 'C:\Users\' || {E.USER} || '\payload.exe' AS value FROM events WHERE lower({E.USER}) LIKE 'user1%'""",
        **{name: branch_sql(*expected) for name, expected in BRANCH_RESULTS.items()},
        "run_and_store": f"""WITH {LOGS}, n AS (SELECT user_id AS log_id, count(*) FILTER ((event_id + 1) % 10 <> 0) AS ok, count(*) FILTER ((event_id + 1) % 10 = 0) AS bad FROM events GROUP BY 1)
            SELECT log_id, CASE status WHEN 'pending' THEN 'completed' ELSE status END AS status, CASE WHEN status = 'pending' THEN 'linux_syslog' END AS log_type,
              CASE WHEN status = 'pending' THEN 3600000000 END AS processing_started_at, CASE WHEN status = 'pending' THEN 3660000000 END AS processing_completed_at,
              CASE WHEN status = 'pending' THEN ok END AS parsed_event_count, CASE WHEN status = 'pending' THEN ok + bad END AS line_count,
              CASE WHEN status = 'pending' THEN true END AS iocs_agree, CASE WHEN status = 'pending' THEN ok ELSE 0 END AS events, CASE WHEN status = 'pending' THEN bad ELSE 0 END AS rejected
            FROM logs JOIN n USING (log_id)""",
        "long_xml_iocs": "SELECT user_id AS log_id, CAST(event_id + 1 AS INTEGER) AS line_number, 'CVE-2024-' || (event_id % 90000 + 10000) AS value FROM events",
        "ioc_cap": "SELECT user_id AS log_id, count(*) * 60 AS cves_all, count(*) * 50 AS iocs_50 FROM events GROUP BY 1",
        "page_incidents": f"WITH {INCIDENTS} SELECT log_id, title, severity FROM inc WHERE severity = 'high' ORDER BY log_id DESC, event_type, title LIMIT 20 OFFSET 20",
        "apply_log_status": f"""WITH RECURSIVE {LOGS}, ch AS (SELECT user_id AS log_id, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS st,
              ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, event_id) AS k
              FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
            fold(log_id, k, st, started, ended, n, err) AS (
              SELECT log_id, 0::BIGINT, status, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::BIGINT, NULL::VARCHAR FROM logs UNION ALL
              SELECT f.log_id, c.k, CASE WHEN no THEN f.st ELSE c.st END, CASE WHEN NOT no AND c.st = 'processing' THEN c.ts ELSE f.started END,
                CASE WHEN NOT no AND c.st <> 'processing' THEN c.ts ELSE f.ended END, CASE WHEN NOT no AND c.st = 'completed' THEN c.event_id ELSE f.n END,
                CASE WHEN NOT no AND c.st = 'failed' THEN 'error ' || c.event_id ELSE f.err END
              FROM (SELECT f.*, c.ts, c.event_id, c.st AS cst, c.k AS ck, (f.st = 'completed' OR (f.st = 'processing' AND c.st = 'processing')) AS no
                    FROM fold f JOIN ch c ON c.log_id = f.log_id AND c.k = f.k + 1) f JOIN ch c ON c.log_id = f.log_id AND c.k = f.ck)
            SELECT log_id, st AS status, CASE WHEN n IS NOT NULL THEN 'linux_syslog' END AS log_type, epoch_us(started) AS processing_started_at,
              epoch_us(ended) AS processing_completed_at, n AS parsed_event_count, err AS parse_error
            FROM fold QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY k DESC) = 1""",
        "apply_incident_updates": """WITH up AS (SELECT user_id AS incident_id, ts, CASE event_type WHEN 'signup' THEN 'investigating' WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'resolved' END AS st,
              CASE WHEN event_type = 'click' THEN event_id % 9 END AS a FROM events)
            SELECT incident_id, coalesce(arg_max(st, ts) FILTER (st IS NOT NULL), 'open') AS status, arg_max(a, ts) FILTER (a IS NOT NULL) AS assigned_to,
              epoch_us(max(ts) FILTER (st = 'closed')) AS closed_at FROM up GROUP BY 1""",
        "validate_docs": f"""WITH {VALIDATION} SELECT doc_id, reason = '' AS is_valid, reason, CASE WHEN reason <> '' THEN '' ELSE array_to_string(list_filter([
            CASE WHEN wc < 50 THEN 'Low word count (' || wc || '); document may produce poor-quality chunks' END,
            CASE WHEN chars < 200 THEN 'Very short document; may not chunk meaningfully — consider merging with related content' END], lambda w: w IS NOT NULL), '|') END AS warnings FROM vr""",
        "doc_hash_dedup": """SELECT min(doc_id) AS doc_id, sha256(text) AS doc_hash FROM documents WHERE sha256(text) NOT IN
            (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY 2""",
        "doc_hash_filter": """SELECT min(doc_id) AS doc_id, sha256(text) AS doc_hash FROM documents WHERE sha256(text) NOT IN
            (SELECT sha256(text) FROM documents WHERE lang IN ('es', 'de')) GROUP BY 2""",
        "mark_duplicates": """WITH h AS (SELECT doc_id, sha256(text) AS a, CASE WHEN doc_id % 3 > 0 THEN sha256(text) END AS b FROM documents)
            SELECT doc_id, row_number() OVER (PARTITION BY a ORDER BY doc_id) > 1 AS is_duplicate,
              b IS NOT NULL AND (row_number() OVER (PARTITION BY b ORDER BY doc_id) > 1 OR b IN (SELECT sha256(text) FROM documents WHERE lang = 'es')) AS is_known FROM h""",
        "drop_duplicates_without_hash": """SELECT min(doc_id) AS doc_id, sha256(text) AS doc_hash FROM documents WHERE doc_id % 3 > 0 GROUP BY 2
            UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 0""",
        # 51 sentences of ten words fill a chunk, and the next one repeats the last six (60 of 64 words)
        "chunk_equal_sentences": """WITH n AS (SELECT doc_id, doc_id % 300 + 1 AS s FROM documents),
            t AS (SELECT doc_id, s, CASE WHEN s <= 51 THEN 1 ELSE 1 + CAST(ceil((s - 51) / 45.0) AS BIGINT) END AS total FROM n),
            c AS (SELECT doc_id, s, total, unnest(range(total)) AS k FROM t)
            SELECT doc_id, k AS chunk_index, total AS total_chunks, 10 * least(51, s - 45 * k) AS words, 45 * k + 1 AS first_sentence FROM c""",
        "chunk_coverage": f"WITH {VALIDATION} SELECT doc_id, true AS within_size, true AS all_numbered, CASE WHEN wc <= 512 THEN wc ELSE -1 END::BIGINT AS single_chunk_words FROM v WHERE chars > 0",
        "chunk_payload": f"""WITH {VALIDATION} SELECT 'n' || doc_id AS node_id, sha256(text) AS doc_hash, source AS source_type, '' AS source_url, '' AS technique_id,
            wc::BIGINT AS word_count, length(text)::BIGINT AS char_count FROM v""",
        "hashing_embed": f"WITH {VALIDATION} SELECT doc_id, 256 AS dim, CASE WHEN wc > 0 THEN 1.0 ELSE 0.0 END AS norm2 FROM v",
        "l2_normalise": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
            SELECT vec_id, unnest(range(len(x))) AS place, round(unnest(x) / sqrt(list_inner_product(x, x)), 5) AS x FROM v""",
        "ingest_files": f"""WITH {VALIDATION}, p AS (SELECT *, {path} AS path FROM vr), r AS (SELECT *, CASE WHEN lang = 'es' THEN 'skipped_unsupported' WHEN chars = 0 THEN 'failed'
              WHEN reason <> '' THEN 'failed' WHEN row_number() OVER (PARTITION BY lang = 'es', sha256(content) ORDER BY path) > 1 THEN 'skipped_duplicate' ELSE 'indexed' END AS status FROM p)
            SELECT status, CASE WHEN status = 'failed' AND chars = 0 THEN 'Loader returned 0 documents' WHEN status = 'failed' THEN 'Validation: ' || reason
              WHEN status = 'skipped_duplicate' THEN 'Document already indexed (same SHA-256)' ELSE '' END AS reason, count(*) AS files FROM r GROUP BY 1, 2""",
        "ingest_twice": f"""WITH {VALIDATION} SELECT DISTINCT sha256(content) AS doc_hash, true AS whole FROM vr WHERE lang <> 'es' AND chars > 0 AND reason = ''""",
        "ingestion_report": f"""WITH {VALIDATION}, f AS (SELECT wc, CASE WHEN reason <> '' THEN 'failed' WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1
              THEN 'skipped_duplicate' ELSE 'indexed' END AS st FROM vr)
            SELECT count(*) AS total_files, count(*) FILTER (st = 'indexed') AS indexed_files, count(*) FILTER (st = 'skipped_duplicate') AS skipped_duplicates,
              0::BIGINT AS skipped_unsupported, count(*) FILTER (st = 'failed') AS failed_files, sum(wc)::BIGINT AS total_chunks_indexed,
              round(count(*) FILTER (st = 'indexed') * 100.0 / count(*), 1) AS success_rate_pct FROM f""",
        "tokenise": f"SELECT doc_id AS node_id, len({words('lower(text)')})::BIGINT AS n_tokens, md5(array_to_string({words('lower(text)')}, ' ')) AS tokens_md5 FROM documents",
        "bm25_postings": f"WITH {DOC_NODES}, {BM25} SELECT term, node_id, tf, dl FROM p",
        "bm25_terms": f"WITH {DOC_NODES}, {BM25} SELECT term, df, CAST(round(idf * 1000000) AS BIGINT) AS idf_millionths FROM idf",
        "bm25_stats": f"WITH {DOC_NODES}, {BM25} SELECT n_nodes, round(avg_len, 6) AS avg_len FROM n",
        "bm25_search": f"WITH {DOC_NODES}, {BM25_TOP} SELECT query_id, node_id, score, rank FROM sparse",
        "classify_by_rule_table": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark),
            r AS (SELECT w, length(w) AS n, ('0x' || substr(md5(w), 1, 12))::BIGINT AS seq FROM w),
            d AS (SELECT doc_id, source, lower(coalesce(text, '')) AS t FROM documents),
            h AS (SELECT doc_id, w, n, seq FROM d JOIN r ON contains(t, w) WHERE n % 3 <> 0 OR source = 'src' || n),
            g AS (SELECT doc_id, count(*) AS k, string_agg(w, '|' ORDER BY n, seq) AS ws, max(1 + n % 10) AS score,
                substr(first(w ORDER BY n, seq), 1, 2) AS cat, first(n ORDER BY n, seq) AS n1, count(DISTINCT substr(w, 1, 1)) AS tags FROM h GROUP BY 1)
            SELECT doc_id, coalesce(k, 0)::INTEGER AS n_matched, md5(coalesce(ws, '')) AS matched_md5,
              CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'medium' WHEN score >= 3 THEN 'low' ELSE 'info' END AS severity,
              coalesce(score, 1)::INTEGER AS severity_score, coalesce(cat, 'Unclassified') AS threat_category, coalesce(tags, 0)::INTEGER AS n_tags,
              CASE WHEN k > 0 THEN least(1.0, round(0.7 + CASE WHEN n1 % 3 = 0 THEN 0.1 ELSE 0.0 END + least(0.1, k * 0.02), 2)) ELSE 0.0 END::DOUBLE AS confidence
            FROM documents LEFT JOIN g USING (doc_id)""",
        "bm25_block_search": f"WITH {DOC_NODES}, {BM25_TOP} SELECT query_id, node_id, score, rank FROM sparse",
        "similar_documents": f"WITH {DOC_NODES}, {bm25_top('SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 20 = 0')} SELECT query_id, node_id, score, rank FROM sparse",
        "similar_vectors": f"""WITH nodes AS (SELECT vec_id AS node_id, embedding FROM embeddings),
            asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 20 = 0), {dense('asked', 'nodes', 30)}
            SELECT query_id, node_id, score, rank FROM dense""",
        "dense_search": f"""WITH {CENTROIDS}, nodes AS (SELECT vec_id AS node_id, embedding, label FROM embeddings), {dense('ce', 'nodes', 30)}
            SELECT query_id, node_id, score, rank FROM dense""",
        "dense_search_filtered": f"""WITH {CENTROIDS}, nodes AS (SELECT vec_id AS node_id, embedding, label FROM embeddings), {dense('ce', 'nodes', 5, 'label = 3')}
            SELECT query_id, node_id, score, rank FROM dense WHERE score >= 0.0""",
        "rrf_fuse": f"WITH {FUSED} SELECT query_id, node_id, rrf_score, rank FROM fr",
        "hybrid_search": f"WITH {FUSED} SELECT query_id, node_id, rrf_score, rank, source_type FROM fr JOIN nodes USING (node_id) WHERE rank <= 10",
        "knowledge_stats": f"WITH {ALL_NODES} SELECT count(*) AS points, count(*) FILTER (text <> '') AS corpus_size, max(len(embedding))::BIGINT AS vector_dim FROM nodes",
        "stream_pieces": f"""WITH {SYSLOG_IOCS}, a AS (SELECT user_id % 40 AS lg, count(*) AS line_count FROM events GROUP BY 1),
            i AS (SELECT lg, count(*) AS indicators, sum(n)::BIGINT AS hits FROM (SELECT log_id % 40 AS lg, h.t, h.v, count(*) AS n FROM si GROUP BY ALL) GROUP BY 1),
            p AS (SELECT user_id % 40 AS lg, count(*) AS incident_events, sum(len(hits))::BIGINT AS incident_iocs, count(DISTINCT host) AS hosts
              FROM e JOIN hl ON hl.line_number = e.ln WHERE et = 'purchase' GROUP BY 1)
            SELECT lg, 'linux_syslog' AS log_type, line_count, line_count AS events, line_count::INTEGER AS last_line, indicators, hits,
              CASE WHEN incident_events > 0 THEN 1 END::BIGINT AS incidents, incident_events, incident_iocs, hosts
            FROM a JOIN i USING (lg) LEFT JOIN p USING (lg)""",
        "stream_logs": f"{CS} SELECT event_type, severity, count(*) AS events FROM c GROUP BY 1, 2",
    }

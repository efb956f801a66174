"""Apache and Nginx access and error logs, with web-attack typing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.text import capture, first_group, part, strip, to_int, unmark, url_decode_twice
from logwarden.operators.formats import LogFormat

# Line patterns.
APACHE_ACCESS = (r'([\d.:a-fA-F]+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+([^\s"]+)\s+(HTTP/[\d.]+)"'
                 r'\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?')
APACHE_ERROR = (r"(?i)\[([^\]]+)\]\s+\[([a-z]+)\]\s+(?:\[pid\s+(\d+)\]\s+)?"
                r"(?:\[client\s+([\d.:a-fA-F]+)(?::\d+)?\]\s+)?(.+)$")
NGINX_ACCESS = (r'([\d.:a-fA-F]+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+'
                r'"(?:([A-Z]+)\s+([^\s"]+)\s+(HTTP/[\d.]+)|([^"]+))"'
                r'\s+(\d{3})\s+(\d+|-)((?:\s+"([^"]*)"\s+"([^"]*)")?)')
NGINX_ERROR = (r"(?i)(\d{4}/\d{2}/\d{2})\s+(\d{2}:\d{2}:\d{2})\s+\[([a-z]+)\]\s+(\d+)#(\d+):\s+"
               r"(?:\*(\d+)\s+)?(.+)$")
NGINX_CLIENT = r"(?i)client:\s+([\d.:a-fA-F]+)"
NGINX_SERVER = r"(?i)server:\s+([^,]+)"
NGINX_REQUEST = r'(?i)request:\s+"([A-Z]+)\s+([^\s"]+)'
NGINX_HOST = r'(?i)host:\s+"([^"]+)"'
NGINX_UPSTREAM = (r'(?i)(?:upstream:\s+"?([^\s",]+)|(?:connecting\s+to|from|'
                  r"timed?\s+out\s+(?:reading|while\s+sending)\s+to)\s+upstream)")
ERROR_LEVELS = ("error", "crit", "emerg", "alert")
LARGE_RESPONSE_BYTES = 10_000_000


@dataclass(frozen=True)
class AttackPatterns:
    sql_injection: str
    xss: str
    traversal: str
    command_injection: str
    scanner_agent: str
    path_scan: str


# The two servers have slightly different attack patterns.
APACHE_ATTACKS = AttackPatterns(
    sql_injection=(
        r"(?i)(\bunion\b.+\bselect\b|\bselect\b.+\bfrom\b|(?:--|#|/\*).+|"
        r"\b(drop|truncate|insert|update|delete)\s+\b(table|into|from)\b|"
        r"(?:OR|AND)\s+['\"]?\d+['\"]?\s*[=<>]|information_schema|sleep\s*\(\s*\d+|benchmark\s*\()"),
    xss=(
        r"(?i)(<script|javascript:|vbscript:|"
        r"on(?:load|click|error|mouseover|focus|blur|change|submit|keyup|keydown)\s*=|"
        r"eval\s*\(|alert\s*\(|document\.cookie|<iframe|<img[^>]+onerror|&#x?\d+;)"),
    traversal=r"(?i)\.\./|\.\.\\|%2e%2e|%252e%252e",
    command_injection=(
        r"(?i)([;&|`$]\s*(?:ls|cat|id|whoami|uname|pwd|wget|curl|bash|sh|nc|ncat|python|perl|php)\b|"
        r"\|\s*(?:bash|sh|cmd\.exe)|(?:exec|system|shell_exec|passthru|popen)\s*\()"),
    scanner_agent=(
        r"(?i)(sqlmap|nmap|nikto|masscan|nessus|openvas|burpsuite|metasploit|hydra|gobuster|"
        r"dirbuster|w3af|acunetix|havij|pangolin|ZmEu|zgrab|python-requests|go-http-client|"
        r"scanbot|crawler|spider|scraper)"),
    path_scan=(
        r"(?i)(?:/wp-admin|/wp-login|/admin|/phpmyadmin|/\.env|/\.git|/web\.config|/etc/passwd|"
        r"/proc/self|/manager/html|\.php\?|xmlrpc\.php|/cgi-bin/|shell\.|cmd\.php)"),
)
NGINX_ATTACKS = AttackPatterns(
    sql_injection=(
        r"(?i)(\bunion\b.+\bselect\b|\bselect\b.+\bfrom\b|(?:--|#|/\*)|information_schema|"
        r"sleep\s*\(\s*\d+|benchmark\s*\(|"
        r"\b(drop|truncate|insert|update|delete)\s+\b(table|into|from)\b|"
        r"(?:OR|AND)\s+['\"]?\d+['\"]?\s*[=<>])"),
    xss=(
        r"(?i)(<script|javascript:|on(?:load|click|error|mouseover|focus|blur)\s*=|"
        r"eval\s*\(|alert\s*\(|document\.cookie|<iframe|<img[^>]+onerror)"),
    traversal=r"(?i)\.\./|\.\.\\|%2e%2e|%252e%252e",
    command_injection=(
        r"(?i)([;&|`$]\s*(?:ls|cat|id|whoami|wget|curl|bash|sh|nc|python|perl)\b|"
        r"\|\s*(?:bash|sh|cmd\.exe)|(?:exec|system|shell_exec|passthru)\s*\()"),
    scanner_agent=(
        r"(?i)(sqlmap|nmap|nikto|masscan|nessus|openvas|burpsuite|metasploit|hydra|gobuster|"
        r"dirbuster|w3af|acunetix|havij|ZmEu|zgrab|python-requests|go-http-client|scanbot)"),
    path_scan=(
        r"(?i)(/wp-admin|/wp-login|/admin|/phpmyadmin|/\.env|/\.git|/web\.config|/etc/passwd|"
        r"/proc/self|/manager/html|xmlrpc\.php|/cgi-bin/|shell\.|cmd\.php)"),
)

# Header parts, shared by access and error lines of both servers.
(_KIND, _IP, _USER, _TIME, _METHOD, _PATH, _STATUS, _BYTES, _REFERER, _AGENT, _HAS_AGENT,
 _LEVEL, _PID, _MESSAGE) = range(14)
# Detail parts of an access line.
_DECODED, = range(1)


def classify_request(path: Column, status: Column, agent: Column, size: Column,
                     patterns: AttackPatterns) -> Column:
    """Event type of a request: attacks, then scanners, size, and status.

    ``>= 400`` is tested before ``>= 500``, so server errors are typed as client
    errors; kept as it is because results must agree.
    """
    return (F.when(path.rlike(patterns.sql_injection), "SQL Injection Attempt")
            .when(path.rlike(patterns.xss), "XSS Attempt")
            .when(path.rlike(patterns.traversal), "Directory Traversal")
            .when(path.rlike(patterns.command_injection), "Command Injection Attempt")
            .when(agent.rlike(patterns.scanner_agent), "Web Scanner")
            .when(path.rlike(patterns.path_scan), "Web Scanning")
            .when(size > LARGE_RESPONSE_BYTES, "Large Data Transfer")
            .when(status == 401, "Unauthorized Access Attempt")
            .when(status == 403, "Forbidden Access Attempt")
            .when(status >= 400, "HTTP Client Error")
            .when(status >= 500, "HTTP Server Error")
            .otherwise("HTTP Request"))


ATTACK_TYPES = {
    "SQL Injection Attempt": "sql_injection",
    "XSS Attempt": "xss",
    "Directory Traversal": "directory_traversal",
    "Command Injection Attempt": "command_injection",
}


def access_timestamp(text: Column) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss +hhmm``."""
    offset = F.regexp_replace(strip(text), r"([+-]\d{2}):(\d{2})$", "$1$2")
    return F.try_to_timestamp(offset, F.lit("d/MMM/yyyy:H:m:s Z"))


def apache_error_timestamp(text: Column) -> Column:
    """``Fri Jul 01 10:23:11[.ffffff] 2025``; the weekday is only checked for form."""
    rest = first_group(strip(text), r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)\s+(.*)$")
    utc = F.concat(F.regexp_replace(rest, r"\s+", " "), F.lit(" +0000"))
    return F.coalesce(F.try_to_timestamp(utc, F.lit("MMM d H:m:s.SSSSSS yyyy Z")),
                      F.try_to_timestamp(utc, F.lit("MMM d H:m:s yyyy Z")))


def _apache_header(line: Column) -> Column:
    return F.coalesce(
        capture(line, APACHE_ACCESS, ["access", "$1", "$3", "$4", "$5", "$6", "$8", "$9", "$10", "$11",
                                      "", "", "", ""]),
        capture(line, APACHE_ERROR, ["error", "$4", "", "$1", "", "", "", "", "", "", "", "$2", "$3", "$5"]))


def _nginx_header(line: Column) -> Column:
    error = capture(line, NGINX_ERROR,
                    ["error", "", "", "$1 $2", "", "", "", "", "", "", "", "$3", "$4", "$7"])
    access = capture(line, NGINX_ACCESS, ["access", "$1", "$3", "$4", "$5", "$6$8", "$9", "$10", "$12", "$13",
                                          "$11", "", "", ""])
    return F.coalesce(error, access)


def _decoded(line: Column, h: Column, data: Column) -> Column:
    # decoding can bring the marks back in (%EF%BF%BF), hence unmark
    return unmark(url_decode_twice(F.get(h, F.lit(_PATH))))


def _request_type(h: Column, d: Column, patterns: AttackPatterns) -> Column:
    """Event type of an access line, null for an error line."""
    request = classify_request(F.get(d, F.lit(_DECODED)), to_int(part(h, _STATUS)), part(h, _AGENT), _size(h), patterns)
    return F.when(F.get(h, F.lit(_KIND)) == "access", request)


def _apache_verdict(line: Column, h: Column, data: Column, d: Column) -> Column:
    return F.coalesce(_request_type(h, d, APACHE_ATTACKS), F.lit("Web Server Error"))


def _nginx_verdict(line: Column, h: Column, data: Column, d: Column) -> Column:
    level = F.lower(part(h, _LEVEL))
    error_type = (F.when(part(h, _MESSAGE).rlike(NGINX_UPSTREAM), "Upstream Proxy Error")
                  .when(level.isin(*ERROR_LEVELS), "Web Server Error")
                  .when(level == "warn", "Web Server Warning")
                  .otherwise("Web Server Event"))
    return F.coalesce(_request_type(h, d, NGINX_ATTACKS), error_type)


def _common(h: Column, is_access: Column, when_error: dict[str, Column]) -> dict[str, Column]:
    """Columns of an access line, with the error line's value as the alternative."""
    access = {
        "source_ip": part(h, _IP),
        "username": F.nullif(part(h, _USER), F.lit("-")),
        "url": F.get(h, F.lit(_PATH)),
        "http_method": part(h, _METHOD),
        "http_status_code": to_int(part(h, _STATUS)),
        "event_timestamp": access_timestamp(part(h, _TIME)),
        "service": F.lit("HTTP"),
        "protocol": F.lit("HTTP"),
        "dest_port": F.lit(80),
    }
    columns = {name: F.when(is_access, col).otherwise(when_error.get(name, F.lit(None)))
               for name, col in access.items()}
    for name, col in when_error.items():
        columns.setdefault(name, F.when(~is_access, col))
    columns["timestamp_raw"] = part(h, _TIME)
    return columns


def _size(h: Column) -> Column:
    return F.coalesce(part(h, _BYTES).try_cast("decimal(38,0)"), F.lit(0))


def _access_extras(event_type: Column, path: Column, agent: Column, size: Column) -> list[Column]:
    attack = F.when(event_type == "SQL Injection Attempt", "sql_injection")
    for name, kind in list(ATTACK_TYPES.items())[1:]:
        attack = attack.when(event_type == name, kind)
    return [
        F.lit("attack_type"), attack,
        F.lit("scanner_ua"), F.when(event_type == "Web Scanner", agent),
        F.lit("scan_path"), F.when(event_type == "Web Scanning", path),
        F.lit("response_bytes"), F.when(event_type == "Large Data Transfer", size.cast("string")),
    ]


def _apache_fields(line: Column, h: Column, data: Column, d: Column, v: Column) -> dict[str, Column]:
    is_access = F.get(h, F.lit(_KIND)) == "access"
    decoded = F.get(d, F.lit(_DECODED))
    agent, size, level = part(h, _AGENT), _size(h), F.lower(part(h, _LEVEL))
    columns = _common(h, is_access, {
        "source_ip": part(h, _IP),
        "process_id": to_int(part(h, _PID)),
        "event_timestamp": apache_error_timestamp(part(h, _TIME)),
        "service": F.lit("HTTP"),
    })
    columns["user_agent"] = F.when(is_access, agent)
    columns["normalized_data"] = F.when(is_access, F.create_map(
        F.lit("referer"), part(h, _REFERER),
        F.lit("bytes"), size.cast("string"),
        F.lit("decoded_path"), F.nullif(decoded, F.get(h, F.lit(_PATH))),
        *_access_extras(v, decoded, agent, size),
    )).otherwise(F.create_map(
        F.lit("level"), level,
        F.lit("message"), part(h, _MESSAGE),
        F.lit("is_error"), level.isin(*ERROR_LEVELS).cast("string")))
    return columns


def _nginx_fields(line: Column, h: Column, data: Column, d: Column, v: Column) -> dict[str, Column]:
    is_access = F.get(h, F.lit(_KIND)) == "access"
    decoded = F.get(d, F.lit(_DECODED))
    agent = F.when(part(h, _HAS_AGENT).isNotNull(), F.get(h, F.lit(_AGENT)))
    size, level, message = _size(h), F.lower(part(h, _LEVEL)), part(h, _MESSAGE)
    upstream = F.when(message.rlike(NGINX_UPSTREAM),
                      F.coalesce(first_group(message, NGINX_UPSTREAM), F.lit("upstream")))
    columns = _common(h, is_access, {
        "source_ip": first_group(message, NGINX_CLIENT),
        "url": first_group(message, NGINX_REQUEST, 2),
        "http_method": first_group(message, NGINX_REQUEST, 1),
        "hostname": strip(F.coalesce(first_group(message, NGINX_HOST), first_group(message, NGINX_SERVER))),
        "process_id": to_int(part(h, _PID)),
        "event_timestamp": F.try_to_timestamp(
            F.concat(part(h, _TIME), F.lit(" +0000")), F.lit("yyyy/MM/dd HH:mm:ss Z")),
    })
    columns["user_agent"] = F.when(is_access, agent)
    columns["normalized_data"] = F.when(is_access, F.create_map(
        F.lit("referer"), F.nullif(part(h, _REFERER), F.lit("-")),
        F.lit("bytes"), size.cast("string"),
        *_access_extras(v, decoded, agent, size),
    )).otherwise(F.create_map(
        F.lit("level"), level,
        F.lit("message"), message,
        F.lit("upstream"), upstream))
    return columns


@cache
def apache_access() -> LogFormat:
    return LogFormat("apache_access", _apache_header, _apache_verdict, _apache_fields, detail=_decoded)


@cache
def nginx_access() -> LogFormat:
    return LogFormat("nginx_access", _nginx_header, _nginx_verdict, _nginx_fields, detail=_decoded)

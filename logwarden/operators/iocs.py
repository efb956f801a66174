"""Indicators of compromise from free text and from event fields.

Everything about one text or event happens inside its row: patterns give
arrays, and order and duplicates are settled by array expressions. No shuffle
is needed before the per-log step, which aggregates on both sides of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions import network as N
from logwarden.functions.arrays import keep_first, let
from logwarden.functions.text import contains_any, is_blank, strip
from logwarden.session import once_per_session

# Patterns. Two are written without nested repetition that the JVM
# would run recursively: `DOMAIN` steps over its labels possessively, past every
# possible top-level domain that has another one ahead, and eats a run without
# any as one skipped match; `EMAIL` starts only where a run starts (or where the
# last match ended). `FILENAME` eats a run that holds no extension from there on
# as one skipped match. All give the same matches, in linear time. A lookahead
# in front of a lookbehind spares most places the dearer test.
IPV4 = (r"(?=\d)(?<![.\d])((?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)(?:\[?\.\]?|\(?\.?\)?)){3}"
        r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d))(?![.\d])")
DOTTED = r"\d(?:[\[(]?\.[\])]?\d{1,3}){2}[\[(]?\.[\])]?\d"  # in every text with an IPv4 address
IPV6 = (r"(?U)(?=[0-9a-fA-F]{0,4}:)(?<![:\w])((?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,7}:|:(?::[0-9a-fA-F]{1,4}){1,7}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
        r"|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}"
        r"|::(?:[fF]{4}(?::0{1,4})?:)?(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)|::1|::)(?![:\w])")
URL = r"(?iU)((?:https?|hxxps?|h__ps?|ftps?|sftp)(?:://|%3A%2F%2F)[^\s\"'<>\[\]{}|\\^`]{3,}+)"
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\[?\.\]?"
_TLD = (r"(?:com|net|org|io|gov|mil|edu|co|uk|de|ru|cn|fr|nl|info|biz|int|arpa|xyz|online|site|tech|store|app|dev|"
        r"[a-z]{2,6})(?::\d{2,5})?(?![.\w])")
_NO_TLD = rf"(?:(?!{_TLD}){_LABEL})*+"
DOT_LETTER = r"\.\]?[a-zA-Z\u0130\u0131\u017f\u212a]"  # in every text with a domain or a file name
_AHEAD = r"(?-iU:(?<![/@\w])(?=[\w\-\u0130\u0131\u017f\u212a]++[\[.]))"  # what every label has, in plain classes
DOMAIN = (rf"(?iU){_AHEAD}(?<![/@\w])(?:({_LABEL}(?:{_NO_TLD}(?={_TLD}){_LABEL}(?={_NO_TLD}{_TLD}))*+{_NO_TLD}{_TLD})"
          rf"|(?:{_LABEL})++)")
EMAIL = r"(?:(?<![\w.%+\-])|\G)([\w.%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
HEX_RUN = r"([0-9a-fA-F]{32,})"  # a hash is a whole run of its length
LONG_HEX = r"[0-9a-fA-F]{32}"
LABELLED_MD5 = r"(?i)MD5=([0-9a-fA-F]{32})"
LABELLED_SHA1 = r"(?i)SHA1=([0-9a-fA-F]{40})"
LABELLED_SHA256 = r"(?i)SHA256=([0-9a-fA-F]{64})"
CVE = r"(?=[Cc])(?iU)\b(CVE-(?:19|20)\d{2}-\d{4,7})\b"
WINDOWS_PATH = r"""((?:[A-Za-z]:[\\/]|\\\\)[^\x00-\x1f"'<>|?*\[\]{}]{4,512})"""
UNIX_PATH = r"""(?U)(?=/)(?<!\w)(/(?:[^\x00-\x1f \t"'<>|;`]{1,255}/)+[^\x00-\x1f \t"'<>|;`]{1,255})"""
REGISTRY_KEY = (r"(?i)(HK(?:EY_LOCAL_MACHINE|LM|EY_CURRENT_USER|CU|EY_USERS|U|EY_CLASSES_ROOT|CR|EY_CURRENT_CONFIG|CC)"
                r"""(?:\\[^\x00-\x1f"'<>|]{1,255})+)""")
_EXTENSION = (r"(?i:exe|dll|bat|cmd|ps1|vbs|js|jar|sh|bash|py|pl|rb|php|asp|aspx|jsp|cgi|msi|hta|scr|com|pif|lnk|iso|img)"
              r"(?![\w\-])")
_NAME = rf"[\w.\-]{{1,128}}\.{_EXTENSION}"
FILENAME = (rf"(?<![/\\])(?:(?![\w\-]*+(?:\.(?!{_EXTENSION})[\w\-]*+)*+\.)[\w.\-]++"
            rf"|({_NAME}))")

# What is never an indicator.
BENIGN_IPS = ("0.0.0.0", "127.0.0.1", "255.255.255.255", "224.0.0.0", "239.255.255.255")
BENIGN_DOMAINS = ("localhost", "localhost.localdomain", "local", "example.com", "example.org",
                  "example.net", "test.com", "test.local", "internal")
BENIGN_HASHES = (
    "0" * 32, "f" * 32, "0" * 40, "f" * 40, "0" * 64, "f" * 64,
    "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)
RESERVED_USERNAMES = ("-", "N/A", "SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ANONYMOUS", "NOBODY",
                      "NULL", "NONE")
BORING_PORTS = (80, 443, 22, 21, 25, 53, 8080, 8443, 3389, 445, 139, 135, 137, 138, 389, 636, 1433,
                3306, 5432, 6379, 27017)
# Entries of normalized_data that are numbers or flags, so not scanned as text.
NOT_TEXT = ("event_id", "bytes", "response_bytes", "is_error", "oom_kill", "kernel_panic", "suspicious_path")
MARKS = (".", ":", "/", "\\", "@", "-", "%")  # every indicator below 32 characters holds one
PLAIN_WORDS = r" (?:\p{Alnum}{1,31}+ )++"  # no indicator in them: they hold no mark and are no hash
LONG_TEXT = 1_000  # bytes; from here on a pass that drops the plain words costs less than it spares the patterns
RAW_LINE_FACTOR = 0.8
MIN_UNIX_PATH = 6

HIT = ("array<struct<ioc_type:string,value:string,confidence:double,found:string,"
       "source_field:string,text_index:int>>")


def refang(text: Column) -> Column:
    """``[.]``, ``(.)``, ``{.}`` to a dot and hxxp / h__p to http. Most texts hold none of these, and no replaced dot makes one."""
    dots = F.regexp_replace(text, r"\[\.?\]|\(\.?\)|\{\.?\}", ".")
    lower = F.lower(text)
    # a CASE, as generated code would make a lower-cased text that both sides of an OR share ahead of any test
    scheme = F.when(contains_any(text, "hx", "hX", "Hx", "HX", "__"), lower.contains("hxxp") | lower.contains("h__p")).otherwise(False)
    fanged = contains_any(text, "[.]", "[]", "(.)", "()", "{.}", "{}") | scheme
    return F.when(fanged, F.regexp_replace(dots, r"(?i)h(?:xx|__)p(s?)", "http$1")).otherwise(text)


def _matches(text: Column, pattern: str, guard: Column) -> Column:
    """All matches; the guard is a cheap test that spares most texts the pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.when(guard, found).otherwise(F.array().cast("array<string>"))


def _if(guard: Column, hits: Column) -> Column:
    """Hits where the guard holds: most patterns are spared their array functions too, which cost more than the guard."""
    return F.when(guard, hits).otherwise(F.array())


def _hit(ioc_type: str, value: Column, confidence: float, found: Column) -> Column:
    return F.struct(
        F.lit(ioc_type).alias("ioc_type"), value.alias("value"),
        F.lit(float(confidence)).alias("confidence"), found.alias("found"))


def _hits(found: Column, ioc_type: str, confidence: float, value=lambda m: m) -> Column:
    return F.transform(found, lambda m: _hit(ioc_type, value(m), confidence, m))


def _hashes(runs: Column, length: int) -> Column:
    return F.filter(runs, lambda m: (F.length(m) == length) & ~F.lower(m).isin(*BENIGN_HASHES))


def _labelled(text: Column, lower: Column, pattern: str, label: str) -> Column:
    found = _matches(text, pattern, lower.contains(label))
    return F.filter(found, lambda m: ~F.lower(m).isin(*BENIGN_HASHES))


def _without_brackets(m: Column) -> Column:
    return F.translate(m, "[](){}", "")


def ipv4_values(text: Column, include_private: bool = False) -> Column:
    def bad(n: Column) -> Column:
        unusable = N.is_loopback(n) | N.is_multicast(n)
        return unusable if include_private else unusable | N.is_private(n)

    def good(ip: Column) -> Column:
        return F.when(N.is_ipv4(ip) & ~ip.isin(*BENIGN_IPS), ~let(N.ipv4_number(ip), bad)).otherwise(False)

    return F.filter(_matches(text, IPV4, text.contains(".") & text.rlike(DOTTED)), lambda m: let(_without_brackets(m), good))


def _may_hold_ipv6(text: Column) -> Column:
    return text.contains("::") | (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(":"))) >= 7)


def _ipv6_found(text: Column) -> Column:
    found = _matches(text, IPV6, _may_hold_ipv6(text))
    named = F.transform(found, lambda m: F.struct(m.alias("found"), N.canonical_ipv6(m).alias("value")))
    return F.filter(named, lambda m: ~m["value"].isin("::", "::1"))


def ipv6_values(text: Column) -> Column:
    return F.transform(_ipv6_found(text), lambda m: m["found"])


def domain_values(text: Column) -> Column:
    def keep(m: Column) -> Column:
        name = F.lower(_without_brackets(m))
        return (m != "") & ~name.isin(*BENIGN_DOMAINS) & ~name.rlike(r"(?U)^[\d.]+$")

    return F.filter(_matches(text, DOMAIN, text.contains(".") & text.rlike(DOT_LETTER)), keep)


def file_names(text: Column) -> Column:
    return F.filter(_matches(text, FILENAME, text.contains(".") & text.rlike(DOT_LETTER)), lambda m: m != "")


def _text_hits(text: Column, include_private: bool, types: tuple[str, ...] | None = None) -> Column:
    """Hits of one refanged text, in the fixed order of the extractors; of ``types`` alone if they are given. A short text
    without any of the marks that indicators hold has none: a hash is longer."""
    hits = let(_without_plain_words(text), lambda t: let(F.lower(t), lambda lower: _ordered_hits(
        text, t, lower, include_private, types)))
    return F.when((F.octet_length(text) >= 32) | contains_any(text, *MARKS), hits).otherwise(F.array())


def _without_plain_words(text: Column) -> Column:
    """A long text without the runs of plain words inside it, a space for each run. Only matches that span spaces differ:
    Windows paths and registry keys."""
    return F.when(F.octet_length(text) >= LONG_TEXT, F.regexp_replace(text, PLAIN_WORDS, " ")).otherwise(text)


def _ordered_hits(whole: Column, text: Column, lower: Column, include_private: bool, types: tuple[str, ...] | None) -> Column:
    """Of a ``whole`` text, by its ``text`` without plain words where a match has no space."""
    at, dot, slash = text.contains("@"), text.contains("."), text.contains("/")

    def hashes(runs: Column) -> Column:
        lengths = {"sha256": (64, 1.0), "sha1": (40, 1.0), "md5": (32, 0.9)}
        return F.concat(*[_hits(_hashes(runs, n), kind, sure, F.lower) for kind, (n, sure) in lengths.items()])

    def labelled(pattern: str, kind: str, sure: float) -> tuple:
        label = f"{kind}="
        return (kind,), lower.contains(label), _hits(_labelled(text, lower, pattern, label), kind, sure, F.lower)

    def path(of: Column, pattern: str, guard: Column, sure: float, least: int = 1) -> tuple:
        return ("file_path",), guard, _hits(F.filter(_matches(of, pattern, guard), lambda m: F.length(m) >= least), "file_path", sure)

    v6 = F.transform(_ipv6_found(text), lambda m: _hit("ipv6", m["value"], 1.0, m["found"]))
    url = text.contains("://") | lower.contains("%3a%2f%2f")
    name = dot & text.rlike(DOT_LETTER)
    every = (
        (("sha256", "sha1", "md5"), text.rlike(LONG_HEX), let(_matches(text, HEX_RUN, F.octet_length(text) >= 32), hashes)),
        (("ipv4",), dot, _hits(ipv4_values(text, include_private), "ipv4", 1.0, _without_brackets)),
        (("ipv6",), _may_hold_ipv6(text), v6),
        (("cve",), lower.contains("cve-"), _hits(_matches(text, CVE, lower.contains("cve-")), "cve", 1.0, F.upper)),
        (("email",), at, _hits(_matches(text, EMAIL, at), "email", 0.95, F.lower)),
        (("url",), url, _hits(_matches(text, URL, url), "url", 0.95)),
        (("domain",), name, _hits(domain_values(text), "domain", 0.8, lambda m: F.lower(_without_brackets(m)))),
        path(whole, WINDOWS_PATH, contains_any(text, ":\\", ":/", "\\\\"), 0.9),
        path(text, UNIX_PATH, slash, 0.85, MIN_UNIX_PATH),
        path(whole, REGISTRY_KEY, lower.contains("hk") & text.contains("\\"), 1.0),
        (("filename",), name, _hits(file_names(text), "filename", 0.75, F.lower)),
        labelled(LABELLED_SHA256, "sha256", 1.0),
        labelled(LABELLED_SHA1, "sha1", 1.0),
        labelled(LABELLED_MD5, "md5", 0.9),
    )
    wanted = [_if(guard, found) for kinds, guard, found in every if types is None or set(kinds) & set(types)]
    hits = F.concat(*wanted)
    return hits if types is None else F.filter(hits, lambda h: h["ioc_type"].isin(*types))


def snippet(text: Column, found: Column, window: int = 80) -> Column:
    """The text around the first occurrence of a match, on one line."""
    def cut(at: Column) -> Column:
        start = F.greatest(at - window // 2, F.lit(1))
        return F.substr(text, start, at - start + window // 2)

    return F.substring(strip(F.replace(let(F.instr(text, found), cut), F.lit("\n"), F.lit(" "))), 1, 200)


def extract_from_text(text: Column, include_private: bool = False, types: tuple[str, ...] | None = None) -> Column:
    """Indicators of one text: array of (ioc_type, value, confidence, context)."""
    def hits(t: Column) -> Column:
        unique = keep_first(_text_hits(t, include_private, types), "ioc_type", "value")
        return F.transform(unique, lambda h: F.struct(
            h["ioc_type"].alias("ioc_type"), h["value"].alias("value"),
            h["confidence"].alias("confidence"), snippet(t, h["found"]).alias("context")))

    return F.when(~is_blank(text), let(refang(text), hits))


@once_per_session
def _extract_from_column(text: str, include_private: bool, types: tuple[str, ...] | None) -> Column:
    return extract_from_text(F.col(text), include_private, types)


def text_iocs(df: DataFrame, text: str, *keys: str, include_private: bool = False,
              types: tuple[str, ...] | None = None) -> DataFrame:
    """One row per indicator of each text, with its position. Given ``types`` are the only ones looked for, and positions
    count among them; types do not depend on each other."""
    found = _extract_from_column(text, include_private, types)
    return df.select(*keys, F.posexplode(found).alias("position", "_ioc")).select(
        *keys, "position", "_ioc.ioc_type", "_ioc.value", "_ioc.confidence", "_ioc.context")


# -- Event fields -------------------------------------------------------------

def _full_hit(ioc_type: Column, value: Column, confidence: float, field: str) -> Column:
    return F.struct(
        ioc_type.alias("ioc_type"), value.alias("value"), F.lit(float(confidence)).alias("confidence"),
        F.lit(None).cast("string").alias("found"), F.lit(field).alias("source_field"),
        F.lit(-1).alias("text_index"))


def _ip_field(name: str, include_private: bool) -> Column:
    def usable(n: Column) -> Column:
        ok = ~N.is_loopback(n) & (n != 0)
        return ok if include_private else ok & ~N.is_private(n)

    def hit(ip: Column) -> Column:
        skip = ip.isin("-", "::1", "127.0.0.1", "0.0.0.0")
        v6 = let(N.canonical_ipv6(ip), lambda v: F.when(v.isNotNull(), _full_hit(F.lit("ipv6"), v, 1.0, name)))
        v4 = F.when(N.is_ipv4(ip), F.when(let(N.ipv4_number(ip), usable), _full_hit(F.lit("ipv4"), ip, 1.0, name)))
        return F.when(~skip, F.when(ip.contains(":"), v6).otherwise(v4))

    return let(strip(F.col(name)), hit)


def _username_field() -> Column:
    name = strip(F.col("username"))
    ok = ~F.upper(name).isin(*RESERVED_USERNAMES) & F.length(name).between(2, 64)
    return F.when(ok, _full_hit(F.lit("username"), name, 0.9, "username"))


def _hostname_field() -> Column:
    host = F.lower(strip(F.col("hostname")))
    ok = ~host.isin(*BENIGN_DOMAINS) & ~host.rlike(r"(?U)^\.*\d[\d.]*$") & (F.length(host) >= 3)
    return F.when(ok, _full_hit(F.lit("domain"), host, 0.8, "hostname"))


def _process_field() -> Column:
    name = F.lower(F.substring_index(F.substring_index(strip(F.col("process_name")), "\\", -1), "/", -1))
    return F.when((F.length(name) >= 2) & name.rlike("^" + _NAME),
                  _full_hit(F.lit("filename"), name, 0.85, "process_name"))


def _port_field(name: str) -> Column:
    port = F.col(name)
    ok = port.between(1, 65535) & ~port.isin(*BORING_PORTS)
    return F.when(ok, _full_hit(F.lit("port"), port.cast("string"), 0.9, name))


def _texts() -> Column:
    """Scanned texts in order: url, command line, path, data entries, raw line."""
    def entry(field: Column, text: Column) -> Column:
        return F.struct(field.alias("field"), refang(F.coalesce(text, F.lit(""))).alias("text"))

    data = F.filter(
        F.map_entries(F.col("normalized_data")),
        lambda e: e["value"].isNotNull() & (F.length(e["value"]) > 2) & ~e["key"].isin(*NOT_TEXT))
    from_data = F.transform(data, lambda e: entry(F.concat(F.lit("normalized_data."), e["key"]), e["value"]))
    fields = F.array(*[entry(F.lit(n), F.col(n)) for n in ("url", "command_line", "file_path")])
    empty = F.array().cast("array<struct<field:string,text:string>>")
    return F.concat(fields, F.coalesce(from_data, empty), F.array(entry(F.lit("raw_line"), F.col("raw_line"))))


def first_iocs(iocs: Column, most: int) -> Column:
    """The cap: the first ``most`` indicators of an event."""
    return F.slice(iocs, 1, most)


@once_per_session
def event_iocs(include_private: bool = False, max_iocs: int | None = None, contexts: bool = True) -> tuple[Column, Column]:
    """(texts, iocs) expressions; ``iocs`` reads the column ``_texts``.

    Insertion order and confidence follow the scan order of the fields. Only one
    case lets a later field win over an earlier one: a process name (0.85) over
    the same file name found in the url (0.75), which keeps the url's place.
    """
    texts = F.col("_texts")
    process = _process_field()

    def scanned(i: Column | int, t: Column) -> Column:
        factor = F.when(t["field"] == "raw_line", RAW_LINE_FACTOR).otherwise(1.0)
        raw = F.when(is_blank(t["text"]), F.array()).otherwise(_text_hits(t["text"], include_private))
        return F.transform(raw, lambda h: F.struct(
            h["ioc_type"].alias("ioc_type"), h["value"].alias("value"),
            (h["confidence"] * factor).alias("confidence"), h["found"].alias("found"),
            t["field"].alias("source_field"), F.lit(i).cast("int").alias("text_index")))

    def assemble(per_text: Column) -> Column:
        url = F.transform(F.get(per_text, F.lit(0)), lambda h: F.when(
            (h["ioc_type"] == "filename") & (h["value"] == process["value"]), process).otherwise(h))
        n = F.size(per_text)
        structured = F.array_compact(F.array(
            _ip_field("source_ip", include_private), _ip_field("dest_ip", include_private)))
        middle = F.array_compact(F.array(_username_field(), _hostname_field(), process))
        ports = F.array_compact(F.array(_port_field("source_port"), _port_field("dest_port")))
        return F.concat(
            structured, url, middle, F.flatten(F.slice(per_text, 2, 2)), ports,
            F.flatten(F.slice(per_text, 4, n - 3)))

    per_text = F.transform(texts, lambda t, i: scanned(i, t))
    unique = keep_first(let(per_text, assemble), "ioc_type", "value")
    if max_iocs is not None:
        unique = first_iocs(unique, max_iocs)

    def context(h: Column) -> Column:
        if not contexts:
            return F.lit(None).cast("string")
        return F.when(h["text_index"] >= 0, snippet(F.get(texts, h["text_index"])["text"], h["found"]))

    with_context = F.transform(unique, lambda h: F.struct(
        h["ioc_type"].alias("ioc_type"), h["value"].alias("value"), h["confidence"].alias("confidence"),
        h["source_field"].alias("source_field"), context(h).alias("context")))
    return _texts(), with_context


def add_event_iocs(events: DataFrame, include_private: bool = False,
                   max_iocs: int | None = None, contexts: bool = True) -> DataFrame:
    """Events with an ``iocs`` array in first-seen order; ``max_iocs`` keeps that many each. Without ``contexts`` these stay
    null: for counts, as looking each match up in its text again is dear in lines with many."""
    texts, iocs = event_iocs(include_private, max_iocs, contexts)
    return events.withColumn("_texts", texts).withColumn("iocs", iocs).drop("_texts")


def explode_iocs(events: DataFrame) -> DataFrame:
    """One row per event and indicator.

    An exploded plain column would get an inferred "not empty" filter, which is
    pushed down to where the array is made and makes it twice; an exploded
    expression does not.
    """
    return events.select(
        "log_id", "line_number", F.posexplode(F.array_compact("iocs")).alias("position", "_ioc")).select(
        "log_id", "line_number", "position", "_ioc.ioc_type", "_ioc.value", "_ioc.confidence",
        "_ioc.source_field", "_ioc.context")


def log_iocs(events: DataFrame) -> DataFrame:
    """First occurrence of every (type, value) per log, with the number of events.

    Grouping combines on the map side, so an indicator repeated in a third of
    all lines crosses the shuffle once per task.
    """
    hits = explode_iocs(events)
    first = F.min(F.struct("line_number", "position", "confidence", "source_field", "context"))
    return (hits.groupBy("log_id", "ioc_type", "value")
            .agg(first.alias("_first"), F.count(F.lit(1)).alias("event_count"))
            .select("log_id", "ioc_type", "value", F.col("_first.line_number").alias("line_number"),
                    F.col("_first.position").alias("position"),
                    F.col("_first.confidence").alias("confidence"),
                    F.col("_first.source_field").alias("source_field"),
                    F.col("_first.context").alias("context"), "event_count"))

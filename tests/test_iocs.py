"""Indicator extraction against plain regular expressions and per kind."""

import random
import re

from pyspark.sql import functions as F

from logwarden.operators import iocs as I
from logwarden.operators import parse as P

# The usual (backtracking) forms of the two patterns the library writes differently.
DOMAIN = re.compile(
    r"(?<![/@\w])((?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\[?\.\]?)+"
    r"(?:com|net|org|io|gov|mil|edu|co|uk|de|ru|cn|fr|nl|info|biz|int|arpa|xyz|online|site|tech|store|app|dev|[a-z]{2,6})"
    r"(?::\d{2,5})?(?![.\w]))", re.IGNORECASE)
EMAIL = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")


def found(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return [(r.ioc_type, r.value) for r in I.text_iocs(df, "t", "id", **options).orderBy("position").collect()]


def kinds(spark, text, kind, **options):
    return [v for t, v in found(spark, text, **options) if t == kind]


def test_rewritten_patterns_match_the_usual_ones(spark):
    random.seed(5)
    parts = ["a", "b.com", "x-y.org", "foo.", ".", "1.2.3.4", ":80", ":8080", "@", "/", "-", " ", "é", "com", "evil.xyz", "_", "co1m", "\n", "abcdefgh"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 14))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = rows.select("i", F.filter(F.regexp_extract_all("t", F.lit(I.DOMAIN), 1), lambda m: m != "").alias("d"),
                      F.regexp_extract_all("t", F.lit(I.EMAIL), 1).alias("e")).orderBy("i").collect()
    for r, text in zip(got, texts):
        assert r.d == [m.group(1) for m in DOMAIN.finditer(text)], text
        assert r.e == EMAIL.findall(text), text


def test_long_runs_do_not_overflow_or_stall(spark):
    text = "a." * 16_000 + "1 b.org " + "x" * 32_000 + " " + "a/" * 10_000
    assert "b.org" in kinds(spark, text, "domain")


def test_each_kind(spark):
    assert kinds(spark, "to 185[.]24[.]18[.]15 and 10.0.0.1, 127.0.0.1, 224.0.0.9, 1.2.3.4.5", "ipv4") == ["185.24.18.15"]
    assert kinds(spark, "to 10.0.0.1", "ipv4", include_private=True) == ["10.0.0.1"]
    assert kinds(spark, "ARP from 169.254.0.1", "ipv4") == []
    assert kinds(spark, "from 2001:0DB8::1 and ::1", "ipv6") == ["2001:db8::1"]
    assert kinds(spark, "cve-2021-44228", "cve") == ["CVE-2021-44228"]
    assert kinds(spark, "A@Malicious.com", "email") == ["a@malicious.com"]
    assert kinds(spark, "hxxps://evil.xyz/p?q=1 ok", "url") == ["https://evil.xyz/p?q=1"]
    assert kinds(spark, "DNS query for evil-c2.xyz, example.com", "domain") == ["evil-c2.xyz"]
    assert kinds(spark, "MD5=" + "a" * 32 + "0", "md5") == ["a" * 32]
    assert kinds(spark, "0" * 32 + " " + "b" * 40 + " " + "c" * 64, "md5") == []
    assert kinds(spark, "b" * 40, "sha1") == ["b" * 40] and kinds(spark, "c" * 64, "sha256") == ["c" * 64]
    assert kinds(spark, "/a/b /etc/passwd HKLM\\Soft\\Run", "file_path") == ["/etc/passwd", "HKLM\\Soft\\Run"]
    assert kinds(spark, "ran Evil.EXE", "filename") == ["evil.exe"]
    assert found(spark, "  ") == []


def test_duplicates_and_context(spark):
    text = "x" * 60 + " 185.24.18.15\nagain 185.24.18.15 " + "y" * 60
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(I.extract_from_text(F.col("t"))).alias("i")).select("i.*")
    rows = df.collect()
    assert [r.value for r in rows] == ["185.24.18.15"]
    at = text.index("185")
    assert rows[0].context == text[at - 40:at + 40].replace("\n", " ").strip()


def test_event_fields(spark, lines):
    base = P.parse_syslog(lines("linux_syslog", "Jul  1 10:23:11 h cron[1]: x"), 2025).drop(
        "source_ip", "dest_ip", "username", "hostname", "process_name", "url", "source_port", "dest_port", "raw_line")
    event = base.select(
        "*", F.lit("8.8.8.8").alias("source_ip"), F.lit("::FFFF:1.2.3.4").alias("dest_ip"), F.lit("system").alias("username"),
        F.lit("WS01.corp").alias("hostname"), F.lit("C:\\x\\Evil.exe").alias("process_name"), F.lit("http://a.xyz/q?f=evil.exe").alias("url"),
        F.lit(4444).alias("source_port"), F.lit(443).alias("dest_port"), F.lit("saw bad.org and a.xyz").alias("raw_line"))
    got = [(r.ioc_type, r.value, round(r.confidence, 3), r.source_field)
           for r in I.explode_iocs(I.add_event_iocs(event)).orderBy("position").collect()]
    assert got[:3] == [("ipv4", "8.8.8.8", 1.0, "source_ip"), ("ipv6", "::ffff:102:304", 1.0, "dest_ip"),
                       ("url", "http://a.xyz/q?f=evil.exe", 0.95, "url")]
    # the process name takes the place of the same name found in the url
    assert ("filename", "evil.exe", 0.85, "process_name") in got and got.index(("filename", "evil.exe", 0.85, "process_name")) < got.index(
        ("domain", "ws01.corp", 0.8, "hostname"))
    assert ("port", "4444", 0.9, "source_port") in got and not any(v == "443" for _, v, _, _ in got)
    assert got[-2:] == [("domain", "bad.org", 0.64, "raw_line"), ("domain", "a.xyz", 0.64, "raw_line")]
    assert len(I.add_event_iocs(event, max_iocs=2).first().iocs) == 2


# The usual forms of patterns that the library writes for speed, as Java patterns.
_HEX = "(?<![0-9a-fA-F])([0-9a-fA-F]{%d})(?![0-9a-fA-F])"
_NAMES = (r"(?i)(?<![/\\])([A-Za-z0-9_\-\.]{1,128}\.(?:exe|dll|bat|cmd|ps1|vbs|js|jar|sh|bash|py|pl|rb|"
          r"php|asp|aspx|jsp|cgi|msi|hta|scr|com|pif|lnk|iso|img))(?![A-Za-z0-9_\-])")
_KEYS = (r"(?i)((?:HKEY_LOCAL_MACHINE|HKLM|HKEY_CURRENT_USER|HKCU|HKEY_USERS|HKU|HKEY_CLASSES_ROOT|"
         r"""HKCR|HKEY_CURRENT_CONFIG|HKCC)(?:\\[^\x00-\x1f"'<>|]{1,255})+)""")


def test_fast_patterns_find_what_the_usual_ones_find(spark):
    random.seed(8)
    parts = ["a", "B", ".exe", ".js", ".jsp", ".Sh", ".", "/", "\\", "-", "_", " ", "é", "HKLM", "hkey_users", "HKU", "\\x", "1", "25",
             "1.2.3.4", "[.]", "(.)", "]", ":", "::", "2001:", "ffff", "\u0131", "\u212a", "a.", "b-c", ".com", "a" * 32, "b" * 40, "c" * 64, "0", "x" * 130, "+", "@", "\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 16))) for _ in range(4000)]
    t, every = F.col("t"), lambda p: F.regexp_extract_all("t", F.lit(p), 1)
    whole = lambda n: F.filter(every(I.HEX_RUN), lambda m: F.length(m) == n)
    v6 = I.IPV6.replace("(?=[0-9a-fA-F]{0,4}:)", "")
    v4 = I.IPV4.replace(r"(?=\d)", "")
    three_dots = lambda a: F.filter(a, lambda m: F.translate(m, "[](){}", "").rlike(r"^(?:\d+\.){3}\d+$"))
    dotted = F.when(t.rlike(I.DOTTED), every(I.IPV4)).otherwise(F.array().cast("array<string>"))
    domain = I.DOMAIN.replace(I._AHEAD, "")
    mail = r"(?:(?<![a-zA-Z0-9._%+\-])|\G)([a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
    pairs = {"names": (every(_NAMES), I.file_names(t)), "keys": (every(_KEYS), every(I.REGISTRY_KEY)),
             "v6": (every(v6), every(I.IPV6)), "v4": (three_dots(every(v4)), three_dots(dotted)), "mail": (every(mail), every(I.EMAIL)),
             "domain": (every(domain), every(I.DOMAIN)), **{f"hex{n}": (every(_HEX % n), whole(n)) for n in (32, 40, 64)}}
    rows = spark.createDataFrame([(x,) for x in texts], "t string").repartition(8).select(
        "t", *[c.alias(f"{name}_{i}") for name, both in pairs.items() for i, c in enumerate(both)]).collect()
    for name in pairs:
        assert any(r[f"{name}_0"] for r in rows), name
        for r in rows:
            assert r[f"{name}_0"] == r[f"{name}_1"], (name, r.t)


def test_asked_types_alone(spark):
    text = "a@b-c.com 185.24.18.15 CVE-2021-44228 MD5=" + "a" * 32 + " run evil.exe C:\\Users\\x\\y.dll http://c2.net/a " + "b" * 40
    all_found = found(spark, text)
    for kind in ("cve", "md5", "sha1", "file_path", "filename", "domain"):
        only = found(spark, text, types=(kind,))
        assert only and only == [x for x in all_found if x[0] == kind]


def test_process_name_needs_an_extension(spark):
    """A process name without an extension is no file name, though the pattern of file names passes such runs."""
    row = spark.createDataFrame([("sudo",), ("C:\\x\\Evil.EXE",)], "process_name string")
    assert [r.v for r in row.select(I._process_field()["value"].alias("v")).collect()] == [None, "evil.exe"]


def test_tests_ahead_of_dearer_ones_change_no_match(spark):
    random.seed(8)
    parts = ["cve-2024-", "CVE-1999-", "1234", "99", "é", "_", " ", "/", "/tmp", "a/b", ":", "-", "[.]", "(.)", "{}", "[", "hxxp", "H__Ps", "hXXps", "://",
             "c2.net", "x"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 12))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    dots = F.regexp_replace("t", r"\[\.?\]|\(\.?\)|\{\.?\}", ".")
    pairs = {"cve": (I.CVE, r"(?iU)\b(CVE-(?:19|20)\d{2}-\d{4,7})\b"), "path": (I.UNIX_PATH, I.UNIX_PATH.replace("(?=/)", ""))}
    columns = [F.regexp_extract_all("t", F.lit(p), 1).eqNullSafe(F.regexp_extract_all("t", F.lit(q), 1)).alias(n) for n, (p, q) in pairs.items()]
    plain = F.regexp_replace(dots, r"(?i)h(?:xx|__)p(s?)", "http$1")
    for r in rows.select("t", *columns, (I.refang(F.col("t")) == plain).alias("refang")).collect():
        assert r.cve and r.path and r.refang, r.t


def test_long_texts_are_trimmed_and_located_without_patterns():
    from logwarden.functions.text import strip

    assert "regexp" not in str(strip(F.col("t")))
    assert str(I.snippet(F.col("t"), F.col("m"))).count("instr") == 1
    assert I.CVE.startswith("(?=") and "(?=/)" in I.UNIX_PATH


def test_short_texts_without_marks_have_no_indicators(spark):
    for text in ("10.1", "x" * 31, "MD5=" + "a" * 20, "user 4625 Failed"):
        assert found(spark, text) == []
    assert found(spark, "::2") == [("ipv6", "::2")] and found(spark, "a@b.io")[0] == ("email", "a@b.io")
    assert found(spark, "MD5=" + "a" * 32) == [("md5", "a" * 32)]

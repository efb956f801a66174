"""The cheap tests ahead of the patterns spare no text that holds a match."""

import random
import re

from pyspark.sql import functions as F

from logwarden.operators import iocs as I


def test_guards_hold_for_every_match(spark):
    random.seed(8)
    parts = ["a", "b[.]com", "x.]org", ".", ".]", "[.", "1.2.3.4", ":80", "c:\\", "d:/", "\\\\", "host\\share", "/", " ", "\u212aa", ".\u017fh",
             ".\u0130o", ".\u0131o", ".EXE", ".ps1", "-", "_", "'", "users\\me", "\n", "abcdefgh", "a" * 16, "0f" * 8]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 10))) for _ in range(4000)]
    path = F.regexp_extract_all("t", F.lit(I.WINDOWS_PATH), 1)
    free = {  # the patterns without any guard
        "domain": F.exists(F.regexp_extract_all("t", F.lit(I.DOMAIN), 1), lambda m: m != ""),
        "filename": F.exists(F.regexp_extract_all("t", F.lit(I.FILENAME), 1), lambda m: m != "")}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8).select(
        "t", *[v.alias(k) for k, v in free.items()], path.alias("path"), F.col("t").rlike(I.DOT_LETTER).alias("named"),
        F.col("t").rlike(I.LONG_HEX).alias("hex"), F.transform(I._text_hits(F.col("t"), False), lambda h: h["found"]).alias("hits")).collect()
    assert sum(r.domain for r in rows) > 100 and sum(r.filename for r in rows) > 100 and sum(bool(r.path) for r in rows) > 100
    for r in rows:
        assert r.named or not (r.domain or r.filename), r.t
        assert set(r.path) <= set(r.hits), r.t
        assert r.hex == bool(re.search("[0-9a-fA-F]{32}", r.t))


def test_plain_words_of_long_texts_hold_no_indicator(spark, monkeypatch):
    """A long text gives the same indicators, in the same order, with its plain words and without; and is much shorter without."""
    random.seed(9)
    parts = ["word", "X9", "a" * 31, "b" * 32, "0f" * 16, "0f" * 15, "evil.com", "a[.]org", "1.2.3.4", "10 .1", "::1", "2001:db8::7", "CVE-2024-12345",
             "me@x.org", "hxxp://u.net/a", "HxXp://v.net", "c:\\My Files\\a b.exe", "HKLM\\Soft ware\\Run x", "/usr/lo cal/bin", "/tmp/a/drop.sh",
             "MD5=" + "a1" * 16, "run.exe", "caf\u00e9", "\u212a", "-", ".", "(", "'", "\n", "\t", "\u00a0", "  "]
    texts = [" ".join(random.choice(parts) for _ in range(random.randint(1, 60))) + random.choice(["", " x" * 300, " x y" * 200 + " "]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)

    def hits(least):
        monkeypatch.setattr(I, "LONG_TEXT", least)
        return {r.i: r.hits for r in df.select("i", I.extract_from_text(F.col("t")).alias("hits")).collect()}

    dropped, kept = hits(1), hits(10**9)
    assert dropped == kept and {h.ioc_type for v in kept.values() for h in v or ()} >= {"domain", "file_path", "cve", "md5", "ipv4", "filename"}
    assert I.LONG_TEXT == 10**9
    monkeypatch.setattr(I, "LONG_TEXT", 1_000)
    long = spark.createDataFrame([("CVE-2024-10000 " + "x " * 20_000 + "evil.com",)], "t string")
    assert long.select(F.length(I._without_plain_words(F.col("t")))).first()[0] < 30


def test_indicators_without_contexts(spark, lines):
    """The same indicators of events, with contexts or without."""
    from logwarden.operators import parse

    many = " ".join(f"CVE-2024-{i}" for i in range(10_000, 10_060))
    events = parse.parse_syslog(lines("linux_syslog", f"Jul  1 10:23:11 web sshd[12]: Failed password for root from 185.24.18.15 port 52431 ssh2 {many}"), 2024)
    whole, bare = (I.add_event_iocs(events, contexts=c).first().iocs for c in (True, False))
    assert len(whole) > 60 and [h[:4] for h in whole] == [h[:4] for h in bare]
    assert all(h.context is None for h in bare) and sum(h.context is not None for h in whole) >= 60

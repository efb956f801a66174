import datetime as dt
import ipaddress
import random
from urllib.parse import unquote

from pyspark.sql import functions as F

from logwarden.functions import arrays as A
from logwarden.functions import network as N
from logwarden.functions import text as X


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def ipv6_text(text):
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if address.ipv4_mapped:
        n = int(address) & 0xFFFFFFFF
        return f"::ffff:{n >> 16:x}:{n & 0xFFFF:x}"
    return str(address)


def test_canonical_ipv6(spark):
    random.seed(1)
    texts = ["::", "::1", "1::", "2001:DB8::1", "fe80::1%eth0", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:7::",
             "::2:3:4:5:6:7:8", "1::2::3", "12:34", "g::1", "1:2:3:4:5:6:7:8:9", ":1", "1:", ":::", "1:2:3:4:5:6:1.2.3.4",
             "::ffff:1.2.3.04"]
    texts += [":".join(random.choice(["0", "0", "1", "00ab", "f", "0000"]) for _ in range(8)) for _ in range(300)]
    assert column(spark, texts, N.canonical_ipv6) == [ipv6_text(t) for t in texts]


def test_private_ipv4(spark):
    random.seed(2)
    texts = ["10.0.0.1", "192.0.0.9", "192.0.0.1", "192.0.0.170", "172.16.0.1", "172.32.0.1", "198.19.0.1", "203.0.113.7",
             "100.64.0.1", "255.255.255.255", "239.1.1.1", "240.0.0.1"]
    texts += [".".join(str(random.randint(0, 255)) for _ in range(4)) for _ in range(300)]
    assert column(spark, texts, lambda c: N.is_private(N.ipv4_number(c))) == [
        ipaddress.IPv4Address(t).is_private for t in texts]
    assert column(spark, ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5"], N.is_ipv4) == [
        True, False, False, False, False]


def test_url_decode_twice(spark):
    texts = ["/a%20b", "/a+b%2520c", "/%zz%3Cscript", "plain", "%2525", "/%E2%82%AC"]
    assert column(spark, texts, X.url_decode_twice) == [unquote(unquote(t)) for t in texts]


def test_words_and_strip(spark):
    texts = ["  a  b　c ", "", "  ", "x\x1cy", "one"]
    assert column(spark, texts, X.words) == [t.split() for t in texts]
    assert column(spark, texts, X.word_count) == [len(t.split()) for t in texts]
    assert column(spark, texts, X.strip) == [t.strip() for t in texts]


def test_iso_timestamp(spark):
    texts = ["2025-07-01T10:23:11.5-0330", "2025-07-01T10:23:11", "2025-13-01T10:23:11Z", "junk"]
    got = column(spark, texts, lambda c: F.unix_micros(X.iso_timestamp(c)))
    want = [dt.datetime(2025, 7, 1, 13, 53, 11, 500000), dt.datetime(2025, 7, 1, 10, 23, 11)]
    assert got == [int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000) for t in want] + [None, None]


def test_keep_first(spark):
    random.seed(3)
    items = [(random.choice("abcdef"), i) for i in range(200)]
    df = spark.createDataFrame([(items,)], "x array<struct<k:string,v:int>>")
    got = [tuple(r) for r in df.select(A.keep_first(F.col("x"), "k").alias("y")).first().y]
    seen, want = set(), []
    for k, v in items:
        if k not in seen:
            seen.add(k)
            want.append((k, v))
    assert got == want

"""Joins with tables of blocks and suffixes, and the trigram index, against plain loops."""

import ipaddress
import random
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from logwarden.operators import address_blocks as B
from logwarden.operators import paging as P
from logwarden.operators import registered_domain as D
from logwarden.operators import value_index as V
from logwarden.session import shared_folder


def path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def test_blocks(spark):
    rng = random.Random(1)
    ip = lambda: ".".join(str(rng.choice([0, 1, 10, 127, 128, 255])) for _ in range(4))
    blocks = list({f"{ip()}/{rng.randrange(33)}" for _ in range(120)}) + ["0.0.0.0/0", "10.0.0.1", "10.0.0.1/32", "bad", "1.2.3.4/40", "300.1.1.1/8", None]
    addresses = [ip() for _ in range(400)] + ["", None, "::1", "1.2.3", "01.2.3.4", "10.0.0.1"]
    nets = {}
    for b in blocks:
        try:
            net = ipaddress.ip_network(b, strict=False)
        except (ValueError, TypeError):
            continue
        nets[net] = min(nets.get(net, (b, len(b))), (b, len(b)))
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id int, source_ip string")
    table = spark.createDataFrame([(b, len(b or "")) for b in blocks], "cidr string, tag int")
    located = B.locate(rows, table)
    got = {r.id: r.block and tuple(r.block) for r in located.collect()}
    for i, a in enumerate(addresses):
        try:
            hits = [n for n in nets if ipaddress.IPv4Address(a) in n]
        except (ValueError, TypeError):
            hits = []
        assert got[i] == (nets[max(hits, key=lambda n: n.prefixlen)] if hits else None), a
    plan = located._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert B.locate(rows, table.limit(0)).filter("block IS NULL").count() == len(addresses)


RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "// note", "", "github.io", "IO"]


def plain_domain(host, rules):
    labels = host.lower().rstrip(".").split(".")
    best = None
    for k in range(1, len(labels) + 1):
        name = ".".join(labels[-k:])
        if "!" + name in rules:
            best = k - 1
            break
        if name in rules:
            best = max(best or 0, k)
        if "*." + name in rules and len(labels) > k:
            best = max(best or 0, k + 1)
    s = best or 1
    return ".".join(labels[-s:]), ".".join(labels[-s - 1:]) if len(labels) > s else None, best is not None


def test_suffixes(spark):
    hosts = ["www.example.com", "a.b.co.uk", "co.uk", "uk", "www.ck", "a.www.ck", "x.ck", "y.x.ck", "ck", "city.kawasaki.jp", "a.b.kawasaki.jp",
             "b.kawasaki.jp", "kawasaki.jp", "me.github.io", "github.io", "unknown.tld", "tld", "WWW.Example.COM."]
    rules = [r.lower() for r in RULES]
    df = spark.createDataFrame([(h,) for h in hosts + hosts], "host string")
    table = spark.createDataFrame([(r,) for r in RULES], "rule string")
    got = {r.host: (r.suffix, r.domain) for r in D.registered_domains(df, table).collect()}
    listed = {r.host: r.domain for r in D.registered_domains(df, table, listed_only=True).collect()}
    assert len(got) == len(set(hosts))
    for h in hosts:
        suffix, domain, known = plain_domain(h, rules)
        assert got[h] == (suffix, domain), h
        assert listed[h] == (domain if known else None), h
    odd = spark.createDataFrame([(h,) for h in ("", None, "1.2.3.4", "a..com", "x y.com", "example.com:8080", "evil[.]com")], "host string")
    found = {r.host: r.domain for r in D.registered_domains(odd, table).collect()}
    assert found == {"": None, None: None, "1.2.3.4": None, "a..com": None, "x y.com": None, "example.com:8080": "example.com", "evil[.]com": "evil.com"}


def test_confirmed_domains(spark):
    iocs = spark.createDataFrame([("domain", "a.evil.com", 0.8), ("domain", "x.exe", 0.8), ("domain", "co.uk", 0.8), ("ipv4", "1.2.3.4", 1.0)],
                                 "ioc_type string, value string, confidence double")
    got = D.confirmed_domains(iocs, spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()
    assert sorted((r.value, r.confidence, r.registered_domain or "") for r in got) == [("1.2.3.4", 1.0, ""), ("a.evil.com", 0.9, "evil.com")]


@pytest.fixture(scope="module")
def iocs(spark):
    rng = random.Random(2)
    values = ["".join(rng.choices("abcAB_%\\.é", k=rng.randrange(1, 12))) for _ in range(400)] + ["", None, "ab", "x" * 5000 + "needle"]
    return spark.createDataFrame([(i, "domain" if i % 2 else "url", v) for i, v in enumerate(values * 2)], "log_id int, ioc_type string, value string")


@pytest.mark.parametrize("text", ["ab", "abc", "ABca", "a%b", "a_c", "_%", "\\a", "é.b", "needle", "nowhere", "abcab", "% %"])
def test_trigrams(spark, iocs, text):
    index = V.write_values(iocs, path(spark, "values"), 8)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(V.search_iocs_indexed(iocs, index, text)) == key(P.search_iocs(iocs, text))


def test_only_candidates_are_read(spark, iocs):
    where = path(spark, "values")
    V.write_values(iocs, where, 16)
    index = V.ValueIndex.read(spark, where)
    grams = {r.b for r in spark.createDataFrame([(g,) for g in V.asked_grams("needle")], "g string").select(V.bucket_of(F.col("g"), 16).alias("b")).collect()}
    hits = {r.b for r in V.candidates(index, "needle").select(F.pmod("value_id", F.lit(16)).alias("b")).collect()}
    for bucket in set(range(16)) - grams:
        shutil.rmtree(f"{where}/grams/gram_bucket={bucket}", ignore_errors=True)
    for bucket in set(range(16)) - hits:
        shutil.rmtree(f"{where}/values/bucket={bucket}", ignore_errors=True)
    assert [r.value[-6:] for r in V.search_values(V.ValueIndex.read(spark, where), "NEEDLE").collect()] == ["needle"]
    with pytest.raises(ValueError):
        V.search_values(index, " a ")

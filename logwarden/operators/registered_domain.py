"""Registered domains by a table of public suffixes, with wildcard and exception rules.

A rule is a suffix (``co.uk``), a wildcard (``*.ck``: every name directly under it is a suffix) or an exception
(``!www.ck``: not one, against its wildcard). The longest rule that fits a host by labels decides, an exception before all;
a host that none fits has its last label as suffix. The registered domain is the suffix and one label more.

Hosts meet the table by equality on their suffixes, one row per label, so the table may be of any size; hosts are made
distinct first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffix_rules(table: DataFrame, rule: str = "rule") -> DataFrame:
    """(name, kind): the rules in lower case without their marks; blank lines and comments (//) are left out."""
    text = F.lower(F.btrim(F.col(rule)))
    rows = table.select(text.alias("r")).filter("r <> '' AND r NOT LIKE '//%'")
    kind = F.when(F.col("r").startswith("!"), "exception").when(F.col("r").startswith("*."), "wildcard").otherwise("plain")
    return rows.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("name"), kind.alias("kind")).distinct()


def clean_host(host: Column) -> Column:
    """Lower case, without a port, a final full stop, or brackets around full stops."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(F.btrim(host), "[](){}", "")), r":\d+$", ""), r"\.$", "")


def registered_domains(hosts: DataFrame, rules: DataFrame, host: str = "host", listed_only: bool = False) -> DataFrame:
    """(host, suffix, domain) of every distinct host. ``domain`` is null for a host that is itself a suffix, and both are
    null for one that is no name (empty, with empty labels, or an address) and, with ``listed_only``, for one that no rule
    fits."""
    names = hosts.select(F.col(host).alias("host")).distinct().withColumn("n", clean_host(F.col("host")))
    sound = F.col("n").rlike(r"^[^.\s]+(\.[^.\s]+)*$") & ~F.col("n").rlike(r"^[0-9.]+$|:")
    names = names.withColumn("labels", F.when(sound, F.split("n", r"\.")))
    tails = names.filter("labels IS NOT NULL").select(
        "host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k")).withColumn(
        "name", F.array_join(F.slice("labels", -F.col("k"), F.col("k")), "."))
    met = tails.join(suffix_rules(rules) if "kind" not in rules.columns else rules, "name")
    # labels of the suffix that a rule gives; a wildcard needs one label more than it has
    k = F.when(F.col("kind") == "plain", F.col("k")).when(F.col("kind") == "exception", F.col("k") - 1).when(
        F.size("labels") > F.col("k"), F.col("k") + 1)
    decided = met.withColumn("s", k).filter("s IS NOT NULL").groupBy("host").agg(
        F.max(F.struct((F.col("kind") == "exception").alias("first"), F.col("s"))).alias("best"))
    rows = names.alias("a").join(
        decided.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")), "left").select("a.host", "a.labels", "b.best.s")
    s, size = F.coalesce("s", F.lit(None).cast("int") if listed_only else F.lit(1)), F.size("labels")
    tail = lambda n: F.array_join(F.slice("labels", -n, n), ".")
    return rows.select("host", F.when(size > 0, tail(F.least(s, size))).alias("suffix"),
                       F.when(size > s, tail(s + 1)).alias("domain"))


def confirmed_domains(iocs: DataFrame, rules: DataFrame) -> DataFrame:
    """Indicators with their domains checked by a rule of the table: those with a registered domain count 0.9 and carry
    it, the others are no domains and go. Indicators of other types stay as they are."""
    names = iocs.filter("ioc_type = 'domain'").select(F.col("value").alias("host"))
    found = registered_domains(names, rules, listed_only=True).filter("domain IS NOT NULL").select(
        F.col("host").alias("_host"), F.col("domain").alias("registered_domain"))
    domain = F.col("ioc_type") == "domain"
    return iocs.join(found, domain & (F.col("value") == F.col("_host")), "left").filter(
        ~domain | F.col("_host").isNotNull()).withColumn("confidence", F.when(domain, 0.9).otherwise(F.col("confidence"))).drop("_host")

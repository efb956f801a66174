"""IPv4 addresses against a table of blocks: an interval join by equality.

A block of prefix length n covers an address if their first n bits are equal. So addresses meet blocks by (length, masked
address) for the lengths that occur in the table, at most 33, and the longest block wins. No range condition, hence no
nested loop: the join is a hash or sort-merge join, and addresses are made distinct first, so a hot address costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.network import ipv4_number, is_ipv4


def masked(number: Column, bits: Column) -> Column:
    """The first ``bits`` of a 32-bit number, as a number."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - bits).cast("int"))
    return number - F.pmod(number, low)


def blocks_of(table: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``table`` with ``bits`` and ``network`` of its blocks, written a.b.c.d/n; a bare address is a block of its own, host
    bits are masked off, rows that are no block are left out."""
    base, bits = F.substring_index(cidr, "/", 1), F.when(F.col(cidr).contains("/"), F.substring_index(cidr, "/", -1)).otherwise("32")
    number, n = F.when(is_ipv4(base), ipv4_number(base)), F.when(bits.rlike("^[0-9]{1,2}$"), bits.cast("int"))
    known = table.withColumn("bits", n).withColumn("network", number).filter("network IS NOT NULL AND bits BETWEEN 0 AND 32")
    return known.withColumn("network", masked(F.col("network"), F.col("bits")))


def locate(rows: DataFrame, table: DataFrame, address: str = "source_ip", cidr: str = "cidr") -> DataFrame:
    """``rows`` with ``block``: the row of ``table`` whose block is the longest that holds the address, else null.

    Of equal blocks the least row counts. Addresses that are no IPv4 have no block.
    """
    blocks = blocks_of(table, cidr)
    lengths = [r.bits for r in blocks.select("bits").distinct().collect()]  # at most 33
    whole = F.struct(*(F.col(f"`{c}`") for c in table.columns)).alias("block")
    each = blocks.select("bits", "network", whole).groupBy("bits", "network").agg(F.min("block").alias("block"))
    known = rows.select(F.col(f"`{address}`").alias("_ip")).filter(is_ipv4(F.col("_ip"))).distinct()
    asked = known.withColumn("_n", ipv4_number(F.col("_ip"))).select(
        "_ip", "_n", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("bits"))
    met = asked.withColumn("network", masked(F.col("_n"), F.col("bits"))).join(each, ["bits", "network"])
    best = met.groupBy("_ip").agg(F.max_by("block", "bits").alias("block"))
    return rows.join(best, rows[address] == best["_ip"], "left").drop("_ip")

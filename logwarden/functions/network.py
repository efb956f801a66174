"""IP address checks as integer arithmetic and string rewriting (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.arrays import let

# Blocks that count as private, with their two exceptions.
PRIVATE_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PRIVATE_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")


def _number(dotted: str) -> int:
    n = 0
    for octet in dotted.split("."):
        n = n * 256 + int(octet)
    return n


def is_ipv4(text: Column) -> Column:
    """Four decimal octets, none above 255, none with a leading zero."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return text.rlike(rf"^(?:{octet}\.){{3}}{octet}$")


def ipv4_number(text: Column) -> Column:
    """Valid IPv4 text as a 32-bit number in a long."""
    def total(octets: Column) -> Column:
        number = F.lit(0).cast("long")
        for i in range(4):
            number = number * 256 + F.get(octets, F.lit(i)).try_cast("long")
        return number

    return let(F.split(text, r"\."), total)


def in_block(number: Column, cidr: str) -> Column:
    base, bits = cidr.split("/")
    low = _number(base)
    return number.between(low, low + 2 ** (32 - int(bits)) - 1)


def is_private(number: Column) -> Column:
    inside = F.lit(False)
    for block in PRIVATE_BLOCKS:
        inside = inside | in_block(number, block)
    return inside & ~number.isin([_number(ip) for ip in PRIVATE_EXCEPTIONS])


def is_loopback(number: Column) -> Column:
    return in_block(number, "127.0.0.0/8")


def is_multicast(number: Column) -> Column:
    return in_block(number, "224.0.0.0/4")


# -- IPv6 -------------------------------------------------------------------

_GROUP = "[0-9a-f]{1,4}"


def _dotted_tail_to_groups(addr: Column) -> Column:
    """``..:1.2.3.4`` becomes ``..:102:304``; other text is unchanged."""
    dotted = F.regexp_extract(addr, r":([0-9.]+)$", 1)
    n = ipv4_number(dotted)
    groups = F.concat(
        F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
    return (F.when(~addr.contains("."), addr)
            .when(is_ipv4(dotted), F.concat(F.regexp_replace(addr, r"[0-9.]+$", ""), groups)))


def canonical_ipv6(text: Column) -> Column:
    """Compressed lower-case form of an IPv6 address; null when it is not one.

    Written with string functions only: expand ``::`` to eight groups, drop
    leading zeros, then replace the longest (first on ties) run of zero groups.
    A dotted IPv4 tail is written as two groups, as Python 3.11 prints it.
    """
    scope = F.regexp_extract(text, r"%[^%/]+$", 0)
    addr = let(F.lower(F.regexp_replace(text, r"%[^%/]+$", "")), _dotted_tail_to_groups)
    return F.concat(let(let(addr, _expanded), _compressed), scope)


def _expanded(addr: Column) -> Column:
    n_groups = F.regexp_count(addr, F.lit(_GROUP))
    full_form = addr.rlike(f"^(?:{_GROUP}:){{7}}{_GROUP}$")
    short_form = addr.rlike(f"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?$") & (n_groups <= 7)
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), 8 - n_groups))
    groups = F.when(full_form, addr).when(
        short_form,
        F.regexp_replace(F.concat(F.substring_index(addr, "::", 1), zeros,
                                  F.substring_index(addr, "::", -1)), "^:|:$", ""))
    return F.regexp_replace(groups, r"(?<![0-9a-f])0+(?=[0-9a-f])", "")


def _compressed(groups: Column) -> Column:
    result = groups
    for run in range(2, 9):
        shape = rf"^(?:(.*?):)??0(?::0){{{run - 1}}}(?::(.*))?$"
        result = F.when(groups.rlike(shape), F.regexp_replace(groups, shape, "$1::$2")).otherwise(result)
    return result

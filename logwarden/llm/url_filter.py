"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join, below host and path rules.

A canonical URL is host and path: ``host/`` lists a site, ``host/a/b/`` a folder, ``host/a/b.html`` a page. A page is
looked up under every suffix of its host (two labels at least) with every folder prefix of its path and the path itself.

1. The Bloom filter has one 64-bit block per ``KEYS_PER_BLOCK`` listed URLs; a URL sets ``BITS`` bits of the block its hash
   names. The blocks are a table (block, bits), built by ``bit_or``, broadcast only if it has at most ``MAX_BLOCKS`` rows.
2. Lookup keys whose bits are all set are possible hits; they are joined with the list itself, so a false positive of
   the filter never decides.
3. Rules come first: a rule (host, path) fits its host and all subdomains if the path starts with the rule's path; the
   longest fitting rule decides, otherwise the list does.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, and is allowed; repeated
rows are judged one by one; an empty list or rule set decides nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import ascii_lower, only, repeatable

KEYS_PER_BLOCK = 4
BITS = 4
MAX_BLOCKS = 2_000_000  # 16 bytes a row

Rule = tuple[str, str, str]  # host, path, verdict


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (as host and path) and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def lookup_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Every canonical URL under which a page may be listed.

    No listed host has more than ``labels`` labels and no listed path more than ``depth`` slashes, so longer suffixes
    and deeper folders need no lookup; a long url stays cheap.
    """
    names, parts = F.split(host, "\\."), F.split(path, "/")
    counts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(names), F.lit(labels))))
    sites = F.transform(counts, lambda i: F.array_join(F.slice(names, -i, i), "."))
    depths = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))))
    folders = F.transform(depths, lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    page = F.when(F.size(parts) - 1 <= depth, path).otherwise("/")
    paths = F.array_distinct(F.concat(folders, F.array(F.when(page == "", "/").otherwise(page))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(
        sites, lambda s: F.transform(paths, lambda p: F.concat(s, p))))))


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bits_of(key: Column) -> Column:
    """The bits a key sets in its block: BITS six-bit numbers cut from a second hash."""
    h, bits = F.xxhash64(key, F.lit(1)), F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of a table of canonical URLs (``key``) as rows (block, bits)."""
    return listed.groupBy(block_of(F.col("key"), n_blocks).alias("block")).agg(
        F.bit_or(bits_of(F.col("key"))).alias("bits"))


def listed_rows(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """The ``_row`` of each listed page (_row, host, path): Bloom filter first, exact join after."""
    listed = listed.select(F.col("key").cast("string")).filter("key IS NOT NULL").distinct()
    site = F.substring_index("key", "/", 1)
    count, labels, depth = listed.agg(
        F.count("*"), F.coalesce(F.max(F.size(F.split(site, "\\."))), F.lit(1)),
        F.coalesce(F.max(F.size(F.split("key", "/")) - 1), F.lit(1))).first()
    n_blocks = max(1, -(-count // KEYS_PER_BLOCK))
    blocks = bloom(listed, n_blocks)
    blocks = F.broadcast(blocks) if n_blocks <= MAX_BLOCKS else blocks
    keys = pages.select("_row", F.explode(lookup_keys(F.col("host"), F.col("path"), labels, depth)).alias("key"))
    possible = keys.withColumn("block", block_of(F.col("key"), n_blocks)).withColumn("mask", bits_of(F.col("key"))) \
        .join(blocks, "block").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return possible.join(listed, "key", "left_semi").select("_row").distinct()


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per page row: page_id, host, path, rule, listed, verdict. ``listed`` has canonical URLs in ``key``."""
    rows = only(repeatable(pages), page_id="long", url="string").select(
        F.monotonically_increasing_id().alias("_row"), "page_id", host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"))
    hits = listed_rows(rows, listed).withColumn("hit", F.lit(True))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(hits, "_row", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce("hit", F.lit(False)).alias("listed"),
        F.coalesce(decided, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))

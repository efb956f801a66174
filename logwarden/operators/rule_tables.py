"""Rules as a table of any size: patterns meet the distinct event types in automata, the matches come back by a join.

Rules written into the plan as constants (``match_rules``) suit a few thousand. Here the patterns are cut by hash into slices
of about ``SLICE_CHARS`` characters; a task builds one automaton (Aho and Corasick) over all patterns of a slice and reads
each event type once, whatever the number of patterns. Event types are distinct first, and cut into tiles of about
``TYPES_AT_ONCE`` types and ``TILE_CHARS`` characters; each slice meets each tile. Event types may be long texts, so that matches, joins and groups go by
a type's SHA-256. Nothing is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.session import write_and_read

SLICE_CHARS = 20_000_000
TYPES_AT_ONCE = 100_000
TILE_CHARS = 4_000_000


def found_in(patterns: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, pattern) positions of every pattern that a text contains, each once. An empty pattern is in every text."""
    from ahocorasick import Automaton

    automaton, places = Automaton(), {}
    for i, pattern in enumerate(patterns):
        places.setdefault(pattern, []).append(i)
    for pattern, at in places.items():
        if pattern:
            automaton.add_word(pattern, at)
    automaton.make_automaton()
    always = places.get("", [])
    rows, columns = [], []
    for i, text in enumerate(texts):
        hits = {p: at for p, at in ((id(at), at) for _, at in (automaton.iter(text) if len(automaton) else ()))}
        found = [j for at in hits.values() for j in at] + always
        rows += [i] * len(found)
        columns += found
    return np.array(rows, np.int64), np.array(columns, np.int64)


def pattern_hits(types: DataFrame, rules: DataFrame, slice_chars: int = SLICE_CHARS,
                 types_at_once: int = TYPES_AT_ONCE, tile_chars: int = TILE_CHARS) -> DataFrame:
    """(key, seq): the ``key`` of each distinct ``type`` with the rules that have a pattern in it, ignoring case."""
    patterns = rules.select("seq", F.explode("patterns").alias("pattern")).select("seq", F.lower("pattern").alias("pattern"))
    size = patterns.agg(F.ceil(F.coalesce(F.sum(F.length("pattern") + 1), F.lit(0)) / slice_chars)).first()[0]
    number, chars = types.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("type")), F.lit(0))).first()
    slices, tiles = max(1, int(size)), max(1, -(-number // types_at_once), -(-chars // tile_chars))
    left = patterns.select(F.pmod(F.xxhash64("pattern"), F.lit(slices)).alias("slice"),
                           F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<long>")).alias("tile"), "seq", "pattern")
    right = types.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")).alias("of"),
                         F.pmod(F.xxhash64("key"), F.lit(tiles)).alias("of_tile"), "key", "type")

    def run(key: tuple, rules_: pa.Table, asked: pa.Table) -> pa.Table:
        at, hit = found_in(rules_.column("pattern").to_pylist(), asked.column("type").to_pylist())
        seq = rules_.column("seq").to_numpy().astype(np.int64)
        return pa.table({"key": asked.column("key").take(pa.array(at)), "seq": pa.array(seq[hit] if len(hit) else hit)})

    return left.groupBy("slice", "tile").cogroup(right.groupBy("of", "of_tile")).applyInArrow(
        run, "key binary, seq long").distinct()


def match_rule_table(events: DataFrame, rules: DataFrame, **sizes: int) -> DataFrame:
    """Events with ``_matched``: their rules as structs, by priority then ``seq``; ``rules`` has the columns of the rule
    schema, ``seq`` unique. Equal to ``match_rules`` for the same rules."""
    type_ = F.lower(F.coalesce("event_type", F.lit("")))
    key = F.unhex(F.sha2(type_, 256))
    kinds = write_and_read(events.select(key.alias("key"), "log_type").distinct(), "kinds")
    types = write_and_read(events.select(key.alias("key"), type_.alias("type")).dropDuplicates(["key"]), "types")
    hits = pattern_hits(types, rules, **sizes)
    whole = F.struct(*(F.col(f"r.{c}") for c in rules.columns))
    fits = (F.size("r.log_types") <= 0) | F.array_contains("r.log_types", F.col("log_type"))
    found = kinds.join(hits, "key").join(rules.alias("r"), "seq").filter(F.coalesce(fits, F.lit(False)))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("r.priority").alias("p"), F.col("r.seq").alias("s"), whole.alias("rule"))))
    lists = found.groupBy("key", "log_type").agg(F.transform(ordered, lambda x: x["rule"]).alias("_matched"))
    rows, table = events.withColumn("_key", key).alias("e"), lists.alias("m")
    same = (F.col("e._key") == F.col("m.key")) & F.col("e.log_type").eqNullSafe(F.col("m.log_type"))
    none = F.array().cast(lists.schema["_matched"].dataType)
    return rows.join(table, same, "left").select(
        *(F.col(f"e.`{c}`") for c in events.columns), F.coalesce("m._matched", none).alias("_matched"))

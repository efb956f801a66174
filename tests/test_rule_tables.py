"""Rules as a table against rules as constants, and against a nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators import classify as C
from logwarden.operators import rule_tables as R
from logwarden.operators.rules import RULE_SCHEMA, RULES, rules_df

TYPES = ["Failed Login", "failed login twice", "LSASS Access", "Privilege Escalation", "Web Server Error", "Windows Event", "", None,
         "Nothing known", "Special Privileges Assigned", "File Deleted", "DNS Query", "HTTP Request"]


def events(spark, types):
    kinds = ["linux_syslog", "windows_event", None]
    rows = [(i, t, kinds[i % 3]) for i, t in enumerate(x for x in types for _ in range(6))]
    return spark.createDataFrame(rows, "event_id long, event_type string, log_type string")


@pytest.mark.parametrize("sizes", [{}, {"slice_chars": 60, "types_at_once": 2}])
def test_as_constants(spark, sizes):
    rows = events(spark, TYPES)
    order = lambda df: sorted((r.event_id, [x.rule_id for x in r["_matched"]]) for r in df.collect())
    assert order(R.match_rule_table(rows, rules_df(spark), **sizes)) == order(C.match_rules(rows))
    table = C.classify_events(rows, rules_df(spark))
    assert sorted(map(str, table.collect())) == sorted(map(str, C.classify_events(rows, RULES).collect()))


def test_many_patterns(spark):
    """100,000 patterns, empty and repeated ones among them, against a nested loop."""
    rng = random.Random(9)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    word = lambda k: "".join(rng.choices(syllables, k=k))
    patterns = [word(rng.randrange(2, 6)).upper() for _ in range(99_997)] + ["", "ba", "ba"]
    rules = [(f"R{i}", [p], ["b"] if i % 2 else [], None, None, None, None, None, None, i % 10, "c", [], i % 7, i)
             for i, p in enumerate(patterns)]
    types = [" ".join(word(rng.randrange(2, 5)) for _ in range(4)) for _ in range(30)] + ["", "BA"]
    rows = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(types)], "event_id long, event_type string, log_type string")
    got = {r.event_id: [x.seq for x in r["_matched"]] for r in R.match_rule_table(
        rows, spark.createDataFrame(rules, RULE_SCHEMA), slice_chars=300_000).collect()}
    for i, t in enumerate(types):
        expected = [(k % 7, k) for k, p in enumerate(patterns) if p.lower() in t.lower() and (k % 2 == 0 or i % 2 == 1)]
        assert got[i] == [k for _, k in sorted(expected)]


def test_nothing(spark):
    rows, rules = events(spark, TYPES), rules_df(spark)
    assert R.match_rule_table(rows.limit(0), rules).count() == 0
    assert C.classify_events(rows, rules.limit(0)).filter("is_classified").count() == 0
    assert C.classify_events(rows, rules.limit(0)).count() == rows.count()
    nulls = rules.limit(1).withColumn("patterns", F.array(F.lit(None).cast("string")))
    assert C.classify_events(rows, nulls).filter("is_classified").count() == 0


def test_long_types_travel_once(spark):
    """Matches of long event types carry keys, not the texts, and tiles are cut by characters."""
    types = spark.createDataFrame([(bytes([i]) * 32, f"w{i} " + "alpha beta gamma " * 5_000) for i in range(20)], "key binary, type string")
    rules = spark.createDataFrame([(f"R{i}", [w], [], None, None, None, None, None, None, 1, "c", [], 1, i)
                                   for i, w in enumerate(("alpha", "beta", "gamma", "w7 ", "none"))], RULE_SCHEMA)
    got = R.pattern_hits(types, rules, tile_chars=100_000)
    assert got.columns == ["key", "seq"]
    assert sorted((r.key[0], r.seq) for r in got.collect()) == sorted([(i, s) for i in range(20) for s in range(3)] + [(7, 3)])

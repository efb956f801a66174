"""Classification of events by the rule table, inside each row.

Joining events with rules would need either a second pass over the parsed lines
(for the distinct event types) or a shuffle to collect the matches of an event.
The rule table is small by nature, so it becomes literals: every pattern test is
a generated ``contains``, and an event's matches are an array in its row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.operators.rule_tables import match_rule_table
from logwarden.operators.rules import RULE_SCHEMA, RULES, Rule
from logwarden.session import once_per_session

BASE_CONFIDENCE = 0.7
THREAT_SCORE = 5


def severity_label(score: Column) -> Column:
    return (F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 5, "medium")
            .when(score >= 3, "low").otherwise("info"))


def is_threat() -> Column:
    return F.col("severity_score") >= THREAT_SCORE


def is_critical() -> Column:
    return F.col("severity") == "critical"


def _rule_array(rules: list[Rule]) -> Column:
    """The table as one constant array of structs (folded by the optimizer)."""
    rows = [dict(zip(RULE_SCHEMA.names, r.row(i))) for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), T.ArrayType(RULE_SCHEMA))


@once_per_session
def _match_columns(rules: tuple[Rule, ...]) -> tuple[Column, Column, Column]:
    ordered = sorted(rules, key=lambda r: r.priority)
    event_type = F.col("_type")

    def condition(rule: Rule) -> Column:
        hit = F.lit(False)
        for pattern in rule.patterns:
            hit = hit | event_type.contains(pattern.lower())
        if rule.log_types:
            hit = hit & F.col("log_type").isin(*rule.log_types)
        return hit

    positions = F.array_compact(F.array(*[F.when(condition(r), i) for i, r in enumerate(ordered)]))
    return (F.lower(F.coalesce(F.col("event_type"), F.lit(""))), F.explode(F.array(positions)),
            F.transform("_positions", lambda i: F.get(_rule_array(ordered), i)))


def match_rules(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Events with ``_matched``: their rules as structs, by priority then definition order.

    The positions come from a generator, not a projection: filters on the score
    would be pushed through a projection and copy the event type's expression
    into every pattern test.
    """
    event_type, positions, matched = _match_columns(tuple(rules))
    return (events.withColumn("_type", event_type).select("*", positions.alias("_positions"))
            .withColumn("_matched", matched).drop("_type", "_positions"))


def classify_events(events: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """Events with their classification columns; unmatched ones score 1, info.

    A few thousand rules may be constants of the plan; more are a table. Confidence: 0.7, +0.1 when the primary rule names log types, + 0.02 per
    matched rule up to 0.1.
    """
    matched = F.col("_matched")
    first = F.get(matched, F.lit(0))
    n = F.size(matched)
    score = F.coalesce(F.array_max(F.transform(matched, lambda r: r["severity_score"])), F.lit(1))
    confidence = F.round(
        F.lit(BASE_CONFIDENCE) + F.when(F.size(first["log_types"]) > 0, 0.1).otherwise(0.0)
        + F.least(F.lit(0.1), n * 0.02), 2)
    rows = match_rule_table(events, rules) if isinstance(rules, DataFrame) else match_rules(events, rules)
    return rows.select(
        *events.columns,
        severity_label(score).alias("severity"),
        score.alias("severity_score"),
        first["technique_id"].alias("mitre_technique_id"),
        first["technique_name"].alias("mitre_technique_name"),
        first["tactic_name"].alias("mitre_tactic"),
        first["tactic_id"].alias("mitre_tactic_id"),
        first["sub_technique_id"].alias("sub_technique_id"),
        first["sub_technique_name"].alias("sub_technique_name"),
        F.coalesce(first["threat_category"], F.lit("Unclassified")).alias("threat_category"),
        F.when(n > 0, F.least(F.lit(1.0), confidence)).otherwise(0.0).alias("confidence"),
        F.transform(matched, lambda r: r["rule_id"]).alias("matched_rules"),
        F.array_distinct(F.flatten(F.transform(matched, lambda r: r["tags"]))).alias("tags"),
        (n > 0).alias("is_classified"))


def enrich_events(events: DataFrame, summary_iocs: int | None = None) -> DataFrame:
    """Write the indicators (all, or the first ``summary_iocs``) and the classification into ``normalized_data``."""
    listed = F.col("iocs") if summary_iocs is None else F.slice("iocs", 1, summary_iocs)
    summary = F.when(F.size("iocs") > 0, F.to_json(F.transform(
        listed,
        lambda i: F.struct(i["ioc_type"].alias("type"), i["value"].alias("value"),
                           i["confidence"].alias("confidence")))))
    audit = F.to_json(F.struct(
        F.col("mitre_tactic_id").alias("tactic_id"), F.col("mitre_tactic").alias("tactic_name"),
        F.col("mitre_technique_id").alias("technique_id"),
        F.col("mitre_technique_name").alias("technique_name"),
        "sub_technique_id", "sub_technique_name", "severity", "severity_score", "threat_category",
        "confidence", "matched_rules", "tags"))
    no_data = F.create_map().cast("map<string,string>")
    added = F.create_map(F.lit("extracted_iocs"), summary, F.lit("classification"), audit)
    return events.withColumn("normalized_data", F.map_concat(F.coalesce(F.col("normalized_data"), no_data), added))

"""Column expressions the operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.session import write_and_read

SPACES = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, gap: str, edge: str) -> Column:
    """The words between runs of the character class ``gap``; ``edge`` lists its characters. A null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(edge))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, gap + "++")).otherwise(F.array().cast("array<string>"))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return split_words(text, "[\\x20\\x09-\\x0D]", SPACES)


def bind(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once per row (a let binding)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(value: Column) -> Column:
    """``value`` as a generator of one row. The optimizer copies a projected expression into filters and lambda bodies
    that use it; it does not copy a generator, so what stands behind one is computed once per row."""
    return F.explode(F.array(value))


def starts(n_words: Column, width: int) -> Column:
    """Start positions, from 0, of the full windows of ``width`` words; none if there are fewer words."""
    return F.when(n_words >= width, F.sequence(F.lit(0), n_words - width)) \
        .otherwise(F.array().cast("array<int>"))


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns with these types; every other column, whatever its name, stays behind."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


#: Plan nodes that give the rows of files in the same partitions and order each time.
REPEATABLE = {"LogicalRelation", "Project", "Filter", "LocalRelation"}


def repeatable(docs: DataFrame) -> DataFrame:
    """``docs`` such that numbers of its rows are the same in every evaluation: as it is if it only scans, selects and
    filters, else written once. A shuffle, for one, may deal rows anew each time it runs."""
    def plain(plan) -> bool:
        kids = plan.children()
        return plan.nodeName() in REPEATABLE and all(plain(kids.apply(i)) for i in range(kids.size()))

    plan = docs._jdf.queryExecution().optimizedPlan()
    return docs if plan.deterministic() and plain(plan) else write_and_read(docs, "input")

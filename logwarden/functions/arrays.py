"""Small array and vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_first(items: Column, *key_fields: str) -> Column:
    """Drop later items with the same key, keeping order, in n log n per row.

    Sorting (key, position) pairs and comparing neighbours avoids both a
    shuffle and the quadratic "exists an earlier one" test.
    """
    def by_position(hs: Column) -> Column:
        keyed = F.sort_array(F.transform(
            hs, lambda h, i: F.struct(*[h[k].alias(k) for k in key_fields], i.alias("_i"))))

        def changed(s: Column, x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            same = F.lit(True)
            for k in key_fields:
                same = same & before[k].eqNullSafe(x[k])
            return (i == 0) | ~same

        firsts = let(keyed, lambda s: F.filter(s, lambda x, i: changed(s, x, i)))
        order = F.sort_array(F.transform(firsts, lambda x: x["_i"]))
        return F.transform(order, lambda i: F.get(hs, i))

    return let(items, by_position)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(vec: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    norm = F.sqrt(dot(vec, vec))
    return let(norm, lambda n: F.transform(
        vec, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))

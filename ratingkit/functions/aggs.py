"""Named aggregate factory: a config word -> a JVM-side aggregate ``Column``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``std`` is the sample standard deviation (null for a single value), ``count`` counts non-null values.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(c),
    "sum": lambda c: F.sum(c),
    "count": lambda c: F.count(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def agg_expr(name: str, col: str) -> Column:
    try:
        return AGGREGATES[name](col)
    except KeyError:
        raise ValueError(f"unknown aggregate {name!r}; choose from {sorted(AGGREGATES)}") from None

"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    """A query vector inside the plan: no join with a one-row table, and columns can be pruned."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in vector) + ")")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in doubles."""
    squares = F.zip_with(a.cast("array<double>"), b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))

"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` (a one-element transform),
    so an expensive value used several times is not recomputed."""
    return F.transform(F.array(expr), fn)[0]


def literal_map(table: dict[str, str]) -> Column:
    """``table`` as a map of two literals: a call for each entry would cost
    seconds per plan. No key or value holds a NUL."""
    keys, values = (F.split(F.lit("\0".join(x)), "\0") for x in zip(*sorted(table.items()), strict=True))
    return F.map_from_arrays(keys, values)

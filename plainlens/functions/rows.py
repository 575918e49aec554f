"""Arrays to rows, and values bound to a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bound(x: Column, make: Callable[[Column], Column]) -> Column:
    """make(x) where x is worked out once for a row, however often make reads it."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def exploded(df: DataFrame, keep: list, items: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row for each element that is not null, with the kept columns; no element, no row.

    The outer form with a filter after it: for the inner form the optimiser infers a filter on the array's size and moves it,
    with the whole expression of the array written out, below the projection that computes it.
    """
    if position is None:
        out = df.select(*keep, F.explode_outer(items).alias(name))
    else:
        out = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    return out.filter(F.col(name).isNotNull())

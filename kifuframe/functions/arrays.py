"""Small helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``.

    A lambda evaluates everything it captures again for each element. Binding the
    captured value to a lambda variable keeps array formulas linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that later steps use many times.

    Catalyst copies a projected expression into every filter and projection that uses
    it. A one-row generator is not copied, so a costly parse runs once per row.
    """
    fields = [value.alias(name) for name, value in values.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def total(values: Column) -> Column:
    """Sum of an array of doubles, from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def int_div(a: Column, b: int | Column) -> Column:
    """Integer division as ``int``."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b).cast("int")


def cell_range(n: int) -> Column:
    """All cell ids of an n x n board, ascending."""
    return F.sequence(F.lit(0), F.lit(n * n - 1))


def argmax_index(values: Column) -> Column:
    """Index of the largest element, lowest index on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")

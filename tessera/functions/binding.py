"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    A column expression that is used several times, or inside the lambda of
    a `transform`, would otherwise be computed at each use and element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

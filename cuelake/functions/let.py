"""Local binding inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Optimizer rules that move filters and projections copy an expression to each of
    its uses (also into lambdas, where it would run per element); a lambda variable is
    immune to that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

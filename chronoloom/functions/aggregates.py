"""Aggregates that let a null through unless told otherwise.

The plain Spark aggregates skip nulls. Here a null inside the group makes the answer null, so a total
over a series with unfilled gaps is visibly unknown; ``na_rm=True`` gives the plain Spark behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(c: Column, answer: Column, na_rm: bool) -> Column:
    return answer if na_rm else F.when(F.count(c) == F.count(F.lit(1)), answer)


def total(column: str | Column, na_rm: bool = False) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return _strict(c, F.sum(c), na_rm)


def mean(column: str | Column, na_rm: bool = False) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return _strict(c, F.avg(c), na_rm)


def lowest(column: str | Column, na_rm: bool = False) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return _strict(c, F.min(c), na_rm)


def highest(column: str | Column, na_rm: bool = False) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return _strict(c, F.max(c), na_rm)


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_distinct(*columns: str, approximate: bool = False) -> Column:
    """Number of distinct values, a null counted as one value; exact unless asked otherwise."""
    value = F.struct(*columns)
    return F.approx_count_distinct(value) if approximate else F.count_distinct(value)

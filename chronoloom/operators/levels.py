"""Ordered category levels: lumping, moving and dropping levels.

Levels sort by name, apart from the ones moved to the front or the back. That rule is kept as a sort
expression, so a column never needs a lookup table to be grouped, lumped or sorted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_in
from .relational import global_positions


@dataclass(frozen=True)
class LevelOrder:
    """Levels moved out of alphabetical order."""

    first: tuple[str, ...] = ()
    last: tuple[str, ...] = ()

    def relevel(self, *levels: str, after: float = 0) -> "LevelOrder":
        """Move levels to the front, or to the back with ``after=float("inf")``."""
        first = tuple(x for x in self.first if x not in levels)
        last = tuple(x for x in self.last if x not in levels)
        if after == float("inf"):
            return LevelOrder(first, (*last, *levels))
        if after != 0:
            raise ValueError("levels move to the front (0) or to the back (inf)")
        return LevelOrder((*levels, *first), last)

    def sort_columns(self, column: str) -> list[Column]:
        c = F.col(column)
        place = F
        for i, level in enumerate(self.first):
            place = place.when(c == level, i - len(self.first))
        for i, level in enumerate(self.last):
            place = place.when(c == level, i + 1)
        if place is F:
            return [c.asc_nulls_last()]
        rank = place.when(c.isNotNull(), 0).otherwise(len(self.last) + 1)
        return [rank.asc(), c.asc_nulls_last()]


def lump_keep(df: DataFrame, column: str, keep: DataFrame | Iterable[str], other: str = "Other") -> DataFrame:
    """Replace every level outside ``keep`` (a list, or a one-column table) by ``other``.

    A kept set given as a table stays distributed: it is joined, never collected.
    """
    if not isinstance(keep, DataFrame):
        kept = F.when(F.col(column).isNull() | is_in(column, keep), F.col(column)).otherwise(F.lit(other))
        return df.withColumn(column, kept)
    (source,) = keep.columns
    flags = keep.select(F.col(source).alias("__keep")).distinct()
    joined = df.join(flags, df[column] == flags["__keep"], "left")
    kept = F.when(F.col("__keep").isNotNull() | F.col(column).isNull(), F.col(column)).otherwise(F.lit(other))
    return joined.withColumn(column, kept).select(*df.columns)


def lump_drop(df: DataFrame, column: str, drop: Iterable[str], other: str = "Other") -> DataFrame:
    """Replace the listed levels by ``other``."""
    return df.withColumn(column, F.when(is_in(column, drop), F.lit(other)).otherwise(F.col(column)))


def present_levels(df: DataFrame, column: str, order: LevelOrder | None = None) -> DataFrame:
    """The levels in use with their 1-based ordinal; levels without rows are thereby dropped."""
    values = df.select(F.col(column).alias("level")).where(F.col(column).isNotNull()).distinct()
    ranked = global_positions(values, (order or LevelOrder()).sort_columns("level"), "ordinal")
    return ranked.select("level", (F.col("ordinal") + 1).alias("ordinal"))

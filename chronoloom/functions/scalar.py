"""Scalar functions whose null and matching rules differ from Spark's own."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted day-month-year layouts, most common first.
DMY_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "dMMMyyyy", "ddMMyyyy")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def parse_dmy(c: str | Column, formats: Iterable[str] = DMY_FORMATS) -> Column:
    """Day-month-year text to DATE; text no layout accepts becomes null instead of failing the job."""
    text = F.trim(_col(c))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def if_else(condition: Column, yes: object, no: object) -> Column:
    """Conditional with a null result where the condition itself is unknown."""
    return F.when(condition, _value(yes)).when(~condition, _value(no))


def is_in(c: str | Column, values: Iterable[object]) -> Column:
    """Membership that is false, never null, for a null value (unless null is one of the values)."""
    values = list(values)
    known = [v for v in values if v is not None]
    hit = F.coalesce(_col(c).isin(known), F.lit(False)) if known else F.lit(False)
    return hit | _col(c).isNull() if len(known) < len(values) else hit


def recode(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values; anything else, null included, stays as it is."""
    c = _col(c)
    out = F
    for old, new in mapping.items():
        out = out.when(c == F.lit(old), F.lit(new))
    return out.otherwise(c) if mapping else c


def regex_replace(c: str | Column, pattern: str, replacement: str = "") -> Column:
    """Replace every match of a regular expression."""
    return F.regexp_replace(_col(c), pattern, replacement)


def cut_at_blank(c: str | Column) -> Column:
    """Keep the text before the first blank, e.g. ``Phone - inbound`` to ``Phone``."""
    return regex_replace(c, r"( | -).*$")


def paste(*parts: object) -> Column:
    """Concatenate columns and literal text without a separator; a null part gives null."""
    return F.concat(*[_value(p).cast("string") for p in parts])


def constant(value: float) -> Column:
    """A constant double column; infinities included."""
    return F.lit(float(value))

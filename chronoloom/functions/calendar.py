"""Time axes: calendar units, integer ordinals and period indexers.

Every temporal operator works on an integer *ordinal* of the index: days for a DATE, microseconds for
a timestamp, months for a monthly index and so on. Ordinals make "the next observation", "how many are
missing" and "which block of the series is this" plain integer arithmetic that stays in generated code,
and they make month and year intervals exact (28..31 days have no common difference, 1 month has).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 7 * 86_400_000_000,
}
UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
MONTHS = {"month": 1, "quarter": 3, "year": 12}
DAYS = {"day": 1, "week": 7}


def floordiv(value: Column, divisor: int | Column) -> Column:
    """Integer division rounding down, exact for 64-bit values before and after the epoch."""
    if isinstance(divisor, int) and divisor == 1:
        return value
    d = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", value - F.pmod(value, d), d)


@dataclass(frozen=True)
class Interval:
    """The common distance between observations, e.g. ``Interval(1, "day")``; 0 units: count not yet known."""

    n: int
    unit: str

    @property
    def label(self) -> str:
        return f"{self.n}{self.unit.upper()}"


@dataclass(frozen=True)
class Axis:
    """How one index column maps to ordinals. ``kind`` is date, timestamp, timestamp_ntz or int.

    ``utc`` says that the session's zone is UTC, where wall-clock time and instants are the same number.
    """

    kind: str
    unit: str
    utc: bool = False

    @classmethod
    def of(cls, data_type: T.DataType, interval: Interval | None, zone: str = "") -> "Axis":
        if isinstance(data_type, T.DateType):
            unit = interval.unit if interval else "day"
            if unit not in DAYS and unit not in MONTHS:
                raise ValueError(f"a DATE index cannot have an interval in {unit}s")
            return cls("date", unit)
        if isinstance(data_type, (T.TimestampNTZType, T.TimestampType)):
            kind = "timestamp_ntz" if isinstance(data_type, T.TimestampNTZType) else "timestamp"
            unit = interval.unit if interval else "microsecond"
            if unit not in MICROS and unit not in MONTHS:
                raise ValueError(f"a timestamp index cannot have an interval in {unit}s")
            return cls(kind, unit, zone in UTC)
        if isinstance(data_type, T.IntegralType):
            return cls("int", interval.unit if interval else "unit")
        raise TypeError(f"{data_type.simpleString()} cannot be a time index")

    def ordinal(self, c: Column) -> Column:
        if self.kind == "int":
            return c.cast("bigint")
        if self.unit in MONTHS:
            return (F.year(c) * 12 + F.month(c) - 1).cast("bigint")
        if self.kind == "date":
            return F.unix_date(c).cast("bigint")
        if self.kind == "timestamp":
            return F.unix_micros(c)
        if self.utc:
            return F.unix_micros(c.cast("timestamp"))
        # Wall-clock fields only, so the session time zone never enters.
        day = F.unix_date(c.cast("date")).cast("bigint") * MICROS["day"]
        second = (F.call_function("date_part", F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return (
            day
            + F.hour(c).cast("bigint") * MICROS["hour"]
            + F.minute(c).cast("bigint") * MICROS["minute"]
            + second
        )

    def value(self, o: Column, data_type: T.DataType) -> Column:
        """The index value at an ordinal; month units give the first day of the period."""
        if self.kind == "int":
            return o.cast(data_type)
        if self.unit in MONTHS:
            first = F.make_date(
                floordiv(o, 12).cast("int"), (F.pmod(o, F.lit(12)) + 1).cast("int"), F.lit(1)
            )
            return first.cast(data_type)
        if self.kind == "date":
            return F.date_from_unix_date(o.cast("int"))
        if self.kind == "timestamp":
            return F.timestamp_micros(o)
        if self.utc:
            return F.timestamp_micros(o).cast("timestamp_ntz")
        seconds = (o.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)

    def step(self, interval: Interval) -> int:
        """The interval measured in ordinals."""
        if self.kind == "int":
            return interval.n
        if interval.unit in MONTHS:
            return interval.n * MONTHS[interval.unit]
        if self.kind == "date":
            return interval.n * DAYS[interval.unit]
        return interval.n * MICROS[interval.unit]

    def interval_of(self, step: int) -> Interval:
        """Name a step in the coarsest unit that divides it, without crossing week or year lines."""
        if self.kind == "int":
            return Interval(step, self.unit)
        if self.unit in MONTHS:
            size = MONTHS[self.unit]
            return Interval(step // size, self.unit) if step % size == 0 else Interval(step, "month")
        if self.kind == "date":
            return Interval(step // 7, "week") if self.unit == "week" and step % 7 == 0 else Interval(step, "day")
        for unit in ("day", "hour", "minute", "second", "millisecond"):
            if step % MICROS[unit] == 0:
                return Interval(step // MICROS[unit], unit)
        return Interval(step, "microsecond")


@dataclass(frozen=True)
class Period:
    """A calendar period of an index column, used by ``index_by``."""

    unit: str
    source: str

    def column(self) -> Column:
        c = F.col(self.source)
        if self.unit == "year":
            return F.year(c)
        if self.unit == "day":
            return c.cast("date")
        return F.trunc(c, self.unit)


def year(column: str) -> Period:
    """Calendar year as an integer."""
    return Period("year", column)


def yearquarter(column: str) -> Period:
    """First day of the calendar quarter."""
    return Period("quarter", column)


def yearmonth(column: str) -> Period:
    """First day of the calendar month."""
    return Period("month", column)


def yearweek(column: str) -> Period:
    """Monday of the week."""
    return Period("week", column)


def day(column: str) -> Period:
    """Calendar day of a timestamp."""
    return Period("day", column)


def yearmonth_label(c: Column) -> Column:
    """Printed form of a month, e.g. ``2014 Jan``."""
    return F.date_format(c, "yyyy MMM")

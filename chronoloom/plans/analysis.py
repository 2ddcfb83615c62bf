"""The analysis of a declared table: yearly channel shares, and the smoothed daily total."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import TemporalFrame
from ..functions.calendar import year, yearmonth
from ..operators.windows import FAMILY


def annual(filled: TemporalFrame, groups: tuple[str, ...] = ("channel", "category")) -> TemporalFrame:
    """Volume per group and calendar year."""
    return filled.group_by(*groups).index_by(year=year("date")).summarise(annual_volume=F.sum("volume"))


def monthly(filled: TemporalFrame, groups: tuple[str, ...] = ("channel", "category")) -> TemporalFrame:
    """Volume per group and calendar month."""
    return filled.group_by(*groups).index_by(yearmth=yearmonth("date")).summarise(monthly_volume=F.sum("volume"))


def channel_share(filled: TemporalFrame) -> TemporalFrame:
    """Each channel's part of its category's volume, year by year."""
    return annual(filled).share("annual_volume", ["category"])


def smoothed(total: TemporalFrame, size: int = 7) -> TemporalFrame:
    """The daily total with its moving average."""
    return total.mutate(ma=FAMILY["slide_dbl"]("ttl_volume", "mean", size=size))


def smoothed_by_month(total: TemporalFrame, size: int = 2) -> TemporalFrame:
    """The daily total with the mean over all days of the last ``size`` months."""
    mean = FAMILY["slide_dbl"]("ttl_volume", "mean")
    return total.slide_period(yearmonth("date"), "yrmth", size, ma=mean)

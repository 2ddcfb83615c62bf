"""Summaries over groups and calendar periods, and shares of a total."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import Interval

if TYPE_CHECKING:
    from ..frame import TemporalFrame


def summarise(tf: "TemporalFrame", **aggregates: Column) -> "TemporalFrame":
    """Aggregate per group and index. The index, or its period, is always a group of its own.

    The groups become the key, the period becomes the index, and the last group is peeled off. Only
    groups that occur appear.
    """
    m = tf.meta
    index = m.index_by[0] if m.index_by else m.index
    df = tf.df.groupBy(*m.groups, index).agg(*[a.alias(n) for n, a in aggregates.items()])
    key = tuple(k for k in m.key if k in m.groups) + tuple(g for g in m.groups if g not in m.key)
    whole_series = set(m.key) <= set(m.groups)
    return tf.with_(
        df,
        index=index,
        key=key,
        nesting=tuple(n for n in m.nesting if n.child in key and n.parent in key),
        interval=_interval(tf, whole_series) if m.index_by else m.interval,
        lattice=m.lattice and not m.index_by,
        groups=m.groups[:-1],
        index_by=None,
        dense=m.dense and (m.shared_span or whole_series),
        max_rows=m.max_rows if whole_series else None,
    )


def _interval(tf: "TemporalFrame", whole_series: bool) -> Interval:
    """The interval of periods: one unit where every series has a row in each period of its span, which a
    filled table of a short interval has; else its count is left to be found when it is needed."""
    m, unit = tf.meta, tf.meta.index_by[1].unit
    longest = {"year": 365, "quarter": 90, "month": 28, "week": 7, "day": 1}[unit]
    filled = m.dense and (m.shared_span or whole_series) and m.interval is not None
    days = {"day": 1, "week": 7}.get(m.interval.unit, 0) * m.interval.n if filled else 0
    return Interval(1 if 0 < days <= longest else 0, unit)


def share(df: DataFrame, value: str, within: list[str], name: str = "share") -> DataFrame:
    """Add each row's share of the total of its panel.

    The panel totals are a partial-aggregated table joined back, so a panel that holds a large part of
    all rows is never gathered in one task, as a window over the panel would do.
    """
    totals = df.groupBy(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)]).agg(F.sum(value).alias("__total"))
    same = [df[c].eqNullSafe(totals[f"__w{i}"]) for i, c in enumerate(within)]
    part = F.when(F.col("__total") != 0, F.col(value) / F.col("__total"))
    return df.join(totals, same, "inner").select(*df.columns, part.alias(name))

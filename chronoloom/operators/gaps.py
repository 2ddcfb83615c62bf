"""Implicit gaps: make missing rows explicit, or report them.

A gap is found by looking at the next observation of the same series; the missing rows are then made
where the row before the gap already is. Only the observed rows are ever shuffled, never the (much
larger) filled table, and no calendar is joined back to the data.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout as L
from .layout import NEXT, O, PREV

if TYPE_CHECKING:
    from ..frame import TemporalFrame

_AT, _RUN = "__at", 1 << 16


def _span(tf: "TemporalFrame") -> Column:
    """First and last ordinal of the whole table, as a one-row subquery."""
    ends = tf.df.agg(F.min(tf.meta.index).alias("lo"), F.max(tf.meta.index).alias("hi"))
    lo, hi = tf.axis.ordinal(F.col("lo")), tf.axis.ordinal(F.col("hi"))
    return ends.select(F.struct(lo.alias("lo"), hi.alias("hi"))).scalar()


def fill_size(tf: "TemporalFrame", full: bool = False) -> DataFrame:
    """Rows before and after a fill, and their ratio; from one partial-aggregated pass."""
    step = tf.axis.step(tf.require_interval())
    ends = tf.df.groupBy(*tf.meta.key).agg(
        F.count(F.lit(1)).alias("n"), F.min(tf.meta.index).alias("lo"), F.max(tf.meta.index).alias("hi")
    )
    lo, hi = tf.axis.ordinal(F.col("lo")), tf.axis.ordinal(F.col("hi"))
    sums = ends.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_series"),
        F.sum(L.floordiv(hi - lo, step) + 1).alias("own"),
        F.min(lo).alias("lo"),
        F.max(hi).alias("hi"),
    )
    filled = F.col("n_series") * (L.floordiv(F.col("hi") - F.col("lo"), step) + 1) if full else F.col("own")
    return sums.select("n_rows", filled.alias("n_filled"), (filled / F.col("n_rows")).alias("ratio"))


def _runs(first: Column, last: Column, df: DataFrame, long_gaps: bool) -> DataFrame:
    """One output row per offset ``first..last``. Long runs are made in two steps, so no row ever holds
    an array longer than a run."""
    if not long_gaps:
        return df.withColumn(_AT, F.explode(F.sequence(first, last)))
    df = df.withColumn("__first", first).withColumn("__last", last)
    starts = F.sequence(F.col("__first"), F.col("__last"), F.lit(_RUN).cast("bigint"))
    df = df.withColumn("__run", F.explode(starts))
    stop = F.least(F.col("__last"), F.col("__run") + (_RUN - 1))
    df = df.withColumn(_AT, F.explode(F.sequence(F.col("__run"), stop)))
    return df.drop("__first", "__last", "__run")


def fill_na(
    tf: "TemporalFrame", full: bool = False, max_ratio: float | None = None, **values: object
) -> "TemporalFrame":
    """Insert the missing rows of every series, over its own span or (``full``) the table's span.

    Columns not named in ``values`` are null in the inserted rows; a null that was there before stays.
    A distance that isn't a multiple of the interval is filled as far as whole intervals fit in. With
    ``max_ratio`` a fill that would multiply the table by more than that is refused (this runs a job).
    """
    m = tf.meta
    step = tf.axis.step(tf.require_interval())
    unknown = set(values) - set(tf.measures)
    if unknown:
        raise ValueError(f"cannot fill {', '.join(sorted(unknown))}: not a measured column")
    if max_ratio is not None:
        ratio = fill_size(tf, full).first()["ratio"]
        if ratio is not None and ratio > max_ratio:
            raise ValueError(f"filling would multiply the table by {ratio:.1f} (limit {max_ratio})")
    placed = L.place(tf)
    df = L.neighbours(placed, previous=full)
    zero = F.lit(0).cast("bigint")
    after = F.greatest(L.floordiv(F.col(NEXT) - F.col(O), step) - 1, zero)
    after = F.when(F.col(NEXT).isNotNull(), after)
    if full:
        span = _span(tf)
        last = F.coalesce(after, L.floordiv(span.getField("hi") - F.col(O), step))
        first = F.when(F.col(PREV).isNull(), -L.floordiv(F.col(O) - span.getField("lo"), step)).otherwise(zero)
    else:
        first, last = zero, F.coalesce(after, zero)
    df = _runs(first, last, df, placed.blocked)
    index_type = tf.df.schema[m.index].dataType
    inserted = F.col(_AT) != 0
    columns: list[Column] = []
    for c in tf.df.columns:
        if c in m.key:
            columns.append(F.col(c))
        elif c == m.index:
            at = tf.axis.value(F.col(O) + F.col(_AT) * step, index_type)
            columns.append(F.when(inserted, at).otherwise(F.col(c)).alias(c))
        elif m.index_by and c == m.index_by[0]:
            columns.append(F.lit(None).alias(c))
        else:
            new = F.lit(values[c]).cast(tf.df.schema[c].dataType) if c in values else F.lit(None)
            columns.append(F.when(inserted, new).otherwise(F.col(c)).alias(c))
    out = df.select(*columns)
    if m.index_by:
        out = out.withColumn(m.index_by[0], m.index_by[1].column())
    return tf.with_(
        out, dense=m.lattice or step == 1, shared_span=full or m.shared_span, costly=placed.blocked or m.costly, max_rows=None
    )


def count_gaps(tf: "TemporalFrame", full: bool = False) -> DataFrame:
    """Missing stretches of each group's index: groups (or key), from, to, n.

    ``full`` also reports what is missing before the first and after the last observation, against the
    span of the whole table.
    """
    m = tf.meta
    step = tf.axis.step(tf.require_interval())
    index_type = tf.df.schema[m.index].dataType
    by = list(m.groups) or list(m.key)
    seen = tf.with_(
        tf.df.select(*by, m.index).distinct(),
        key=tuple(by),
        nesting=(),
        groups=(),
        index_by=None,
        dense=False,
        max_rows=m.max_rows if set(m.key) <= set(by) else None,
    )
    df = L.neighbours(L.place(seen), previous=full)
    at = lambda o: tf.axis.value(o, index_type)

    def gap(first: Column, last: Column, when: Column) -> Column:
        n = L.floordiv(last - first, step) + 1
        body = F.struct(at(first).alias("from"), at(last).alias("to"), n.alias("n"))
        return F.when(when & (n > 0), body)

    o = F.col(O)
    gaps = [gap(o + step, F.col(NEXT) - step, F.col(NEXT).isNotNull())]
    if full:
        span = _span(tf)
        lead = L.floordiv(o - span.getField("lo"), step) * step
        tail = L.floordiv(span.getField("hi") - o, step) * step
        gaps.append(gap(o - lead, o - step, F.col(PREV).isNull()))
        gaps.append(gap(o + step, o + tail, F.col(NEXT).isNull()))
    found = df.select(*by, F.explode(F.array_compact(F.array(*gaps))).alias("gap"))
    return found.select(*by, "gap.from", "gap.to", "gap.n")

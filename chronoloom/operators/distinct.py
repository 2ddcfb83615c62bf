"""Distinct counts over slides and stretches.

The count of a window follows from that of the window before: a row adds one if its value doesn't occur in
the ``size - 1`` rows before it, and takes one away ``size`` rows later if the value hasn't come again by
then. So it takes the places of the same value before and after each row, and sums: the cost per row does
not grow with the window, and no window holds its values. The table is looked at once more as series of
(key, value), which may be as hot as the keys are and are cut into blocks alike.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..functions.bodies import NAMED, Distinct
from . import layout as L

if TYPE_CHECKING:
    from ..frame import TemporalFrame
    from .windows import WindowCall

AT, NEW, GONE = "__at", "__new", "__gone"


def is_distinct(call: "WindowCall") -> bool:
    return isinstance(call.body, Distinct)


def distinct_counts(tf: "TemporalFrame", calls: Mapping[str, "WindowCall"]) -> "TemporalFrame":
    """Add a count for each call; a null counts as one value, and equal rows of values are one value."""
    kept = [c for c in tf.df.columns if c not in calls]
    short = L.mode_of(tf) == "short"
    placed = L.positions(tf)
    out = tf.with_(placed.df.select(*tf.df.columns, F.col(L.P).alias(AT)), costly=placed.blocked or tf.meta.costly)
    values = {}
    for i, call in enumerate(calls.values()):
        if call.columns not in values:
            values[call.columns] = (f"{L.PREV}{i}", f"{L.NEXT}{i}")
            out = _occurrences(out, call.columns, values[call.columns], short)
    steps, leaving = {}, {}
    for i, (name, call) in enumerate(calls.items()):
        before, after = (F.col(c) for c in values[call.columns])
        if call.kind == "stretch":
            steps[f"{NEW}{i}"] = before.isNull()
            continue
        steps[f"{GONE}{i}"] = after.isNull() | (after - F.col(AT) >= call.size)
        steps[f"{NEW}{i}"] = before.isNull() | (F.col(AT) - before >= call.size)
        leaving[f"__left{i}"] = replace(call, columns=(f"{GONE}{i}",), body=NAMED["sum"], out_type=None, partial=True)
    out = out.with_(out.df.withColumns({n: F.when(c, 1).otherwise(0).cast("bigint") for n, c in steps.items()}))
    # Of what has left by the window's end, the last ``size`` rows are still in it: they leave later.
    total = replace(next(iter(calls.values())), kind="stretch", body=NAMED["sum"], size=1, out_type=None, partial=True)
    out = out.mutate(**leaving, **{f"__sum{n}": replace(total, columns=(n,)) for n in steps})
    df = out.df
    for i, (name, call) in enumerate(calls.items()):
        count = F.col(f"__sum{NEW}{i}")
        if call.kind == "slide":
            count = count - F.col(f"__sum{GONE}{i}") + F.col(f"__left{i}")
        df = df.withColumn(f"__n{i}", count if call.partial else F.when(F.col(AT) >= call.size - 1, count))
    return out.with_(df.select(*kept, *[F.col(f"__n{i}").alias(name) for i, name in enumerate(calls)]))


def _occurrences(tf: "TemporalFrame", columns: tuple[str, ...], names: tuple[str, str], short: bool) -> "TemporalFrame":
    """Add the places of the same value before and after each row in its series."""
    m = tf.meta
    copies = {f"__value{i}": F.col(c) for i, c in enumerate(columns)}
    meta = replace(
        m, index=AT, key=(*m.key, *copies), nesting=(), interval=None, groups=(), index_by=None, dense=False,
        shared_span=False, max_rows=m.layout.hot_rows if short else None,
    )
    placed = L.place(type(tf)(tf.df.withColumns(copies), meta))
    df = L.neighbours(placed, previous=True).withColumnsRenamed(dict(zip((L.PREV, L.NEXT), names)))
    return tf.with_(df.select(*tf.df.columns, *names), costly=placed.blocked or m.costly)

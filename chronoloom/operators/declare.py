"""Declare a temporal table and check what was declared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Meta, Nested, TemporalFrame, split_key
from ..functions.calendar import Interval, Period
from . import layout as L


def as_temporal(
    df: DataFrame,
    index: str | Period,
    key: list[str | Nested | tuple[Nested, ...]] | None = None,
    interval: Interval | str | None = "auto",
    validate: bool = True,
    max_rows: int | None = None,
    layout: L.Layout | None = None,
    ties: list[str] | None = None,
) -> TemporalFrame:
    """Declare the index and the key of a table.

    ``interval``: ``"auto"`` detects it (a job), an ``Interval`` states it, ``None`` marks the index as
    irregular. ``validate`` refuses a table where key and index repeat, a child key has two parents, or a
    distance isn't a multiple of a stated interval (a job each). With a stated interval and
    ``validate=False`` nothing runs.

    ``ties`` names columns that order observations of one instant, where a series may have several: key, index
    and ties then identify a row. Windows follow that order; observations of one instant stay in one block.

    An index that holds the first days of periods is declared as ``yearmonth("month")``: distances are
    then counted in that unit.
    """
    columns, nesting = split_key(key or [])
    unit = None
    if isinstance(index, Period):
        index, unit = index.source, Interval(0, index.unit)
    meta = Meta(index, columns, nesting, unit, max_rows=max_rows, layout=layout or L.Layout(), ties=tuple(ties or ()))
    missing = [c for c in meta.ties if c not in df.columns]
    if missing:
        raise ValueError(f"ties not in the table: {', '.join(missing)}")
    tf = TemporalFrame(df, meta)
    if validate:
        if not duplicates(tf).isEmpty():
            raise ValueError("key and index do not identify a row: see duplicates(...)")
        if nesting and not broken_nesting(tf).isEmpty():
            raise ValueError("a nested key has more than one parent: see broken_nesting(...)")
    if interval == "auto":
        found = detect_interval(tf) or (unit and Interval(1, unit.unit))
        return tf.with_(interval=found, lattice=found is not None)
    tf = tf.with_(interval=interval)
    if validate and interval is not None:
        if not off_lattice(tf).isEmpty():
            raise ValueError("distances aren't multiples of the stated interval: see off_lattice(...)")
        tf = tf.with_(lattice=True)
    return tf


def off_lattice(tf: TemporalFrame) -> DataFrame:
    """Rows whose next observation isn't a multiple of the interval away."""
    step = tf.axis.step(tf.require_interval())
    rest = F.pmod(F.col(L.NEXT) - F.col(L.O), F.lit(step))
    return L.neighbours(L.place(tf)).where(rest != 0).select(*tf.df.columns)


def duplicates(tf: TemporalFrame) -> DataFrame:
    """(key, index) pairs, with ties if declared, that occur more than once, with their count ``n``."""
    return tf.df.groupBy(*tf.meta.key, tf.meta.index, *tf.ties).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def broken_nesting(tf: TemporalFrame) -> DataFrame:
    """Children of a nested key that occur under several parents: level, child, n_parents.

    All levels are looked at in one pass: distinct combinations first, then distinct pairs of them.
    """
    if not tf.meta.nesting:
        raise ValueError("the key has no nested columns")
    used = dict.fromkeys(c for n in tf.meta.nesting for c in (n.child, n.parent))
    text = lambda c: F.col(c).cast("string")
    links = [F.struct(F.lit(n.child).alias("level"), text(n.child).alias("child"), text(n.parent).alias("__p")) for n in tf.meta.nesting]
    pairs = tf.df.select(*used).distinct().select(F.inline(F.array(*links))).distinct()
    return pairs.groupBy("level", "child").agg(F.count(F.lit(1)).alias("n_parents")).where(F.col("n_parents") > 1)


def _gcd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce a column of distances to their greatest common divisor."""
    common = 0
    for batch in batches:
        steps = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
        if len(steps):
            common = int(np.gcd(common, np.gcd.reduce(steps)))
    yield pa.record_batch({"at": pa.array([None], pa.int64()), "step": pa.array([common], pa.int64())})


def _lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce ordinals of one series, in any order, to one of them and the divisor of all distances to it."""
    at, common = None, 0
    for batch in batches:
        ordinals = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
        if len(ordinals):
            at = int(ordinals[0]) if at is None else at
            common = int(np.gcd(common, np.gcd.reduce(ordinals - at)))
    yield pa.record_batch({"at": pa.array([at], pa.int64()), "step": pa.array([common], pa.int64())})


def interval_of(tf: TemporalFrame) -> DataFrame:
    """The interval as a one-row table ``n, unit``: the greatest common divisor of all distances
    between neighbouring observations of a series. No row if no series has two observations.

    Each task reduces its distances to one number, and a last task reduces those. A table of one series
    needs no order, hence no shuffle: distances to any one observation have the same divisor.
    """
    axis = tf.axis
    if tf.meta.key:
        df = L.neighbours(L.place(tf)).select((F.col(L.NEXT) - F.col(L.O)).alias("step"))
        partial = df.where(F.col("step") > 0).mapInArrow(_gcd, "at bigint, step bigint")
    else:
        partial = tf.df.select(axis.ordinal(F.col(tf.meta.index)).alias("at")).mapInArrow(_lattice, "at bigint, step bigint")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one row per task of the step before
        if not table.num_rows:
            return
        at = table.column("at").drop_null().to_numpy()
        steps = table.column("step").to_numpy()
        step = int(np.gcd.reduce(np.concatenate([steps, at - at[0]] if len(at) else [steps])))
        if step:
            found = axis.interval_of(step)
            yield pa.record_batch({"n": pa.array([found.n], pa.int64()), "unit": pa.array([found.unit])})

    return partial.repartition(1).mapInArrow(name, "n bigint, unit string")


def detect_interval(tf: TemporalFrame) -> Interval | None:
    """The detected interval; the single row of ``interval_of`` is all that reaches the driver."""
    row = interval_of(tf).first()
    return Interval(int(row["n"]), row["unit"]) if row else None


def describe(tf: TemporalFrame) -> DataFrame:
    """One row: rows, columns, interval, key and its size, groups and their size."""
    tf = tf.resolved()
    m = tf.meta
    by = [*m.groups, *([m.index_by[0]] if m.index_by else [])]
    count = lambda cols: F.count_distinct(F.struct(*cols)) if cols else F.lit(0).cast("bigint")
    return tf.df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.lit(1).cast("bigint") if not m.key else count(m.key)).alias("n_keys"),
        count(by).alias("n_groups"),
    ).select(
        "n_rows",
        F.lit(len(tf.df.columns)).alias("n_cols"),
        F.lit(m.interval.label if m.interval else "!").alias("interval"),
        F.lit(m.key_label).alias("key"),
        "n_keys",
        F.lit(m.group_label).alias("groups"),
        "n_groups",
    )

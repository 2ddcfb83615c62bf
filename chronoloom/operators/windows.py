"""Slide, tile and stretch: windows counted in observations, per series, from past to future.

* slide: overlapping windows of ``size`` rows ending at each row; null until ``size`` rows exist;
* tile: non-overlapping windows of ``size`` rows, one output row each, the last may be short;
* stretch: everything up to each row; null until ``init`` rows exist.

The full grid of names (one, two or many inputs; untyped or with a promised result type) is made from
one rule at the end of the module.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import moments as M
from ..functions.bodies import COMBINE, MOMENTS, Accumulator, Aggregate, Body, Fold, OnList, Opaque, resolve
from ..functions.calendar import Interval, Period
from . import distinct, folds
from . import layout as L
from .relational import spread_join

if TYPE_CHECKING:
    from ..frame import TemporalFrame

# Promised result types: the Spark type, and what may be turned into it without loss.
OUT_TYPES: dict[str, tuple[str, tuple[type, ...]]] = {
    "dbl": ("double", (T.NumericType, T.BooleanType)),
    "int": ("int", (T.IntegralType, T.BooleanType)),
    "lgl": ("boolean", (T.BooleanType,)),
    "chr": ("string", (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampNTZType)),
}

# Spark re-aggregates a sliding frame for every row; above this size windows are put together from runs.
WIDE = 64


@dataclass(frozen=True)
class WindowCall:
    kind: str
    columns: tuple[str, ...]
    body: Body
    size: int
    out_type: str | None = None
    partial: bool = False
    na_rm: bool = False

    @property
    def inputs(self) -> list[Column]:
        return [F.col(c) for c in self.columns]


def _known(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def _nullable(df: DataFrame, call: WindowCall) -> bool:
    return any(df.schema[c].nullable for c in call.columns)


def _typed(df: DataFrame, name: str, out_type: str | None) -> DataFrame:
    """Hold a result column to its promised type while the plan is built."""
    if out_type is None:
        return df
    target, allowed = OUT_TYPES[out_type]
    found = df.schema[name].dataType
    if not isinstance(found, (*allowed, T.NullType)):
        raise TypeError(f"{name}: a {found.simpleString()} result where *_{out_type} promises {target}")
    return df.withColumn(name, F.col(name).cast(target))


def _pluck(rows: Column, names: tuple[str, ...]) -> Column:
    """The wanted fields of an array of structs: bare values for one name, structs for several."""
    if len(names) == 1:
        return F.transform(rows, lambda r: r[names[0]])
    return F.transform(rows, lambda r: F.struct(*[r[n].alias(n) for n in names]))


def _window_list(inputs: list[Column], names: tuple[str, ...], spec) -> Column:
    """The window as an ordered array; nulls are kept, which a bare collect_list would drop."""
    rows = F.collect_list(F.struct(*[c.alias(n) for c, n in zip(inputs, names)])).over(spec)
    return _pluck(rows, names)


def _arrays(columns: tuple[pa.Array, ...]) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in columns]


def _grouped_udf(body: Opaque, wanted: int):
    """The opaque function as an aggregate over a frame; frames arrive as slices of one Arrow batch."""
    fn = body.fn

    def call(*columns: pa.Array) -> float:  # the hint only says "a scalar"; the type is body.returns
        return fn(*_arrays(columns)) if len(columns[0]) >= wanted else None

    return F.arrow_udf(call, body.returns)


def _list_udf(body: Opaque, names: tuple[str, ...]):
    """The opaque function over windows that were already collected into arrays."""
    fn, single, returns = body.fn, len(names) == 1, to_arrow_type(T.DataType.fromDDL(body.returns))

    def each(windows: pa.Array) -> pa.Array:
        def one(i: int):
            rows = windows[i].values
            return fn(*_arrays((rows,) if single else tuple(rows.field(n) for n in names)))

        out = [one(i) if windows[i].is_valid else None for i in range(len(windows))]
        return pa.array(out, type=returns)

    return F.arrow_udf(each, body.returns)


def apply_windows(tf: "TemporalFrame", calls: Mapping[str, WindowCall]) -> "TemporalFrame":
    kind = next(iter(calls.values())).kind
    counted = {n: c for n, c in calls.items() if distinct.is_distinct(c)}
    if counted and kind != "tile":
        rest = {n: c for n, c in calls.items() if n not in counted}
        kept = [c for c in tf.df.columns if c not in calls]
        held = {n: f"__counted{i}" for i, n in enumerate(counted)}  # a call may replace a column that another reads
        out = distinct.distinct_counts(tf, {held[n]: c for n, c in counted.items()})
        out = apply_windows(out, rest) if rest else out
        df = out.df.select(*kept, *[F.col(held.get(n, n)).alias(n) for n in calls])
        for name, call in counted.items():
            df = _typed(df, name, call.out_type)
        return out.with_(df.select(*kept, *calls))
    if kind == "slide":
        return _slide(tf, calls)
    if kind == "stretch":
        return _stretch(tf, calls)
    raise ValueError("a tile gives one row per tile: use tiles(...) instead of mutate(...)")


# -- slide ------------------------------------------------------------------------------------


def _slide(tf: "TemporalFrame", calls: Mapping[str, WindowCall]) -> "TemporalFrame":
    kept = [c for c in tf.df.columns if c not in calls]
    done = []
    folded = {n: c for n, c in calls.items() if folds.is_fold(c)}
    for df, by, order in L.reachable(tf, max(c.size for c in calls.values())):
        for name, call in calls.items():
            if name not in folded:
                df = _slide_column(df, by, order, name, call)
        if folded:
            df = folds.slide_answers(df, by, [L.P] if L.COPY in by else [L.O, *tf.ties], folded)
            for name, call in folded.items():
                df = _typed(df, name, call.out_type)
        done.append(L.own(df).select(*kept, *calls))
    return tf.with_(reduce(DataFrame.unionByName, done), costly=L.mode_of(tf) != "short" or tf.meta.costly)


def _slide_column(df: DataFrame, by: list[str], order: Column, name: str, call: WindowCall) -> DataFrame:
    n, body, cols = call.size, call.body, call.inputs
    ordered = Window.partitionBy(*by).orderBy(order)
    frame = ordered.rowsBetween(-(n - 1), 0)
    seen = F.row_number().over(ordered)
    if isinstance(body, Opaque):
        value = _grouped_udf(body, 1 if call.partial else n)(*cols).over(frame)
        return _typed(df.withColumn(name, value), name, call.out_type)
    if isinstance(body, OnList):
        value = body.fn(_window_list(cols, call.columns, frame))
    elif isinstance(body, Aggregate):
        value = body.value(cols, lambda a: a.over(frame))
    else:
        strict = body.strict and not call.na_rm and _nullable(df, call)
        known = F.when(_known(cols), 1).otherwise(0).cast("bigint")
        if body.native is not None and n <= WIDE:
            value, known = body.native(lambda a: a.over(frame), *cols), F.sum(known).over(frame)
        else:
            parts = {p: (part.value(cols, F.col(L.O)), part.combine) for p, part in body.parts.items()}
            parts |= {"__known": (known, "sum")} if strict else {}
            df, merged = _slide_parts(df, by, order, frame, f"__{name}", parts, n)
            value, known = body.finish(merged), merged.get("__known")
        if strict:
            value = F.when(known == F.least(seen, F.lit(n)), value)
    if not call.partial:
        value = F.when(seen >= n, value)
    return _typed(df.withColumn(name, value), name, call.out_type)


_MERGE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    **{c: lambda a, b, products=p: M.merge(a, b, products) for c, p in MOMENTS.items()},
}


def _slide_parts(
    df: DataFrame, by: list[str], order: Column, frame, prefix: str, parts: Mapping[str, tuple[Column, str]], n: int
) -> tuple[DataFrame, dict[str, Column]]:
    """The parts of a slide, combined over the window.

    A wide window costs the same per row as a narrow one: rows are counted off in runs of ``n``, so a
    window is the tail of one run and the head of the next. Heads and tails are running aggregates, and
    nothing is subtracted, so this is exact for sums, minima and maxima of any type.
    """
    df = df.withColumns({f"{prefix}_{p}": value for p, (value, _) in parts.items()})
    wide = {f"{prefix}_{p}": c for p, (_, c) in parts.items() if n > WIDE and c in _MERGE}
    out = {p: L._over(f"{prefix}_{p}", c, frame) for p, (_, c) in parts.items() if f"{prefix}_{p}" not in wide}
    if not wide:
        return df, out
    ordered = Window.partitionBy(*by).orderBy(order)
    at, run = f"{prefix}_at", f"{prefix}_run"
    df = df.withColumn(at, F.row_number().over(ordered) - 1).withColumn(run, L.floordiv(F.col(at), n))
    upto = (Window.unboundedPreceding, 0)
    head = Window.partitionBy(*by, run).orderBy(order).rowsBetween(*upto)
    tail = Window.partitionBy(*by, run).orderBy(order.desc()).rowsBetween(*upto)
    df = df.withColumns({f"{v}_tail": L._over(v, c, tail) for v, c in wide.items()})
    df = df.withColumns({f"{v}_head": L._over(v, c, head) for v, c in wide.items()})
    df = df.withColumns({f"{v}_tail": F.lag(f"{v}_tail", n - 1).over(ordered) for v in wide})
    # The first windows, and those that are a whole run, are covered by their head alone.
    alone = (F.col(at) < n) | (F.pmod(F.col(at), F.lit(n)) == n - 1)
    for p, (_, c) in parts.items():
        v = f"{prefix}_{p}"
        if v in wide:
            both = _MERGE[c](F.col(f"{v}_tail"), F.col(f"{v}_head"))
            out[p] = F.when(alone, F.col(f"{v}_head")).otherwise(both)
    return df, out


def _ties(tf: "TemporalFrame") -> list[Column]:
    """The columns that order observations of one instant, under names of their own."""
    return [F.col(c).alias(f"__t{i}") for i, c in enumerate(tf.ties)]


# -- stretch ----------------------------------------------------------------------------------


def _stretch(tf: "TemporalFrame", calls: Mapping[str, WindowCall]) -> "TemporalFrame":
    placed = L.place(tf)
    parts: dict[str, tuple[Column, str]] = {"__seen": (F.lit(1).cast("bigint"), "sum")}
    finish: dict[str, Column] = {}
    whole: dict[str, WindowCall] = {}
    walked = {n: c for n, c in calls.items() if folds.is_fold(c) or folds.is_opaque(c)}
    for i, (name, call) in enumerate(calls.items()):
        body = call.body
        if isinstance(body, Aggregate):
            whole[name] = call
            continue
        if name in walked:
            continue
        if isinstance(body, OnList):
            row = F.struct(F.col(L.O).alias("__o"), *_ties(tf), *[c.alias(n) for c, n in zip(call.inputs, call.columns)])
            parts[f"__{i}_list"] = (F.array(row), "concat")
            finish[name] = body.fn(_pluck(F.col(f"__{i}_list"), call.columns))
            continue
        for p, part in body.parts.items():
            parts[f"__{i}_{p}"] = (part.value(call.inputs, F.col(L.O)), part.combine)
        value = body.finish({p: F.col(f"__{i}_{p}") for p in body.parts})
        if body.strict and not call.na_rm and _nullable(tf.df, call):
            parts[f"__{i}_known"] = (F.when(_known(call.inputs), 1).otherwise(0).cast("bigint"), "sum")
            value = F.when(F.col(f"__{i}_known") == F.col("__seen"), value)
        finish[name] = value
    df = L.running(placed, parts) if len(walked) < len(calls) else placed.df
    for test, walk in ((folds.is_fold, folds.stretch_answers), (folds.is_opaque, folds.opaque_stretch)):
        chosen = {n: c for n, c in calls.items() if test(c)}
        if chosen:
            df = walk(dataclasses.replace(placed, df=df), chosen)
    if whole:
        # A Spark aggregate can't be carried from block to block: its series is followed in one task. A fold can.
        spec = Window.partitionBy(*placed.key).orderBy(placed.order).rowsBetween(Window.unboundedPreceding, 0)
        finish |= {name: call.body.value(call.inputs, lambda a: a.over(spec)) for name, call in whole.items()}
    for name, call in calls.items():
        if name in walked:
            df = _typed(df, name, call.out_type)
            continue
        value = finish[name]
        if not call.partial:
            value = F.when(F.col("__seen") >= call.size, value)
        df = _typed(df.withColumn(name, value), name, call.out_type)
    kept = [c for c in tf.df.columns if c not in calls]
    return tf.with_(df.select(*kept, *calls), costly=placed.blocked or tf.meta.costly)


# -- tile -------------------------------------------------------------------------------------


def _tile_value(df: DataFrame, call: WindowCall) -> Column:
    body, cols = call.body, call.inputs
    if isinstance(body, (OnList, Opaque)):
        rows = F.array_sort(F.collect_list(F.struct(F.col(L.P), *[c.alias(n) for c, n in zip(cols, call.columns)])))
        windows = _pluck(rows, call.columns)
        return windows if isinstance(body, Opaque) else body.fn(windows)
    if isinstance(body, Aggregate):
        return body.value(cols, lambda a: a)
    if body.native is not None:
        value = body.native(lambda a: a, *cols)
    else:
        value = body.finish(
            {p: COMBINE[part.combine](part.value(cols, F.col(L.O))) for p, part in body.parts.items()}
        )
    if body.strict and not call.na_rm and _nullable(df, call):
        value = F.when(F.count(F.when(_known(cols), 1)) == F.count(F.lit(1)), value)
    return value


def tiles(tf: "TemporalFrame", **calls: WindowCall) -> "TemporalFrame":
    """One row per tile: key, tile number, first index of the tile and the computed columns."""
    sizes = {c.size for c in calls.values()}
    if len(sizes) != 1 or any(c.kind != "tile" for c in calls.values()):
        raise ValueError("tiles takes tile calls of one common size")
    (n,) = sizes
    m = tf.meta
    placed = L.positions(tf)
    df = placed.df.withColumn("tile", L.floordiv(F.col(L.P), n) + 1)
    folded = {name: call for name, call in calls.items() if folds.is_fold(call)}
    plain = {name: call for name, call in calls.items() if name not in folded}
    by = [*m.key, "tile"]
    out = df.groupBy(*by).agg(F.min(m.index).alias(m.index), *[_tile_value(df, call).alias(name) for name, call in plain.items()])
    if folded:
        states = folds.group_states(df, by, placed.sort, folded).withColumnsRenamed({c: f"__r_{c}" for c in by})
        out = out.join(states, [out[c].eqNullSafe(states[f"__r_{c}"]) for c in by])
        answers = {name: folds.finished(F.array(F.col(folds.STATE)), folded, name) for name in folded}
        out = out.withColumns(answers).select(*by, m.index, *calls)
    for name, call in calls.items():
        if isinstance(call.body, Opaque):
            out = out.withColumn(name, _list_udf(call.body, call.columns)(F.col(name)))
        out = _typed(out, name, call.out_type)
    return tf.with_(
        out, interval=None, groups=(), index_by=None, dense=False, shared_span=False, costly=placed.blocked
    )


# -- window lists -----------------------------------------------------------------------------


def slider(tf: "TemporalFrame", size: int) -> DataFrame:
    """Extents of the full sliding windows: key, window_id, xmin, xmax."""
    m = tf.meta
    placed = L.positions(tf)
    df, by = L.halo(placed, size) if placed.blocked else (placed.df, placed.by)
    first = F.lag(m.index, size - 1).over(Window.partitionBy(*by).orderBy(L.P if placed.blocked else placed.order))
    df = L.own(df.withColumn("xmin", first)).where(F.col(L.P) >= size - 1)
    return df.select(*m.key, (F.col(L.P) - (size - 2)).alias("window_id"), "xmin", F.col(m.index).alias("xmax"))


def tiler(tf: "TemporalFrame", size: int) -> DataFrame:
    """Extents of the tiles: key, window_id, xmin, xmax, n."""
    m = tf.meta
    df = L.positions(tf).df.withColumn("window_id", L.floordiv(F.col(L.P), size) + 1)
    return df.groupBy(*m.key, "window_id").agg(
        F.min(m.index).alias("xmin"), F.max(m.index).alias("xmax"), F.count(F.lit(1)).alias("n")
    )


def stretcher(tf: "TemporalFrame", init: int = 1) -> DataFrame:
    """Extents of the expanding windows that hold at least ``init`` rows."""
    m = tf.meta
    parts = {L.P: (F.lit(1).cast("bigint"), "sum"), "xmin": (F.col(m.index), "min")}
    df = L.running(L.place(tf), parts).where(F.col(L.P) >= init)
    return df.select(*m.key, (F.col(L.P) - (init - 1)).alias("window_id"), "xmin", F.col(m.index).alias("xmax"))


# -- calendar-flexible slide --------------------------------------------------------------------


def slide_period(
    tf: "TemporalFrame", period: Period, name: str, size: int, partial: bool, **calls: WindowCall
) -> "TemporalFrame":
    """Slide over ``size`` calendar periods, however many rows each holds, and hand the answer back to
    every row of the last period. Periods without rows aren't counted.

    The answer is taken over all rows of the periods, so a mean is weighted by rows. Named functions,
    Accumulators and folds first reduce each period to its parts or state, and no window holds the rows. For
    any other body each row is sent to the ``size`` windows it is in and the window is one group: a lambda
    is a partial-aggregated group-by, ``opaque`` and ``on_list`` get the rows of the window in order.
    """
    m = tf.meta
    if any(c.size != 1 or c.partial for c in calls.values()):
        raise ValueError("slide_period has its own size and partial: leave them out of the calls")
    data = tf.df.withColumn(name, period.column()).withColumn(L.O, tf.axis.ordinal(F.col(m.index)))
    by = [*m.key, name]
    kinds = {
        _period_parts: {n: c for n, c in calls.items() if isinstance(c.body, Accumulator)},
        _period_states: {n: c for n, c in calls.items() if isinstance(c.body, Fold)},
        _period_rows: {n: c for n, c in calls.items() if not isinstance(c.body, (Accumulator, Fold))},
    }
    back = None
    for run, chosen in kinds.items():
        if not chosen:
            continue
        found = run(tf, data, period, name, size, partial, chosen).select(*by, *chosen)
        if back is None:
            back = found
        else:
            found = found.withColumnsRenamed({c: f"__f_{c}" for c in by})
            back = back.join(found, [back[c].eqNullSafe(found[f"__f_{c}"]) for c in by], "left").select(*back.columns, *chosen)
    for label, call in calls.items():
        back = _typed(back, label, call.out_type)
    names = {k: f"__r_{k}" for k in by}
    back = back.select(*[F.col(k).alias(r) for k, r in names.items()], *calls)
    rows = data.drop(L.O)
    kept = [c for c in rows.columns if c not in calls]
    rows = rows.select(*kept)
    if m.key:
        same = [rows[k].eqNullSafe(back[r]) for k, r in names.items()]
        joined = rows.join(back, same, "inner")
    else:  # a period may hold a large part of the table
        joined = spread_join(rows, back, names, [m.index])
    return tf.with_(joined.select(*kept, *calls))


def _of_periods(tf: "TemporalFrame", per: DataFrame, period: Period, name: str) -> "TemporalFrame":
    """A table with one row per series and period, as a temporal table whose index is the period."""
    from ..frame import TemporalFrame

    meta = dataclasses.replace(
        tf.meta, index=name, nesting=(), interval=Interval(0, period.unit), groups=(), index_by=None, dense=False, shared_span=False
    )
    return TemporalFrame(per, meta)


def _period_parts(tf, data: DataFrame, period: Period, name: str, size: int, partial: bool, calls) -> DataFrame:
    """Accumulators: parts of each period, combined over the window."""
    parts, values = {}, {}
    for i, call in enumerate(calls.values()):
        for p, part in call.body.parts.items():
            values[f"__{i}_{p}"] = part.value(call.inputs, F.col(L.O))
            parts[f"__{i}_{p}"] = part.combine
        values[f"__{i}_known"] = F.when(_known(call.inputs), 1).otherwise(0).cast("bigint")
        values[f"__{i}_all"] = F.lit(1).cast("bigint")
        parts |= {f"__{i}_known": "sum", f"__{i}_all": "sum"}
    per = data.withColumns(values).groupBy(*tf.meta.key, name).agg(*[L._merge(v, c).alias(v) for v, c in parts.items()])

    def slid(combine: str) -> Body:
        if combine in MOMENTS:
            return OnList(lambda groups: M.folded(groups, MOMENTS[combine]))
        return Aggregate(COMBINE[combine])

    frame = _of_periods(tf, per, period, name)
    merged = frame.mutate(**{v: WindowCall("slide", (v,), slid(c), size, partial=partial) for v, c in parts.items()}).df
    for i, (label, call) in enumerate(calls.items()):
        value = call.body.finish({p: F.col(f"__{i}_{p}") for p in call.body.parts})
        if call.body.strict and not call.na_rm:
            value = F.when(F.col(f"__{i}_known") == F.col(f"__{i}_all"), value)
        merged = merged.withColumn(label, value)
    return merged


def _period_states(tf, data: DataFrame, period: Period, name: str, size: int, partial: bool, calls) -> DataFrame:
    """Folds: a state for each period, or for each block of one where a series is hot, merged in order."""
    placed = L.place(tf)
    df, by = placed.df.withColumn(name, period.column()), [*tf.meta.key, name]
    if placed.blocked:
        states = folds.group_states(df, [*by, L.C], placed.sort, calls)
        states = folds.merged_states(states, by, [L.C], calls)
    else:
        states = folds.group_states(df, by, placed.sort, calls)
    window = WindowCall("slide", (folds.STATE,), OnList(), size, partial=partial)
    out = _of_periods(tf, states, period, name).mutate(__states=window).df
    return out.withColumns({label: folds.finished(F.col("__states"), calls, label) for label in calls})


def _period_rows(tf, data: DataFrame, period: Period, name: str, size: int, partial: bool, calls) -> DataFrame:
    """Any other body: rows meet in every window that they are in.

    Which periods a window has is found on the small table of periods; only then rows are sent there, dealt
    over parts of each period, since one may hold a third of the table.
    """
    key = list(tf.meta.key)
    periods = _of_periods(tf, data.select(*key, name).distinct(), period, name)
    ends = periods.mutate(__in=WindowCall("slide", (name,), OnList(), size, partial=partial)).df
    link = ends.select(*[F.col(k).alias(f"__l_{k}") for k in key], F.col(name).alias("__end"), F.explode("__in").alias("__l_in"))
    inputs = list(dict.fromkeys(c for call in calls.values() for c in call.columns if c not in key))
    rows = data.select(*key, F.col(name).alias("__in"), L.O, *_ties(tf), *[F.col(c).alias(f"__v_{c}") for c in inputs])
    sent = spread_join(rows, link, {k: f"__l_{k}" for k in key} | {"__in": "__l_in"}, [L.O])
    value = lambda call: [F.col(c) if c in key else F.col(f"__v_{c}") for c in call.columns]
    windows = {n: c for n, c in calls.items() if not isinstance(c.body, Opaque)}
    aggregates, ties = [], [f"__t{i}" for i in range(len(tf.ties))]
    for label, call in windows.items():
        if isinstance(call.body, OnList):
            held = F.struct(F.col(L.O), *ties, *[v.alias(c) for v, c in zip(value(call), call.columns)])
            aggregates.append(call.body.fn(_pluck(F.array_sort(F.collect_list(held)), call.columns)).alias(label))
        else:
            aggregates.append(call.body.value(value(call), lambda a: a).alias(label))
    out = ends.select(*key, name)
    if aggregates:
        found = sent.groupBy(*key, "__end").agg(*aggregates)
        out = _attached(out, found, key, name, list(windows))
    opaque = {n: c for n, c in calls.items() if n not in windows}
    if opaque:
        whole = {n: dataclasses.replace(c, columns=tuple(c if c in key else f"__v_{c}" for c in c.columns), body=_whole(c.body)) for n, c in opaque.items()}
        states = folds.group_states(sent, [*key, "__end"], [L.O, *ties], whole)
        states = states.withColumns({n: folds.finished(F.array(F.col(folds.STATE)), whole, n) for n in whole})
        out = _attached(out, states, key, name, list(opaque))
    return out


def _whole(body: Opaque) -> Fold:
    """An opaque function as a fold: the pieces of the window, put together when it is called."""
    join = lambda pieces: [np.concatenate(c) for c in zip(*pieces, strict=True)]
    return Fold(
        list, lambda s, *x: [*s, list(x)], lambda a, b: [*a, *b], lambda s, fn=body.fn: fn(*join(s)), body.returns
    )


def _attached(out: DataFrame, found: DataFrame, key: list[str], name: str, columns: list[str]) -> DataFrame:
    """Answers by key and last period, joined to the periods; one without a full window has none."""
    found = found.select(*[F.col(k).alias(f"__a_{k}") for k in key], F.col("__end").alias("__a_end"), *columns)
    same = [out[k].eqNullSafe(found[f"__a_{k}"]) for k in key] + [out[name].eqNullSafe(found["__a_end"])]
    return out.join(found, same, "left").select(*out.columns, *columns)


# -- the family of names ------------------------------------------------------------------------


def _call(kind: str, many: str, out_type: str | None):
    def build(*args, fn=None, size: int | None = None, init: int | None = None, partial=False, na_rm=False):
        columns, rest = list(args), None
        if many == "p":
            columns, rest = list(args[0]), args[1:]
        else:
            wanted = 2 if many == "2" else 1
            columns, rest = list(args[:wanted]), args[wanted:]
            if len(columns) != wanted:
                raise TypeError(f"{kind}{many} takes {wanted} input column(s)")
        if len(rest) > 1 or (rest and fn is not None):
            raise TypeError("give one window function")
        body = resolve(rest[0] if rest else fn)
        width = init if kind == "stretch" else size
        if (size if kind == "stretch" else init) is not None:
            raise TypeError("size belongs to slide and tile, init to stretch")
        width = 1 if width is None else width
        if width < 1:
            raise ValueError("a window holds at least one row")
        return WindowCall(kind, tuple(columns), body, width, out_type, partial, na_rm)

    suffix = f"_{out_type}" if out_type else ""
    build.__name__ = build.__qualname__ = f"{'p' if many == 'p' else ''}{kind}{'2' if many == '2' else ''}{suffix}"
    build.__doc__ = f"{kind} over {'two columns' if many == '2' else 'a list of columns' if many == 'p' else 'a column'}."
    return build


FAMILY = {
    f.__name__: f
    for kind in ("slide", "tile", "stretch")
    for many in ("", "2", "p")
    for out_type in (None, *OUT_TYPES)
    for f in (_call(kind, many, out_type),)
}
globals().update(FAMILY)

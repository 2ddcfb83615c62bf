"""Folds: window bodies given as Python functions init, update, merge, finish, run on sorted Arrow slices.

Rows are shuffled once to the partition of their group and sorted there; a task then walks through them with
one state per group, so its memory doesn't grow with the group. Where a series is cut into blocks, each block
is folded by itself, the states of the blocks before each are merged by an exclusive scan, and the result
rides into the block as a marker row. States travel pickled.

Every function walks rows of a DataFrame that it shuffles and sorts itself. ``by`` are the columns of a
group, ``order`` those that sort it; group columns are compared value by value, nulls alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.bodies import Fold, Opaque
from . import layout as L

if TYPE_CHECKING:
    from .windows import WindowCall

STATE = "__state"


def _sorted(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    shuffled = df.repartition(*by) if by else df.repartition(1)
    return shuffled.sortWithinPartitions(*by, *order)


def _starts(batch: pa.RecordBatch, by: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Where a new group begins; ``last`` is the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = last is None
    for c in by:
        here = batch.column(c)
        before = here.slice(0, len(here) - 1)
        before = pa.concat_arrays([last.column(c) if last is not None else here.slice(0, 1), before])
        differ = pc.fill_null(pc.not_equal(here, before), False)
        nulls = pc.not_equal(pc.is_null(here), pc.is_null(before))
        new |= pc.or_(differ, nulls).to_numpy(zero_copy_only=False)
    return new


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]):
    """Stretches of rows of one group: (batch, from, to, whether the group begins here)."""
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = _starts(batch, by, last)
        cuts = sorted({0, *np.flatnonzero(new).tolist(), batch.num_rows})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch, a, b, bool(new[a])
        last = batch.slice(batch.num_rows - 1)


def _inputs(batch: pa.RecordBatch, columns: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _field(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in names]


# -- one state per group ----------------------------------------------------------------------------


def group_states(df: DataFrame, by: list[str], order: list[str], calls: dict[str, "WindowCall"]) -> DataFrame:
    """One row per group: the group and the pickled states of all calls, each folded in order."""
    columns = list(dict.fromkeys(c for call in calls.values() for c in call.columns))
    folds = [(call.body, call.columns) for call in calls.values()]

    def walk(batches: Iterator[pa.RecordBatch]):
        held = None  # the group's row and its states

        def row():
            values = [*held[0].select(by).columns, pa.array([pickle.dumps(held[1])], pa.binary())]
            return pa.RecordBatch.from_arrays(values, [*by, STATE])

        for batch, a, b, new in _groups(batches, by):
            if new:
                if held is not None:
                    yield row()
                held = (batch.slice(a, 1), [f.init() for f, _ in folds])
            part = batch.slice(a, b - a)
            held = (held[0], [f.update(s, *_inputs(part, cols)) for s, (f, cols) in zip(held[1], folds, strict=True)])
        if held is not None:
            yield row()

    narrow = df.select(*by, *[c for c in order if c not in by], *[c for c in columns if c not in (*by, *order)])
    schema = T.StructType([*_field(df, by), T.StructField(STATE, T.BinaryType())])
    return _sorted(narrow, by, order).mapInArrow(walk, schema)


def _walk_states(df: DataFrame, by: list[str], order: list[str], calls: dict[str, "WindowCall"], before: bool) -> DataFrame:
    folds = [call.body for call in calls.values()]

    def walk(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch, a, b, new in _groups(batches, by):
            rows = batch.slice(a, b - a)
            out = []
            for state in rows.column(STATE).to_pylist():
                if new:
                    if held is not None and not before:
                        yield held[0]([pickle.dumps(held[1])])
                    first = rows.slice(0, 1)
                    keep = lambda s, first=first: pa.RecordBatch.from_arrays(
                        [*first.select(by).columns, pa.array(s, pa.binary())], [*by, STATE]
                    )
                    held, new = (keep, [f.init() for f in folds]), False
                out.append(pickle.dumps(held[1]))
                held = (held[0], [f.merge(s, t) for f, s, t in zip(folds, held[1], pickle.loads(state), strict=True)])
            if before:
                yield pa.RecordBatch.from_arrays(
                    [*rows.select([*by, *order]).columns, pa.array(out, pa.binary())], [*by, *order, STATE]
                )
        if held is not None and not before:
            yield held[0]([pickle.dumps(held[1])])

    kept = [*by, *order] if before else by
    return _sorted(df.select(*by, *order, STATE), by, order).mapInArrow(
        walk, T.StructType([*_field(df, kept), T.StructField(STATE, T.BinaryType())])
    )


def merged_states(df: DataFrame, by: list[str], order: list[str], calls: dict[str, "WindowCall"]) -> DataFrame:
    """One row per group: its states merged in order."""
    return _walk_states(df, by, order, calls, False)


def states_before(df: DataFrame, by: list[str], order: list[str], calls: dict[str, "WindowCall"]) -> DataFrame:
    """For every row of states, those of the rows before it in its group, merged (an exclusive scan)."""
    return _walk_states(df, by, order, calls, True)


def finished(states: Column, calls: dict[str, "WindowCall"], name: str) -> Column:
    """The answer of one call from an ordered array of state rows; null for a null array."""
    at, body = list(calls).index(name), calls[name].body
    returns = to_arrow_type(T.DataType.fromDDL(body.returns))

    def each(windows: pa.Array) -> pa.Array:
        out = []
        for rows in windows.to_pylist():
            if rows is None:
                out.append(None)
                continue
            state = body.init()
            for r in rows:
                state = body.merge(state, pickle.loads(r)[at])
            out.append(body.finish(state))
        return pa.array(out, type=returns)

    return F.arrow_udf(each, body.returns)(states)


# -- an answer per row ------------------------------------------------------------------------------


class _Queue:
    """The last ``size`` rows as two stacks of states: a push, a pop and an answer cost a constant number of
    merges on average, whatever the size."""

    def __init__(self, fold: Fold, size: int):
        self.fold, self.size = fold, size
        self.front: list[object] = []  # merged with all that came after, newest at the bottom
        self.back: list[object] = []
        self.sum = fold.init()

    def push(self, state: object) -> None:
        self.back.append(state)
        self.sum = self.fold.merge(self.sum, state)
        if len(self.front) + len(self.back) > self.size:
            if not self.front:
                total = None
                for s in reversed(self.back):
                    total = s if total is None else self.fold.merge(s, total)
                    self.front.append(total)
                self.back, self.sum = [], self.fold.init()
            self.front.pop()

    def answer(self) -> object:
        return self.fold.finish(self.fold.merge(self.front[-1], self.sum) if self.front else self.sum)

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


class _Slide:
    def __init__(self, call: "WindowCall"):
        self.call, self.queue = call, _Queue(call.body, call.size)

    def rows(self, inputs: list[np.ndarray]) -> list[object]:
        fold, out, least = self.call.body, [], 1 if self.call.partial else self.call.size
        for i in range(len(inputs[0])):
            self.queue.push(fold.update(fold.init(), *[x[i : i + 1] for x in inputs]))
            out.append(self.queue.answer() if len(self.queue) >= least else None)
        return out

    def carry(self, seen: int, state: object) -> None:
        raise AssertionError("a slide has no marker rows")


class _Stretch:
    def __init__(self, call: "WindowCall"):
        self.call, self.seen, self.state = call, 0, call.body.init()

    def rows(self, inputs: list[np.ndarray]) -> list[object]:
        fold, out, least = self.call.body, [], 1 if self.call.partial else self.call.size
        for i in range(len(inputs[0])):
            self.state, self.seen = fold.update(self.state, *[x[i : i + 1] for x in inputs]), self.seen + 1
            out.append(fold.finish(self.state) if self.seen >= least else None)
        return out

    def carry(self, seen: int, state: object) -> None:
        self.seen, self.state = seen, state


class _Growing:
    """All rows up to each, for a function that wants them whole: one array, which doubles when it is full."""

    def __init__(self, call: "WindowCall"):
        self.call, self.n, self.held = call, 0, None

    def rows(self, inputs: list[np.ndarray]) -> list[object]:
        if self.held is None:
            self.held = [np.empty(max(64, len(x)), x.dtype) for x in inputs]
        for k, x in enumerate(inputs):
            kind = np.promote_types(self.held[k].dtype, x.dtype) if x.dtype != object else np.dtype(object)
            if self.n + len(x) > len(self.held[k]) or kind != self.held[k].dtype:
                grown = np.empty(max(2 * len(self.held[k]), self.n + len(x)), kind)
                grown[: self.n] = self.held[k][: self.n]
                self.held[k] = grown
            self.held[k][self.n : self.n + len(x)] = x
        out, least = [], 1 if self.call.partial else self.call.size
        for _ in range(len(inputs[0])):
            self.n += 1
            out.append(self.call.body.fn(*[h[: self.n] for h in self.held]) if self.n >= least else None)
        return out

    def carry(self, seen: int, state: object) -> None:
        raise AssertionError("an opaque function has no state")


def answers(df: DataFrame, by: list[str], order: list[str], calls: dict[str, "WindowCall"], make: Callable) -> DataFrame:
    """Add one column per call, walking each group in order.

    Rows in which ``STATE`` isn't null (if there is such a column) set the state of their group and pass on.
    """
    held = {n: f"__in_{n}" for n in calls if n in df.columns}  # an answer may replace its own input
    df = df.withColumnsRenamed(held)
    calls = {n: replace(c, columns=tuple(held.get(x, x) for x in c.columns)) for n, c in calls.items()}
    names = list(calls)
    types = [to_arrow_type(T.DataType.fromDDL(calls[n].body.returns)) for n in names]
    marked = STATE in df.columns

    def walk(batches: Iterator[pa.RecordBatch]):
        work: list = []
        for batch, a, b, new in _groups(batches, by):
            if new:
                work = [make(calls[n]) for n in names]
            part = batch.slice(a, b - a)
            if marked and part.column(STATE)[0].is_valid:
                seen, *states = pickle.loads(part.column(STATE)[0].as_py())
                for w, s in zip(work, states, strict=True):
                    w.carry(seen, s)
                part = part.slice(1)
                if part.num_rows == 0:
                    continue
            columns = [pa.array(w.rows(_inputs(part, w.call.columns)), t) for w, t in zip(work, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    fields = [*df.schema.fields, *[T.StructField(n, T.DataType.fromDDL(calls[n].body.returns)) for n in names]]
    return _sorted(df, by, order).mapInArrow(walk, T.StructType(fields)).drop(*held.values())


def slide_answers(df: DataFrame, by: list[str], order: list[str], calls: dict[str, "WindowCall"]) -> DataFrame:
    """Answers over the last rows of each; a row costs as many merges in a wide window as in a narrow one."""
    return answers(df, by, order, calls, _Slide)


def stretch_answers(placed: L.Placed, calls: dict[str, "WindowCall"]) -> DataFrame:
    """Answers over everything up to each row. Blocks get the state before them as a marker row."""
    by, order = placed.by, placed.sort
    if not placed.blocked:
        return answers(placed.df, by, order, calls, _Stretch)
    hot = placed.df.where(F.col(L.HOT))
    # The number of rows goes with the states: a null answer ends where enough of them have been seen.
    counted = {"__seen": _counting(next(iter(calls.values())))} | calls
    states = group_states(hot, by, order, counted)
    marks = states_before(states, list(placed.key), [L.C], counted).withColumn(L.MARK, F.lit(0))
    df = placed.df.withColumn(L.MARK, F.lit(1)).unionByName(marks, allowMissingColumns=True)
    return answers(df, by, [L.MARK, *placed.sort], calls, _Stretch).drop(L.MARK, STATE)


def _counting(call: "WindowCall") -> "WindowCall":
    from .windows import WindowCall

    count = Fold(int, lambda s, *x: s + len(x[0]), lambda a, b: a + b, lambda s: s, "bigint")
    return WindowCall("stretch", call.columns, count, 1)


def opaque_stretch(placed: L.Placed, calls: dict[str, "WindowCall"]) -> DataFrame:
    """Opaque functions over everything up to each row: a series is held once, not once for each of its rows."""
    return answers(placed.df, list(placed.key), placed.sort, calls, _Growing)


def is_fold(call: "WindowCall") -> bool:
    return isinstance(call.body, Fold)


def is_opaque(call: "WindowCall") -> bool:
    return isinstance(call.body, Opaque)

"""What to compute inside a window: named functions, lambdas and opaque Python functions.

An ``Accumulator`` is the form that scales. It is a handful of per-row *parts* that are combined with
sum, min, max, merged moments or list concatenation, and a ``finish`` expression over the combined parts. Because the
combination is associative, a long series can be cut into blocks, each block reduced to one row, and
the answer rebuilt per row from the block totals before it. The other forms are:

* ``aggregate(fn)`` or a bare lambda: columns in, one Spark aggregate out. A lambda of several aggregates,
  or of a row of them, takes a second argument ``over`` and wraps each:
  ``lambda c, over: over(F.max(c)) - over(F.min(c))``;
* ``"n_distinct"``: distinct values, which Spark cannot count over a window;
* ``on_list(fn)``: the window as an ordered array column in, any column expression out;
* ``opaque(fn)``: a Python function of numpy arrays, sent over Arrow;
* ``fold(init, update, merge, finish)``: a Python aggregate that scales like an ``Accumulator``. ``update`` takes
  a state and numpy slices of rows in order, ``merge`` the states of two neighbouring runs of rows.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import moments as M

#: Combines that merge count, means and products instead of adding.
MOMENTS = {"moments": M.ONE, "moments2": M.TWO}

COMBINE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "concat": lambda c: F.flatten(F.collect_list(c)),
    "moments": lambda c: M.measured(c, M.ONE),
    "moments2": lambda c: M.measured(c, M.TWO),
}


@dataclass(frozen=True)
class Part:
    """One associative piece: ``value(inputs, ordinal)`` per row, merged by ``combine``."""

    value: Callable[[list[Column], Column], Column]
    combine: str


@dataclass(frozen=True)
class Accumulator:
    parts: Mapping[str, Part]
    finish: Callable[[Mapping[str, Column]], Column]
    native: Callable[..., Column] | None = None  # (over, *inputs): aggregates wrapped in ``over``
    strict: bool = True


@dataclass(frozen=True)
class Aggregate:
    fn: Callable[..., Column]

    def value(self, cols: list[Column], over: Callable[[Column], Column]) -> Column:
        """The aggregate of the columns, each of its parts wrapped in ``over``."""
        if "over" in inspect.signature(self.fn).parameters:
            return self.fn(*cols, over=over)
        return over(self.fn(*cols))


@dataclass(frozen=True)
class Distinct(Aggregate):
    """Number of distinct values or rows of values, exact; a null is a value."""

    fn: Callable[..., Column] = field(default=lambda *cols: F.count_distinct(F.struct(*cols)))


@dataclass(frozen=True)
class OnList:
    fn: Callable[[Column], Column] = field(default=lambda a: a)


@dataclass(frozen=True)
class Opaque:
    fn: Callable[..., object]
    returns: str = "double"


@dataclass(frozen=True)
class Fold:
    """``update`` may change the state it is given; ``merge`` and ``finish`` leave theirs as they are."""

    init: Callable[[], object]
    update: Callable[..., object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object]
    returns: str = "double"


def aggregate(fn: Callable[..., Column]) -> Aggregate:
    return Aggregate(fn)


def on_list(fn: Callable[[Column], Column] = lambda a: a) -> OnList:
    return OnList(fn)


def opaque(fn: Callable[..., object], returns: str = "double") -> Opaque:
    return Opaque(fn, returns)


def fold(
    init: Callable[[], object],
    update: Callable[..., object],
    merge: Callable[[object, object], object],
    finish: Callable[[object], object] = lambda state: state,
    returns: str = "double",
) -> Fold:
    return Fold(init, update, merge, finish, returns)


def _known(cols: list[Column]) -> Column:
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return known


def _count_known(cols: list[Column], _o: Column) -> Column:
    return F.when(_known(cols), 1).otherwise(0).cast("bigint")


def _x(cols: list[Column], _o: Column) -> Column:
    return cols[0]


def _at(cols: list[Column], o: Column) -> Column:
    return F.struct(o.alias("o"), cols[0].alias("x"))


_OK = Part(_count_known, "sum")


def _plain(aggregate_fn: Callable[..., Column]) -> Callable[..., Column]:
    return lambda over, *cols: over(aggregate_fn(*cols))


def _native_mean(over: Callable[[Column], Column], x: Column) -> Column:
    """As the parts give it, so that a mean has one type at any size."""
    return over(F.sum(x)).cast("double") / over(F.count(x))


def _of_moments(products: tuple[str, ...], finish: Callable[[Column], Column]) -> Accumulator:
    combine = next(c for c, p in MOMENTS.items() if p == products)
    return Accumulator({"m": Part(lambda cols, o: M.row(cols, products), combine)}, lambda p: finish(p["m"]))


NAMED: dict[str, Accumulator] = {
    "sum": Accumulator({"s": Part(_x, "sum")}, lambda p: p["s"], _plain(F.sum)),
    "mean": Accumulator(
        {"ok": _OK, "s": Part(_x, "sum")}, lambda p: F.when(p["ok"] > 0, p["s"].cast("double") / p["ok"]), _native_mean
    ),
    "min": Accumulator({"m": Part(_x, "min")}, lambda p: p["m"], _plain(F.min)),
    "max": Accumulator({"m": Part(_x, "max")}, lambda p: p["m"], _plain(F.max)),
    "length": Accumulator(
        {"n": Part(lambda cols, o: F.lit(1).cast("bigint"), "sum")},
        lambda p: p["n"],
        lambda over, *cols: over(F.count(F.lit(1))),
        strict=False,
    ),
    "first": Accumulator({"e": Part(_at, "min")}, lambda p: p["e"]["x"], strict=False),
    "last": Accumulator({"e": Part(_at, "max")}, lambda p: p["e"]["x"], strict=False),
    "any": Accumulator(
        {"t": Part(lambda cols, o: F.coalesce(cols[0], F.lit(False)), "max"), "u": Part(lambda cols, o: cols[0].isNull(), "max")},
        lambda p: F.when(p["t"], True).when(~p["u"], False),
        strict=False,
    ),
    "all": Accumulator(
        {"t": Part(lambda cols, o: F.coalesce(cols[0], F.lit(True)), "min"), "u": Part(lambda cols, o: cols[0].isNull(), "max")},
        lambda p: F.when(~p["t"], False).when(~p["u"], True),
        strict=False,
    ),
    "var": _of_moments(M.ONE, M.variance),
    "sd": _of_moments(M.ONE, lambda m: F.sqrt(M.variance(m))),
    "cov": _of_moments(M.TWO, M.covariance),
    "cor": _of_moments(M.TWO, M.correlation),
}

BY_NAME: dict[str, "Body"] = {**NAMED, "n_distinct": Distinct()}

Body = Accumulator | Aggregate | OnList | Opaque | Fold


def resolve(fn: object) -> Body:
    """A name, a body object, or a bare callable, which is taken as the aggregate form."""
    if fn is None or fn == "list":
        return OnList()
    if isinstance(fn, str):
        if fn not in BY_NAME:
            raise ValueError(f"unknown window function {fn!r}; known: {', '.join(sorted(BY_NAME))}")
        return BY_NAME[fn]
    if isinstance(fn, (Accumulator, Aggregate, OnList, Opaque, Fold)):
        return fn
    if callable(fn):
        return Aggregate(fn)
    raise TypeError(f"{fn!r} cannot be used as a window function")

"""How ordered work over a series is spread over tasks.

A window that follows each series from past to future needs the rows of a series in order, but not in
one task. Three placements, chosen from facts known while the plan is built:

``short``
    A DATE or calendar-period index: (key, index) is unique, so a series cannot hold more rows than
    there are calendar days in years 1..9999 (3.65 million, in practice thousands). One shuffle on the
    key, plain window. A table without a key is one such series.
``long``
    No key and a finer index, so the table is one series without a bound. Rows are cut into *blocks* of consecutive ordinals. A block is as
    wide as ``block`` rows are on average, by the count and span of the series, so there are about
    rows / block of them however sparse the index is. Where rows come in bursts, so that such a block would
    hold several times its part, blocks are cut at quantiles of the ordinals instead: see ``_block``.
``mixed``
    A key with a fine-grained index, where one key may hold a third of the table. Keys above
    ``hot_rows`` are found by a partial-aggregated count. The limit rises with tables of over 4 * 10^12 rows, so that no
    more than ``HOT_KEYS`` keys can be above it and their list is safe to broadcast at any size. Hot
    keys are cut into blocks, all other keys stay whole.

Blocks need what happened before them. Each block is reduced to one summary row, the summaries of a
series are scanned in order, and the result rides into the block as a *marker row* that sorts before
(or after) the block's own rows. The window then sees the carried value as an ordinary neighbour: no
join, and still one shuffle of the data.

A blocked operation reads its input twice: once whole, once only the columns the summary needs. That is
cheap over a table and costly over a long plan, so the result of a blocked operation is marked, and a
second blocked operation on it first writes it to the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moments as M
from ..functions.bodies import COMBINE, MOMENTS
from ..functions.calendar import floordiv

if TYPE_CHECKING:
    from ..frame import TemporalFrame

O, C, HOT, MARK, P, NEXT, PREV, WIDTH = "__o", "__c", "__hot", "__mark", "__p", "__next", "__prev", "__width"


# No more keys than this can each hold more than their part of a table.
HOT_KEYS = 1_000_000

# Quantiles found of a series, in groups of this many for the search, and how far off their ranks may be.
CUTS, GROUP, ACCURACY = 1024, 32, 16 * 1024

# Quantiles are kept for keys above this part of all rows: in others no burst is a large part of the work.
CUT_KEYS = 1 << 14


@dataclass(frozen=True)
class Layout:
    """Sizes of the placement; the defaults suit executors with a few GB per task.

    ``block`` counts rows: of a block on average, and of the summaries there is one for each block.
    """

    hot_rows: int = 1 << 22
    block: int = 1 << 16


@dataclass(frozen=True)
class Placed:
    """A table with its ordinal and, unless the series are short, its block and hot flag."""

    df: DataFrame
    key: tuple[str, ...]
    index: str
    blocked: bool
    layout: Layout
    ties: tuple[str, ...] = ()

    @property
    def by(self) -> list[str]:
        return [*self.key, C] if self.blocked else list(self.key)

    @property
    def order(self) -> Column:
        """The index itself where that is all there is to sort, so that chained windows share a sort."""
        at = F.col(O) if self.blocked else F.col(self.index)
        return F.struct(at, *self.ties) if self.ties else at

    @property
    def sort(self) -> list[str]:
        """The columns by which the rows of a series are sorted."""
        return [O, *self.ties]


def mode_of(tf: "TemporalFrame") -> str:
    meta = tf.meta
    cut = "mixed" if meta.key else "long"
    if meta.max_rows is not None:
        return "short" if meta.max_rows <= meta.layout.hot_rows else cut
    axis = tf.axis
    by_day = axis.kind == "date" or axis.unit in ("year", "quarter", "month")
    return "short" if by_day and not tf.ties else cut


def _width(n: Column, lo: Column, hi: Column, block: int) -> Column:
    """Ordinals of a block, such that a series of ``n`` rows from ``lo`` to ``hi`` has n / block blocks."""
    blocks = F.greatest(floordiv(n, block), F.lit(1).cast("bigint"))
    return F.coalesce(floordiv(hi - lo, blocks) + 1, F.lit(1).cast("bigint"))


def _quantiles() -> Column:
    """The list is one literal: a thousand of them would take longer to send to the JVM than to use."""
    parts = ",".join(str(k / CUTS) for k in range(1, CUTS))
    return F.expr(f"percentile_approx({O}, cast(split('{parts}', ',') AS array<double>), {ACCURACY})")


def _bursts(cuts: Column, n: Column, width: Column, block: int) -> Column:
    """Whether a block of equal width holds about three times its part of the rows: so many cuts fall into it."""
    apart = (floordiv(F.lit(3 * block * CUTS).cast("bigint"), F.greatest(n, F.lit(1).cast("bigint"))) + 2).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.size(cuts) - apart - 1, F.lit(0)))
    one = lambda i: floordiv(F.get(cuts, i + apart), width) == floordiv(F.get(cuts, i), width)
    return F.coalesce((F.size(cuts) > apart) & F.exists(starts, one), F.lit(False))


def _block(facts: Column, block: int) -> Column:
    """The block of a row of a series with the given facts: n, lo, hi, width and, if rows come in bursts, cuts.

    Without cuts blocks are equally wide. With cuts the row's place among them is found, in groups first. A
    series of few blocks has several cuts to a block; in one of many, the span between two cuts is divided
    further by width. A block then has about its part of the rows, or at most a ``CUTS``-th of the series.
    """
    at, cuts, one = F.col(O), facts["cuts"], F.lit(1).cast("bigint")
    coarse = F.size(F.filter(cuts, lambda c, i: (F.pmod(i, F.lit(GROUP)) == GROUP - 1) & (c <= at)))
    first = F.slice(cuts, coarse * GROUP + 1, GROUP)
    place = coarse * GROUP + F.size(F.filter(first, lambda c: c <= at))
    blocks = F.greatest(floordiv(facts["n"], block), one)
    lo = F.coalesce(F.get(cuts, place - 1), facts["lo"])
    hi = F.coalesce(F.get(cuts, place), facts["hi"] + 1)
    parts = F.greatest(floordiv(blocks, CUTS), one)
    step = floordiv(F.greatest(hi - lo - 1, F.lit(0).cast("bigint")), parts) + 1
    within = F.least(floordiv(at - lo, step), parts - 1)
    few = floordiv(place.cast("bigint") * F.least(blocks, F.lit(CUTS).cast("bigint")), F.lit(CUTS).cast("bigint"))
    many = place.cast("bigint") * parts + within
    return F.when(cuts.isNull(), floordiv(at, facts["width"])).when(blocks < CUTS, few).otherwise(many)


FACTS = "__facts"


def _facts(n: Column, lo: Column, hi: Column, cuts: Column, block: int) -> Column:
    width = _width(n, lo, hi, block)
    kept = F.when(_bursts(cuts, n, width, block), cuts)
    return F.struct(n.alias("n"), lo.alias("lo"), hi.alias("hi"), width.alias("width"), kept.alias("cuts"))


def mark_hot(df: DataFrame, key: tuple[str, ...], hot_rows: int, block: int) -> DataFrame:
    """Flag the rows of keys with more than ``hot_rows`` rows, or more than n / HOT_KEYS if that is larger,
    and give them the facts by which their blocks are cut.

    Fewer than ``HOT_KEYS`` keys can pass, whatever the table holds, and fewer than ``CUT_KEYS`` have
    quantiles; that bounds the broadcasts. Quantiles take a second look at the ordinals of those keys alone,
    and none where there is no such key.
    """
    names = {k: f"__h{i}" for i, k in enumerate(key)}
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(O).alias("__lo"), F.max(O).alias("__hi"))
    part = lambda k: F.call_function("div", F.sum("__n"), F.lit(k).cast("bigint"))
    floor = F.lit(hot_rows).cast("bigint")
    limits = counts.agg(F.struct(F.greatest(floor, part(HOT_KEYS)).alias("hot"), F.greatest(floor, part(CUT_KEYS)).alias("cut"))).scalar()
    hot = counts.where(F.col("__n") > limits["hot"]).withColumnsRenamed(names)
    large = hot.where(F.col("__n") > F.greatest(limits["cut"], F.lit(3 * block).cast("bigint"))).select(*names.values())
    held = df.join(F.broadcast(large), [df[k].eqNullSafe(large[h]) for k, h in names.items()], "inner")
    cuts = held.groupBy(*names.values()).agg(_quantiles().alias("__cuts")).withColumnsRenamed({h: f"{h}c" for h in names.values()})
    hot = hot.join(F.broadcast(cuts), [hot[h].eqNullSafe(cuts[f"{h}c"]) for h in names.values()], "left")
    hot = hot.select(
        *names.values(), F.lit(True).alias(HOT),
        _facts(F.col("__n"), F.col("__lo"), F.col("__hi"), F.col("__cuts"), block).alias(FACTS),
    )
    same = [df[k].eqNullSafe(hot[h]) for k, h in names.items()]
    joined = df.join(F.broadcast(hot), same, "left").drop(*names.values())
    return joined.withColumn(HOT, F.coalesce(F.col(HOT), F.lit(False)))


def place(tf: "TemporalFrame") -> Placed:
    mode = mode_of(tf)
    if mode != "short" and tf.meta.costly:
        tf = tf.materialize()
    meta, axis = tf.meta, tf.axis
    df = tf.df.withColumn(O, axis.ordinal(F.col(meta.index)))
    if mode == "short":
        return Placed(df, meta.key, meta.index, False, meta.layout, tf.ties)
    if mode == "mixed":
        df = mark_hot(df, meta.key, meta.layout.hot_rows, meta.layout.block)
        block = F.when(F.col(HOT), _block(F.col(FACTS), meta.layout.block)).otherwise(F.lit(0).cast("bigint"))
    elif meta.dense and meta.interval is not None and meta.interval.n:
        df = df.withColumn(HOT, F.lit(True)).withColumn(WIDTH, F.lit(meta.layout.block * axis.step(meta.interval)))
        block = floordiv(F.col(O), F.col(WIDTH).cast("bigint"))
    else:
        ends = df.agg(F.count(F.lit(1)).alias("n"), F.min(O).alias("lo"), F.max(O).alias("hi"), _quantiles().alias("cuts"))
        facts = ends.select(_facts(F.col("n"), F.col("lo"), F.col("hi"), F.col("cuts"), meta.layout.block)).scalar()
        df = df.withColumn(HOT, F.lit(True)).withColumn(FACTS, facts)
        block = _block(F.col(FACTS), meta.layout.block)
    return Placed(df.withColumn(C, block).drop(WIDTH, FACTS), meta.key, meta.index, True, meta.layout, tf.ties)


def _merge(name: str, combine: str) -> Column:
    merged = COMBINE[combine](F.col(name))
    return F.array_sort(merged) if combine == "concat" else merged


def _over(name: str, combine: str, spec) -> Column:
    if combine == "concat":
        return F.flatten(F.collect_list(F.col(name)).over(spec))
    if combine in MOMENTS:
        return M.measured(F.col(name), MOMENTS[combine], lambda a: a.over(spec))
    return COMBINE[combine](F.col(name)).over(spec)


def exclusive(summary: DataFrame, placed: Placed, combines: Mapping[str, str], reverse: bool = False) -> DataFrame:
    """Combine, for each block of a series, all blocks strictly before it (after it if ``reverse``)."""
    order = F.col(C).desc() if reverse else F.col(C).asc()
    spec = Window.partitionBy(*placed.key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda a: a.over(spec)
    plain = [_over(n, c, spec).alias(n) for n, c in combines.items() if c not in MOMENTS]
    merged = {n: M.before(F.col(n), MOMENTS[c], over) for n, c in combines.items() if c in MOMENTS}
    if not merged:
        return summary.select(*placed.key, C, *plain)
    sums = [v.alias(f"{n}_{p}") for n, (first, _) in merged.items() for p, v in first.items()]
    out = summary.select(*placed.key, C, *plain, *merged, *sums)
    found = {n: {p: F.col(f"{n}_{p}") for p in first} for n, (first, _) in merged.items()}
    kept = [n for n, c in combines.items() if c not in MOMENTS]
    return out.select(*placed.key, C, *kept, *[second(found[n]).alias(n) for n, (_, second) in merged.items()])


def running(placed: Placed, parts: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Add one column per part: the part combined over all rows of the series up to this one.

    ``parts`` maps an output name to (per-row value, combine).
    """
    df = placed.df.withColumns({name: value for name, (value, _) in parts.items()})
    combines = {name: combine for name, (_, combine) in parts.items()}
    if placed.blocked:
        summary = (
            df.where(F.col(HOT))
            .groupBy(*placed.key, C)
            .agg(*[_merge(n, c).alias(n) for n, c in combines.items()])
        )
        carried = {n: f"{n}_carried" for n, c in combines.items() if c in MOMENTS}
        marks = exclusive(summary, placed, combines).withColumnsRenamed(carried).withColumn(MARK, F.lit(0))
        df = df.withColumn(MARK, F.lit(1)).unionByName(marks, allowMissingColumns=True)
        order = [F.col(MARK), *map(F.col, placed.sort)]
    else:
        carried, order = {}, [placed.order]
    spec = Window.partitionBy(*placed.by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns if c not in combines and c not in carried.values()]
    first = {n: F.first(c, ignorenulls=True).over(spec).alias(c) for n, c in carried.items()}
    out = df.select(*kept, *first.values(), *[_over(n, c, spec).alias(n) for n, c in combines.items()])
    out = out.withColumns({n: M.merge(F.col(c), F.col(n), MOMENTS[combines[n]]) for n, c in carried.items()})
    out = out.drop(*carried.values())
    return out.where(F.col(MARK) == 1).drop(MARK) if placed.blocked else out


def neighbours(placed: Placed, previous: bool = False) -> DataFrame:
    """Add the next (and optionally the previous) ordinal of the same series."""
    df = placed.df
    wanted = [NEXT, PREV] if previous else [NEXT]
    if placed.blocked:
        hot = df.where(F.col(HOT)).groupBy(*placed.key, C)
        blocks = hot.agg(F.min(O).alias("__lo"), F.max(O).alias("__hi"))
        after = exclusive(blocks.select(*placed.key, C, F.col("__lo").alias(O)), placed, {O: "min"}, True)
        marks = after.where(F.col(O).isNotNull()).withColumn(MARK, F.lit(2))
        if previous:
            before = exclusive(blocks.select(*placed.key, C, F.col("__hi").alias(O)), placed, {O: "max"})
            marks = marks.unionByName(before.where(F.col(O).isNotNull()).withColumn(MARK, F.lit(0)))
        df = df.withColumn(MARK, F.lit(1)).unionByName(marks, allowMissingColumns=True)
        order = [F.col(MARK), *map(F.col, placed.sort)]
    else:
        order = [placed.order]
    spec = Window.partitionBy(*placed.by).orderBy(*order)
    look = {NEXT: F.lead(O).over(spec), PREV: F.lag(O).over(spec)}
    out = df.select("*", *[look[name].alias(name) for name in wanted])
    return out.where(F.col(MARK) == 1).drop(MARK) if placed.blocked else out


def positions(tf: "TemporalFrame") -> Placed:
    """Add ``__p``, the exact 0-based position of a row in its series."""
    return numbered(place(tf))


def numbered(placed: Placed) -> Placed:
    if not placed.blocked:
        spec = Window.partitionBy(*placed.by).orderBy(placed.order)
        df = placed.df.withColumn(P, (F.row_number().over(spec) - 1).cast("bigint"))
    else:
        df = running(placed, {P: (F.lit(1).cast("bigint"), "sum")}).withColumn(P, F.col(P) - 1)
    return replace(placed, df=df)


def reachable(tf: "TemporalFrame", size: int) -> list[tuple[DataFrame, list[str], Column]]:
    """Tables in which every row has the ``size - 1`` rows before it in its own window partition, each with
    its partition columns and order. Drop the copies (``own``) when the window is done.

    Whole series need one shuffle. Only what is cut into blocks is numbered first and shuffled again,
    unless the series is dense: then the ordinal already counts rows.
    """
    placed = place(tf)
    whole = replace(placed, blocked=False)
    if not placed.blocked:
        return [(whole.df, whole.by, whole.order)]
    if tf.meta.dense:
        step = tf.axis.step(tf.require_interval())
        cut = replace(placed, df=placed.df.withColumn(P, floordiv(F.col(O), step)))
        return [(*halo(cut, size), F.col(P))]
    if not placed.key:
        return [(*halo(numbered(placed), size), F.col(P))]
    cold = placed.df.where(~F.col(HOT))
    hot = numbered(replace(placed, df=placed.df.where(F.col(HOT))))
    return [(cold, whole.by, whole.order), (*halo(hot, size), F.col(P))]


def own(df: DataFrame) -> DataFrame:
    """The rows of ``reachable`` without the copies."""
    return df.where(F.col(COPY) == F.col(HOME)) if COPY in df.columns else df


HOME, COPY = "__home", "__copy"


def halo(placed: Placed, size: int) -> tuple[DataFrame, list[str]]:
    """Blocks of consecutive positions, each with the ``size - 1`` rows that precede it.

    Position ``p`` lives in block ``p div B`` and is copied to the following blocks whose windows reach
    back to it. ``B`` is at least four windows long, so under a third of the rows have a copy. A row's
    own block is the one where ``__copy == __home``; drop the copies after the window.
    """
    width = max(placed.layout.block, 4 * size)
    cold = F.lit(0).cast("bigint")
    home = F.when(F.col(HOT), floordiv(F.col(P), width)).otherwise(cold)
    last = F.when(F.col(HOT), floordiv(F.col(P) + (size - 1), width)).otherwise(cold)
    df = placed.df.drop(C).withColumn(HOME, home).withColumn("__last", last)
    df = df.withColumn(COPY, F.explode(F.sequence(F.col(HOME), F.col("__last")))).drop("__last")
    return df, [*placed.key, COPY]

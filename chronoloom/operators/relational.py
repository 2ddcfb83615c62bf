"""Joins, sorting, slicing, top-k and unions with the null and tie rules of temporal tables."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layout as L

if TYPE_CHECKING:
    from ..frame import TemporalFrame

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}

# A limit keeps this many rows of every task and merges them in one; longer cuts go by position.
LIMIT_ROWS = 2_000


# Rows of one join key that a task takes; a key with more is dealt over several tasks.
PART_ROWS = 1 << 20


def join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    na_matches: str = "na",
    deal: bool | None = None,
    part_rows: int = PART_ROWS,
    rows_by: tuple[list[str] | None, list[str] | None] = (None, None),
) -> DataFrame:
    """Equi-join by name. A null key matches a null key unless ``na_matches="never"``.

    The key columns appear once, from whichever side has them. Other columns that both sides have get
    the suffixes ``_x`` and ``_y``.

    ``deal``: spread the rows of keys above ``part_rows`` rows over several tasks. Spark splits such keys by
    itself in inner joins and on the outer side of one-sided joins, never in full ones, so full joins are
    dealt unless told otherwise. Dealing counts the keys first, so both sides are read twice. ``rows_by``
    names columns that tell the rows of a side apart; by default all do, and equal rows stay together.
    """
    if how not in HOW:
        raise ValueError(f"unknown join {how!r}")
    deal = how == "full" if deal is None else deal
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if how in ("semi", "anti"):
        right, clash = right.select(*on), set()
        right = right.distinct() if deal else right
        rows_by = (rows_by[0], None)
    by = [[f"{c}{end}" if c in clash else c for c in b] if b else None for b, end in zip(rows_by, ("_x", "_y"))]
    left = left.withColumnsRenamed({c: f"{c}_x" for c in clash})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in clash})
    columns = left.columns
    if deal:
        hot = _hot_keys(left, right, on, na_matches, part_rows)
        left, right = _dealt(left, hot, on, "l", by[0]), _dealt(right, hot, on, "r", by[1])
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    match = lambda c: left[c] == right[f"__r_{c}"] if na_matches == "never" else left[c].eqNullSafe(right[f"__r_{c}"])
    cell = [left[f"__l{i}"] == right[f"__r{i}"] for i in ("l", "r")] if deal else []
    joined = left.join(right, [*[match(c) for c in on], *cell], HOW[how])
    if deal and how not in ("semi", "anti"):
        # A hot key of both sides has partners in some cell, so a row of it without one in its own cell is spurious.
        lost = (F.col("__rl").isNull() & F.col("__lmet")) | (F.col("__ll").isNull() & F.col("__rmet"))
        joined = joined.where(~F.coalesce(lost, F.lit(False)))
    if how in ("semi", "anti"):
        return joined.select(*columns)
    rest = [c for c in right.columns if c not in {*[f"__r_{c}" for c in on], "__rl", "__rr", "__rmet"}]
    # A null left key can only mean "no left row" or a null that matched a null: coalesce is safe.
    keyed = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) for c in on}
    keep = [keyed.get(c, F.col(c)) if how in ("right", "full") else F.col(c) for c in columns]
    return joined.select(*keep, *rest)


def _hot_keys(left: DataFrame, right: DataFrame, on: list[str], na_matches: str, part_rows: int) -> DataFrame:
    """Keys with more than ``part_rows`` rows on a side: in how many parts each side is dealt, and whether
    both sides have the key.

    The limit rises with tables of over 10^12 rows, so that fewer than ``L.HOT_KEYS`` keys of a side pass and
    the list is safe to broadcast.
    """
    names = [f"__h{i}" for i in range(len(on))]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    side = lambda df, l, r: df.select(*[F.col(c).alias(h) for c, h in zip(on, names)], l.alias("l"), r.alias("r"))
    both = side(left, one, none).unionByName(side(right, none, one))
    counts = both.groupBy(*names).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    floor = F.lit(part_rows).cast("bigint")
    most = F.call_function("div", F.sum(F.greatest("l", "r")), F.lit(L.HOT_KEYS).cast("bigint"))
    limit = counts.agg(F.greatest(floor, most).alias("limit")).scalar()
    hot = counts.where(F.greatest("l", "r") > limit)
    met = (F.col("l") > 0) & (F.col("r") > 0)
    if na_matches == "never":
        met = met & reduce(lambda a, b: a & b, [F.col(h).isNotNull() for h in names])
    parts = lambda c: F.greatest(F.ceil(F.col(c) / limit), F.lit(1)).cast("int")
    return hot.select(*names, parts("l").alias("__parts_l"), parts("r").alias("__parts_r"), met.alias("__met"))


def _dealt(df: DataFrame, hot: DataFrame, on: list[str], side: str, by: list[str] | None) -> DataFrame:
    """Rows with their cell in the grid of parts of both sides; a row is repeated for every part of the other.

    A key that isn't hot has one cell. The part is a hash of the row, so a task that runs again deals alike.
    """
    other = "r" if side == "l" else "l"
    same = [df[c].eqNullSafe(hot[f"__h{i}"]) for i, c in enumerate(on)]
    joined = df.join(F.broadcast(hot), same, "left")
    own = F.pmod(F.xxhash64(*by) if by else _hashed(df), F.coalesce(hot[f"__parts_{side}"], F.lit(1))).cast("int")
    copies = F.when(hot["__met"], hot[f"__parts_{other}"]).otherwise(F.lit(1))
    met = F.coalesce(hot["__met"], F.lit(False)).alias(f"__{side}met")
    out = joined.select(*[df[c] for c in df.columns], own.alias(f"__{side}{side}"), copies.alias("__copies"), met)
    cell = F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias(f"__{side}{other}")
    return out.select("*", cell).drop("__copies")


def temporal_join(
    tf: "TemporalFrame",
    other: "TemporalFrame | DataFrame",
    on: list[str],
    how: str = "inner",
    na_matches: str = "na",
    validate: bool = True,
    deal: bool | None = None,
    part_rows: int = PART_ROWS,
) -> "TemporalFrame":
    """Join that keeps the left description; refuses a result where key and index repeat (a job).

    Full joins are dealt (see ``join``) unless key and index of the left table are in ``on``: such rows have a
    key each, and a right table that repeated one would be refused.
    """
    from .declare import duplicates

    right = other if isinstance(other, DataFrame) else other.df
    own = [*tf.meta.key, tf.meta.index]
    theirs = None if isinstance(other, DataFrame) else [*other.meta.key, other.meta.index]
    if deal is None and set(own) <= set(on) and validate:
        deal = False
    df = join(tf.df, right, on, how, na_matches, deal, part_rows, (own, theirs))
    kept = how == "left"
    bound = None if how in ("right", "full") else tf.meta.max_rows
    out = tf.with_(df, dense=tf.meta.dense and kept, shared_span=tf.meta.shared_span and kept, max_rows=bound)
    if validate and how not in ("semi", "anti") and not duplicates(out).isEmpty():
        raise ValueError("after the join key and index no longer identify a row")
    return out


SALTS = 64


def spread_join(rows: DataFrame, table: DataFrame, pairs: dict[str, str], by: list[str]) -> DataFrame:
    """Rows with the one row of ``table`` that has the same values (nulls alike): ``pairs`` maps column names.

    One value may be that of a third of all rows, so rows are dealt over ``SALTS`` parts of each value by
    a hash of the columns ``by``, and the table, a row per value, is repeated for each part.
    """
    parts = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    same = [dealt[a].eqNullSafe(parts[b]) for a, b in pairs.items()]
    joined = dealt.join(parts, [*same, dealt["__deal"] == parts["__part"]], "inner")
    return joined.drop("__deal", "__part", *pairs.values())


def desc(column: str) -> Column:
    return F.desc_nulls_last(column)


def sort_columns(order) -> list[Column]:
    """Ascending, nulls last, for names; column expressions stay as given."""
    return [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order]


def top_k(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties are broken by name, so the result is one only."""
    order = [desc(by), *sort_columns(ties)]
    if k <= LIMIT_ROWS:
        return df.orderBy(*order, _hashed(df)).limit(k)
    return global_positions(df, order, L.P).where(F.col(L.P) < k).select(*df.columns)


def _hashed(df: DataFrame) -> Column:
    """Settles what an order leaves open, the same way wherever it is used; only equal rows still tie."""
    return F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def global_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the exact 0-based position of every row in a total order, in parallel.

    The sorted table is checkpointed, which fixes its partitions; each partition's size then gives the
    offset of the next. Only those sizes (one row per partition) are broadcast. Rows that tie are ordered
    by a hash, and equal rows by chance, so a value that fills a third of the table spreads over many
    partitions like any other.
    """
    from ..sources.storage import checkpointed

    ties = {"__hash": _hashed(df), "__chance": F.rand(0)}
    sorted_ = df.withColumns(ties).orderBy(*order, *ties)
    fixed = checkpointed(sorted_).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftrightunsigned(F.col("__id"), 33)
    fixed = fixed.withColumn("__part", part)
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    at = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    joined = fixed.join(F.broadcast(offsets), fixed["__part"] == offsets["__of"], "inner")
    return joined.select(*df.columns, at.alias(name))


def slice_rows(tf: "TemporalFrame", first: int, last: int) -> "TemporalFrame":
    """Positions ``first..last`` (1-based) of each group, or of the table sorted by key and index."""
    if not 1 <= first <= last:
        raise ValueError("a slice needs 1 <= first <= last")
    m = tf.meta
    order = [*[k for k in m.key if k not in m.groups], m.index]
    columns = tf.df.columns
    if not m.groups:
        if last <= LIMIT_ROWS:
            df = tf.df.orderBy(*sort_columns(order), _hashed(tf.df)).limit(last)
            df = df.offset(first - 1) if first > 1 else df
        else:
            df = global_positions(tf.df, sort_columns(order), L.P)
            df = df.where(F.col(L.P).between(first - 1, last - 1)).select(*columns)
    elif set(m.groups) == set(m.key):
        df = L.positions(tf).df.where(F.col(L.P).between(first - 1, last - 1)).select(*columns)
    else:
        # Rank within the group. With a bound on the rank Spark keeps only the leading rows of each
        # group per task before the shuffle, so a group of any size costs `last` rows per task.
        spec = Window.partitionBy(*m.groups).orderBy(*sort_columns(order), _hashed(tf.df))
        df = tf.df.withColumn(L.P, F.row_number().over(spec)).where(F.col(L.P) <= last)
        df = df.where(F.col(L.P) >= first).select(*columns)
    return tf.with_(df, dense=False, shared_span=False)


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Union by name; a column that a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

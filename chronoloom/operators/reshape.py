"""Wide and long, nested and flat, and the hierarchy of a nested key."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout as L
from .levels import LevelOrder
from .relational import global_positions, spread_join

if TYPE_CHECKING:
    from ..frame import TemporalFrame


NO_LEVEL = "<NA>"


def gather(df: DataFrame, columns: list[str], names_to: str, values_to: str) -> DataFrame:
    """Wide to long; a narrow operation without a shuffle."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, columns, names_to, values_to)


#: Levels that may become columns without being named.
LEVELS = 5_000


def spread_pages(df: DataFrame, ids: list[str], column: str, value: str, page_levels: int = 1_000) -> DataFrame:
    """Long to wide for any number of levels: ids, page and a map from level to value, a page of levels a row.

    Levels are numbered in their order (nulls last) without leaving Spark, page 0 has the first
    ``page_levels`` of them, and a row is there for each page that its ids have a value in. As in ``spread``
    the largest of several values of a cell counts; a null level is the key ``<NA>``, and a value that is null
    makes no cell. Keys are text. A level may hold a third of all rows: the join of its number is dealt.
    """
    level, number = "__level", "__number"
    levels = global_positions(df.select(F.col(column).alias(level)).distinct(), [F.asc_nulls_last(level)], number)
    rows = df.where(F.col(value).isNotNull()).select(*ids, F.col(column).alias("__at"), F.col(value).alias("__value"))
    numbered = spread_join(rows, levels, {"__at": level}, [*ids, "__value"])
    key = F.coalesce(F.col("__at").cast("string"), F.lit(NO_LEVEL))
    numbered = numbered.withColumns({"page": L.floordiv(F.col(number), page_levels), "__key": key})
    cells = numbered.groupBy(*ids, "page", "__key").agg(F.max("__value").alias("__value"))
    entries = F.sort_array(F.collect_list(F.struct("__key", "__value")))
    return cells.groupBy(*ids, "page").agg(F.map_from_entries(entries).alias("cells"))


def spread(
    df: DataFrame, ids: list[str], column: str, value: str, levels: list[object] | None = None, fill: object = None
) -> DataFrame:
    """Long to wide in one shuffle: one conditional aggregate per level.

    Without ``levels`` the distinct values are looked up first (a job): as many as there are become
    columns, and more than ``LEVELS`` are refused: see ``spread_pages``. Rows without a level go to the column
    ``<NA>``, which is there if any are found or ``levels`` has None. Given levels are the only columns.
    """
    if levels is None:
        found = df.select(column).distinct().limit(LEVELS + 1)  # no more than these reach the driver
        levels = [r[0] for r in found.orderBy(F.asc_nulls_last(column)).collect()]
        if len(levels) > LEVELS:
            raise ValueError(f"{column} has more than {LEVELS} levels: name those wanted, or use spread_pages")
    same = lambda v: F.col(column).isNull() if v is None else F.col(column) == F.lit(v)
    cells = [F.max(F.when(same(v), F.col(value))) for v in levels]
    if fill is not None:
        cells = [F.coalesce(c, F.lit(fill)) for c in cells]
    return df.groupBy(*ids).agg(*[c.alias(NO_LEVEL if v is None else str(v)) for c, v in zip(cells, levels)])


def nest(tf: "TemporalFrame", by: list[str], name: str = "data", part_rows: int | None = None) -> DataFrame:
    """Gather each group's remaining columns into an array of rows, from past to future.

    A group becomes one value. Where groups have no natural bound, ``part_rows`` splits them: every
    group then has as many rows as needed, numbered by ``part``, and ``unnest`` restores all of them.
    Parts of a series are consecutive; parts of any other group are drawn by a hash of key and index.
    """
    m = tf.meta
    df, keys = tf.df, list(by)
    if part_rows is not None:
        keys.append("part")
        if set(by) == set(m.key):
            df = L.positions(tf).df.withColumn("part", L.floordiv(F.col(L.P), part_rows))
        else:
            names = {c: f"__g{i}" for i, c in enumerate(by)}
            sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).withColumnsRenamed(names)
            df = spread_join(df, sizes, names, [*m.key, m.index])
            parts = L.floordiv(F.col("__n") + (part_rows - 1), part_rows)
            df = df.withColumn("part", F.pmod(F.xxhash64(*m.key, m.index), parts))
    inner = [m.index, *[c for c in tf.df.columns if c not in by and c != m.index]]
    rows = F.array_sort(F.collect_list(F.struct(*inner)))
    return df.groupBy(*keys).agg(rows.alias(name))


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    """Back to one row per element."""
    return df.select(*[c for c in df.columns if c != name], F.inline(name))


def hierarchy(df: DataFrame, parent: str, child: str, root: str, order: LevelOrder | None = None) -> DataFrame:
    """The nested key as one JSON document ``{name, children: [{name, children: [{name}]}]}``."""
    return hierarchy_of(df, [parent, child], root, order)


def hierarchy_of(df: DataFrame, path: list[str], root: str, order: LevelOrder | None = None) -> DataFrame:
    """A tree of any depth, ``path`` from the outermost level inwards, as one JSON document.

    Only distinct paths are aggregated, level by level from the leaves: a node's children are put in order where
    the node is made. The document is one value; ``branches`` has a row for each of its nodes instead.
    """
    order = order or LevelOrder()
    levels = [f"l{i}" for i in range(len(path))]
    nodes = df.select(*[F.col(c).alias(name) for c, name in zip(path, levels)]).distinct()
    for depth in reversed(range(len(path))):
        name = levels[depth]
        inner = [F.col("children")] if "children" in nodes.columns else []
        node = F.struct(F.struct(*_ranks(order, name)).alias("r"), F.struct(F.col(name).alias("name"), *inner).alias("node"))
        below = F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"])
        nodes = nodes.groupBy(*levels[:depth]).agg(below.alias("children"))
    return nodes.select(F.to_json(F.struct(F.lit(root).alias("name"), "children")).alias("document"))


def branches(df: DataFrame, path: list[str]) -> DataFrame:
    """The same tree as a table, one row per node below the root: depth, path (texts from the outermost level),
    n_children and n_leaves. One pass and no value that grows with the tree, so any number of nodes will do."""
    full = F.array(*[F.col(c).cast("string") for c in path])
    paths = df.select(full.alias("__full")).distinct()
    at = F.explode(F.sequence(F.lit(1), F.lit(len(path)))).alias("depth")
    nodes = paths.select("__full", at).select(
        "depth", F.slice("__full", F.lit(1), F.col("depth")).alias("path"), F.slice("__full", F.col("depth") + 1, 1).alias("__next")
    )
    # First by child, so that a node with many leaves is counted in parts.
    children = nodes.groupBy("depth", "path", "__next").agg(F.count(F.lit(1)).alias("__n"))
    some = F.count(F.when(F.size("__next") > 0, 1)).alias("n_children")
    return children.groupBy("depth", "path").agg(some, F.sum("__n").alias("n_leaves"))


def _ranks(order: LevelOrder, column: str) -> list:
    """Sort position of a level as comparable values, moved levels outside the alphabet."""
    c = F.col(column)
    moved = F.lit(0)
    for i, level in enumerate(order.first):
        moved = F.when(c == level, i - len(order.first)).otherwise(moved)
    for i, level in enumerate(order.last):
        moved = F.when(c == level, i + 1).otherwise(moved)
    return [moved, c]

"""Near-duplicate vectors by comparing tiles along principal components.

1. Equal vectors of a label are one *class* (a partial-aggregated group-by), so a vector that fills a third
   of the table is one row from here on.
2. The principal components come from second moments summed over all classes; only a table of dimension
   times dimension reaches the driver. Any rotation keeps cosines, so results don't depend on the basis.
3. Classes are sorted by label, cell of the leading components and id (a range shuffle: no label and no
   cell is in one task) and cut into tiles of at most ``TILE`` rows.
4. Tiles of a label meet where their spans on the first component are near enough for a link, by a join on
   slots of that component. By the boxes and the cones of two tiles either no pair, all pairs or some pairs
   can be linked; only in the last case their vectors are sent. A large group of near copies is mostly
   tiles of which all pairs are linked: these are counted and never compared.
5. Within two tiles the products of the leading components are added up first. With the norms of the rest of
   either vector they bound the cosine, and a pair whose bound is below the threshold is compared no further.
   What ends within 1e-9 of the threshold is decided by the cosine of the given vectors.

A task emits one row per linked class, not per pair: its number of links and the root of its local
component. Counts are added up and components contracted over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, column
from .components import components

#: Rows of a tile at most; fewer where vectors are long.
TILE = 2048
TILE_BYTES = 4 << 20
#: Leading components that make the cells by which rows are sorted, and those that make a tile's box.
CELL, BOX = 6, 8
#: Components added before the first look, then twice as many before each next one.
FIRST = 8
#: Bases are found for this many of the commonest lengths; vectors of other lengths are compared as given.
BASES = 32
SLACK, CLOSE = 1e-6, 1e-9
#: Partners for which a tile's vectors are sent at once.
DEAL = 64
#: Classes above this share of all rows are joined by a broadcast; there are fewer than a thousand.
HOT = 1_000


def _valid(v: Column) -> Column:
    """Not empty, no null and no infinite component, and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors as given."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))))


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


# -- principal components ---------------------------------------------------------------------------


def _moments(batches: Iterator[pa.RecordBatch], lengths: list[int]):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, rows in _by_length(batch):
            if size in lengths:
                u = units(_matrix(batch.column("v").take(pa.array(rows)), size))
                sums[size] = sums.get(size, 0) + u.T @ u
    for size, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(list(total))], ["dim", "i", "row"]
        )


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": [frame["dim"][0]], "i": [frame["i"][0]], "row": [np.sum(frame["row"].to_list(), axis=0)]})


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal components, largest first, of the unit vectors of each of the commonest lengths (jobs)."""
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(BASES).collect()
    lengths = [r["dim"] for r in common]
    parts = classes.select("v").mapInArrow(lambda it: _moments(it, lengths), "dim int, i int, row array<double>")
    rows = parts.groupBy("dim", "i").applyInPandas(_add, "dim int, i int, row array<double>").collect()
    found = {}
    for size in lengths:
        total = np.array([r["row"] for r in sorted((r for r in rows if r["dim"] == size), key=lambda r: r["i"])])
        found[size] = np.linalg.eigh(total)[1][:, ::-1]
    return found


def _rotated(u: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    turn = basis.get(u.shape[1])
    return u if turn is None else u @ turn


# -- tiles ------------------------------------------------------------------------------------------


def _cells(batches: Iterator[pa.RecordBatch], basis: dict[int, np.ndarray], reach: float):
    """Add the cell of each vector: its leading components in steps of the reach, as ordered bytes."""
    for batch in batches:
        cells = np.empty(batch.num_rows, object)
        for size, rows in _by_length(batch):
            lead = _rotated(units(_matrix(batch.column("v").take(pa.array(rows)), size)), basis)[:, :CELL]
            steps = (np.floor(lead / reach) + 2**15).clip(0, 2**16 - 1).astype(">u2")
            cells[rows] = [s.tobytes() for s in steps]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], [*batch.schema.names, "cell"])


_TILE_SCHEMA = (
    "dim int, tile bigint, weight bigint, lead bigint, classes binary, reps binary, weights binary, vectors binary, "
    "lo array<double>, hi array<double>, centre array<double>, angle double"
)


def _cut(batches: Iterator[pa.RecordBatch], basis: dict[int, np.ndarray], tile_rows: int):
    """Tiles of consecutive rows of one label and length; their order is that of the partition."""
    part, made = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def tile() -> pa.RecordBatch:
        nonlocal made
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        size = rows["dim"][0].as_py()
        vectors = _matrix(rows["v"].combine_chunks(), size)
        u = _rotated(units(vectors), basis)
        classes, reps, weights = (rows[c].to_numpy().astype("<i8") for c in ("class", "rep", "n"))
        centre = u.sum(axis=0)
        norm = np.sqrt((centre * centre).sum())
        centre = centre / norm if norm > 0 else u[0]
        angle = float(np.arccos((u @ centre).clip(-1, 1)).max())
        lead = u[:, :BOX]
        values = [
            rows["label"][0], size, (part << 32) + made, int(weights.sum()), int(reps[0]), classes.tobytes(), reps.tobytes(),
            weights.tobytes(), vectors.astype("<f8").tobytes(), lead.min(axis=0), lead.max(axis=0), centre, angle,
        ]
        made += 1
        names = ["label", *[c.split()[0] for c in _TILE_SCHEMA.split(", ")]]
        label = pa.array([values[0].as_py()], rows["label"].type)
        return pa.RecordBatch.from_arrays([label, *[pa.array([x]) for x in values[1:]]], names).cast(_tile_type(label.type))

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return a.column("label")[i] == b.column("label")[j] and a.column("dim")[i] == b.column("dim")[j]

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if held and not same(held[-1], held[-1].num_rows - 1, batch, at):
                yield tile()
            most = min(tile_rows, max(1, TILE_BYTES // (8 * batch.column("dim")[at].as_py())))
            room, stop = most - sum(b.num_rows for b in held), at
            stop = min(at + room, batch.num_rows)
            if not same(batch, at, batch, stop - 1):
                stop = next(k for k in range(at, stop) if not same(batch, at, batch, k))
            held.append(batch.slice(at, stop - at))
            if stop - at == room:
                yield tile()
            at = stop
    if held:
        yield tile()


def _tile_type(label: pa.DataType) -> pa.Schema:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [c.split() for c in _TILE_SCHEMA.split(", ")]
    return pa.schema([("label", label), *[(n, types.get(t, pa.list_(pa.float64()))) for n, t in fields]])


# -- pairs of tiles ---------------------------------------------------------------------------------


def _near_tiles(tiles: DataFrame, reach: float, angle: float) -> DataFrame:
    """Pairs of tiles (a <= b) that may hold a link: a, b and whether all pairs of rows are linked.

    Two rows can be linked only within ``reach`` on every component, so tiles meet in slots of that width on
    the first; of the slots that two share, the first counts.
    """
    facts = tiles.select("label", "dim", "tile", "weight", "lead", "lo", "hi", "centre", "angle")
    slot = lambda x: F.floor(x / reach)
    left = facts.withColumns({"first": slot(F.col("lo")[0] - reach), "last": slot(F.col("hi")[0] + reach)})
    right = facts.withColumns({"first": slot(F.col("lo")[0]), "last": slot(F.col("hi")[0])})
    left, right = (
        t.withColumn("slot", F.explode(F.sequence("first", "last"))).alias(n) for t, n in ((left, "a"), (right, "b"))
    )
    pairs = left.join(right, ["label", "dim", "slot"]).where(
        "a.tile <= b.tile AND slot = greatest(a.first, b.first)"
    )
    gap = F.zip_with(
        F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    dot = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between = F.when(F.expr("a.tile = b.tile"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    around = F.col("a.angle") + F.col("b.angle")
    pairs = pairs.withColumns({"apart": apart, "between": between, "around": around})
    pairs = pairs.where((F.col("apart") <= (reach + SLACK) ** 2) & (F.col("between") - F.col("around") <= angle + SLACK))
    return pairs.select(
        F.col("a.tile").alias("a"), F.col("b.tile").alias("b"), F.col("a.weight").alias("wa"), F.col("b.weight").alias("wb"),
        F.col("a.lead").alias("la"), F.col("b.lead").alias("lb"), (F.col("between") + F.col("around") <= angle - SLACK).alias("whole"),
    )


def _with_vectors(pairs: DataFrame, tiles: DataFrame, side: str) -> DataFrame:
    """Pairs with the rows of one side; a tile with many partners is sent once for every ``DEAL`` of them."""
    other = "b" if side == "a" else "a"
    counts = pairs.groupBy(side).count().select(F.col(side).alias("tile"), F.ceil(F.col("count") / DEAL).alias("deals"))
    sent = ("classes", "reps", "weights", "vectors")
    parts = tiles.select("tile", "dim", *sent).join(counts, "tile")
    parts = parts.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)))
    parts = parts.select(
        F.col("tile").alias(side), "deal", F.col("dim").alias("size"), *[F.col(c).alias(f"{c}_{side}") for c in sent]
    )
    dealt = pairs.join(counts.withColumnRenamed("tile", side), side).withColumn("deal", F.pmod(F.xxhash64(other), "deals"))
    return dealt.drop("deals").join(parts.drop("size") if "size" in pairs.columns else parts, [side, "deal"]).drop("deal")


_FOUND = ["class", "links", "node", "root"]
_FOUND_SCHEMA = "class bigint, links bigint, node bigint, root bigint"


class _Forest:
    """Components of the rows of two tiles, joined by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def linked_rows(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, given) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of unit vectors whose cosine reaches the threshold, a block of ``a`` at a time.

    ``same``: the two are one tile, and only i < j counts. ``given(i, j)`` decides what is too close to say.
    """
    size = a.shape[1]
    steps = [0]
    while steps[-1] < size:
        steps.append(min(size, max(FIRST, 2 * steps[-1])))
    tail = lambda x: [np.sqrt((x[:, s:] ** 2).sum(axis=1)) for s in steps]
    rest_a, rest_b = tail(a), tail(b)
    least = threshold - CLOSE
    for top in range(0, len(a), 512):
        rows = slice(top, top + 512)
        low = top if same else 0  # with itself a tile is compared above its diagonal
        product = np.zeros((len(a[rows]), len(b) - low))
        i = j = p = None
        for k in range(1, len(steps)):
            part = slice(steps[k - 1], steps[k])
            if p is None:
                product += a[rows, part] @ b[low:, part].T
                alive = product + np.outer(rest_a[k][rows], rest_b[k][low:]) >= least
                if same:
                    alive &= np.arange(low, len(b)) > np.arange(top, top + len(product))[:, None]
                count = np.count_nonzero(alive)
                if count == 0:
                    break
                if k == len(steps) - 1 or count < 0.05 * alive.size:
                    i, j = np.nonzero(alive)
                    p = product[i, j]
                    i, j = i + top, j + low
            else:
                p = p + np.einsum("ij,ij->i", a[i, part], b[j, part])
                alive = p + rest_a[k][i] * rest_b[k][j] >= least
                i, j, p = i[alive], j[alive], p[alive]
                if len(i) == 0:
                    break
        if p is None or len(i) == 0:
            continue
        sure = p >= threshold + CLOSE
        for k in np.flatnonzero(~sure):
            sure[k] = given(i[k], j[k])
        if sure.any():
            yield i[sure], j[sure]


def _compare(batches: Iterator[pa.RecordBatch], basis: dict[int, np.ndarray], threshold: float):
    """One row per class that has a link in a pair of tiles: class, links, node, root."""
    for batch in batches:
        for row in batch.to_pylist():
            read = lambda c, kind, s: np.frombuffer(row[f"{c}_{s}"], kind)  # noqa: B023, E731
            vectors = [read("vectors", "<f8", s).reshape(-1, row["size"]) for s in "ab"]
            a, b = (_rotated(units(v), basis) for v in vectors)
            same = row["a"] == row["b"]
            first = 0 if same else len(a)
            classes, reps = (
                read(c, "<i8", "a") if same else np.concatenate([read(c, "<i8", s) for s in "ab"]) for c in ("classes", "reps")
            )
            wa, wb = (read("weights", "<i8", s) for s in "ab")
            links, forest = np.zeros(len(reps), np.int64), _Forest(len(reps))
            exact = lambda i, j: cosine(vectors[0][i], vectors[1][j]) >= threshold  # noqa: B023, E731
            for i, j in linked_rows(a, b, threshold, same, exact):
                np.add.at(links, i, wb[j])
                np.add.at(links, first + j, wa[i])
                forest.join(i, first + j)
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[found]) for x in (classes, links, reps, reps[forest.root])], _FOUND
            )


def _expand(batches: Iterator[pa.RecordBatch]):
    """The classes of tiles of which all rows are linked to ``extra`` others, or to all of their own tile."""
    for batch in batches:
        for row in batch.to_pylist():
            classes, reps, weights = (np.frombuffer(row[c], "<i8") for c in ("classes", "reps", "weights"))
            links = row["extra"] + (row["weight"] - weights if row["own"] else np.zeros_like(weights))
            root = np.full(len(reps), row["lead"])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (classes, links, reps, root)], _FOUND)


def vector_links(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile_rows: int = TILE,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two vectors are linked when their labels are equal and not null, they have as many components and their
    cosine, in double precision, is at least ``threshold`` (above 0). ``n_links`` counts the other rows that
    a row is linked to, ``component_id`` is the smallest id that links lead to, itself included, ``kept``
    tells whether that is its own.

    A vector that is null, empty, all zero or holds a null or non-finite component, and one without a label,
    has no links and is its own component. Rows without an id have no links, a null component and aren't
    kept. Repeated rows and copies each count as a vector; rows with one id are one node of the components.
    Long vectors make smaller tiles. An empty table gives none. Other columns aren't read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark, stages = vectors.sparkSession, Stages(vectors.sparkSession, "vectors")
    reach, angle = math.sqrt(2 - 2 * threshold) + SLACK, math.acos(threshold)
    given = vectors.select(column(id_col).cast("long").alias("id"), column(label_col).alias("label"), column(vector_col).alias("v"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("v"))
    keys = {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("second"), "v")}
    classes = given.where(usable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = classes.withColumns({"class": F.monotonically_increasing_id(), "dim": F.size("v")})
    classes = stages.write(classes, "classes")
    basis = spark.sparkContext.broadcast(bases(classes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    cells = classes.mapInArrow(lambda it: _cells(it, basis.value, reach), f"{schema}, cell binary")
    order = ["label", "dim", "cell", "rep", "class"]
    sorted_ = stages.write(cells, "cells").repartitionByRange(*order).sortWithinPartitions(*order)
    label = classes.schema["label"].dataType.simpleString()
    tiles = sorted_.mapInArrow(lambda it: _cut(it, basis.value, tile_rows), f"label {label}, {_TILE_SCHEMA}")
    tiles = stages.write(tiles, "tiles")
    pairs = stages.write(_near_tiles(tiles, reach, angle), "pairs")

    some = pairs.where("not whole").select("a", "b")
    both = _with_vectors(_with_vectors(some, tiles, "a"), tiles, "b")
    # As many parts as there are pairs to compare, up to a limit: a pair is up to a second of work.
    both = both.repartition(max(1, min(20_000, some.count())), "a", "b")
    compared = both.mapInArrow(lambda it: _compare(it, basis.value, threshold), _FOUND_SCHEMA)
    whole = pairs.where("whole")
    extra = lambda w: F.expr(f"if(a = b, 0L, {w})")
    sides = [whole.select(F.col(t).alias("tile"), extra(w).alias("extra"), F.expr("a = b").alias("own")) for t, w in (("a", "wb"), ("b", "wa"))]
    sides = sides[0].union(sides[1]).groupBy("tile").agg(F.sum("extra").alias("extra"), F.max("own").alias("own"))
    expanded = tiles.select("tile", "weight", "lead", "classes", "reps", "weights").join(sides, "tile")
    found = stages.write(compared.union(expanded.mapInArrow(_expand, _FOUND_SCHEMA)), "found")

    links = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    parts = components(links.union(whole.select("la", "lb")), stages).withColumnRenamed("label", "component_id")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    each = classes.select("label", "class", "rep", "n", *[e.alias(k) for k, e in keys.items()]).join(counts, "class", "left")
    each = each.join(parts, each["rep"] == parts["node"], "left").select(
        "label", *keys, "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    answers = stages.write(each, "answers")
    stages.drop(classes, tiles, pairs, found)
    return _back(given, usable, keys, answers).withColumnRenamed("id", id_col)


def _back(given: DataFrame, usable: Column, keys: dict[str, Column], answers: DataFrame) -> DataFrame:
    """The answer of its class for every row.

    A class may hold a third of all rows: those above a thousandth are broadcast (fewer than ``HOT`` rows),
    and their rows go through the other join by a hash of their id, where they match nothing.
    """
    limit = (answers.agg(F.sum("n")).first()[0] or 0) / HOT
    answer = ["n_links", "component_id"]
    rows = given.where(usable).select("id", "label", *[e.alias(k) for k, e in keys.items()])
    same = ["label", *keys]
    hot = answers.where(F.col("n") > limit).select(*same, F.struct(*answer).alias("hot"))
    rows = rows.join(F.broadcast(hot), same, "left")
    done = F.col("hot").isNotNull()
    rows = rows.withColumns({"label": F.when(~done, F.col("label")), "k1": F.when(done, F.xxhash64("id")).otherwise(F.col("k1"))})
    cold = answers.where(F.col("n") <= limit).select(*same, F.struct(*answer).alias("cold"))
    rows = rows.join(cold, same, "left").withColumn("found", F.coalesce("hot", "cold"))
    rows = rows.select("id", "found.n_links", "found.component_id")
    alone = given.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return rows.union(alone).select("*", kept)

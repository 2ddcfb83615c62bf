"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles. The weight is ``(1 + ln tf) * idf``. Document frequencies
are counted over all distinct texts into a table of fixed size, two hash rows of 2**18 cells whose smaller
cell counts; a shingle in up to one document of twenty has idf 1, and the more it recurs beyond that the
less it weighs, at every input size alike (the first ``FREE`` documents don't count, or in a table of a
few dozen texts any two that are alike would make their shingles common). Consistent weighted sampling draws for each of
``BANDS * ROWS`` seeds the element that two sets share with the probability of their weighted Jaccard
similarity; equal bands make candidates, and the exact similarity of the full texts decides.

The larger a group of near copies is, the less its shared shingles weigh against the words that differ. With
``plain``, texts are linked too when their similarity without idf reaches the limit, so that the size of the
group doesn't matter. A text with a shingle of idf below 1 has bands by these weights besides; for all others
they are the same.

Buckets may hold thousands of texts. Each text is first compared with the smallest of its bucket. Only
where a bucket still has several components are the texts outside its largest one compared with all others
of the bucket, block by block inside tasks, through an index of their shingles: no link between components
is lost, no group of alike texts is expanded into rows of pairs, and no block grows with the bucket. Exact
copies are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, column, slices
from .components import components
from .words import distinct, mix, windows, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 11, 4
COMMON = 0.05  # of all documents: up to here a shingle has the full weight
FREE = 20
CELLS, PARTS = 1 << 18, 64
HOT = 200  # classes of copies above a 200th of all rows, of which there can't be more than that

BLOCK_STRAYS, BLOCK_MEMBERS = 256, 1024  # texts of a bucket that are compared in one call

_GOLDEN = 0x9E3779B97F4A7C15


# -- weights ----------------------------------------------------------------------------------------


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    return low, ((hashes >> np.uint64(40)) & np.uint64(CELLS - 1)).astype(np.int64) + CELLS


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, starts = word_hashes(texts)
    return distinct(*windows(words, starts, SHINGLE))


def idf_of(table: np.ndarray, n_docs: int, hashes: np.ndarray) -> np.ndarray:
    """Inverse document frequency, 1 up to ``COMMON`` of the documents and falling from there."""
    one, two = _cells(hashes)
    often = np.minimum(table[one], table[two]) - FREE
    share = np.maximum(often / max(n_docs, 1), 1e-12)
    return np.minimum(1.0, np.log1p(1 / share) / np.log1p(1 / COMMON))


def weights(table: np.ndarray, n_docs: int, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf_of(table, n_docs, hashes)


def _count_shingles(batches: Iterator[pa.RecordBatch]):
    """The table of document frequencies of one partition, in parts."""
    table = np.zeros(2 * CELLS)
    for batch in slices(batches, "text"):
        hashes, _, _ = _shingles(batch.column("text"))
        for cells in _cells(hashes):
            table += np.bincount(cells, minlength=2 * CELLS)
    if table.any():
        parts = [pa.compress(p.tobytes(), "zstd", asbytes=True) for p in table.reshape(PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "cells"])


def _add_parts(frame: pd.DataFrame) -> pd.DataFrame:
    size = 2 * CELLS // PARTS
    total = np.zeros(size)
    for cells in frame["cells"]:
        total += np.frombuffer(pa.decompress(cells, size * 8, "zstd", asbytes=True))
    return pd.DataFrame({"part": frame["part"].iloc[:1], "cells": [total.astype(np.float32).tobytes()]})


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Document frequencies of all shingles of the columns digest and text. The table has a fixed size.

    Copies of a text count once, however many there are: tasks keep one before the texts are shuffled.
    """
    once = texts.select("digest", "text").dropDuplicates(["digest"]).select("text")
    parts = once.mapInArrow(_count_shingles, "part int, cells binary")
    table = np.zeros((PARTS, 2 * CELLS // PARTS), np.float32)
    for row in parts.groupBy("part").applyInPandas(_add_parts, "part int, cells binary").collect():
        table[row.part] = np.frombuffer(row.cells, np.float32)
    return table.reshape(-1)


# -- sampling ---------------------------------------------------------------------------------------


def sample(hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray, seeds: int) -> np.ndarray:
    """Improved consistent weighted samples: for each set (a run from ``starts``) and seed one number.

    For an element of weight w: r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from its hash and the seed,
    t = floor(ln w / r + b), y = exp(r * (t - b)), a = c / (y * exp(r)). The element with the smallest a
    is drawn, together with its t.

    With r = -ln(u0 u1) and c = -ln(1 - v2) - ln(1 - v3) an element's a is at least u0 u1 (v2 + v3) / w. The
    smallest a of a set is exponential with the rate of its total weight, so it is nearly always below ``REACH``
    divided by that: the rest is worked out for elements only whose bound, by the first 16 bits of each uniform
    number, is below too, and for whole sets in which none turns out to be.
    """
    out = np.empty((len(starts), seeds), np.uint64)
    sizes = np.diff(np.append(starts, len(hashes)))
    log_w = np.log(weight).astype(np.float32)
    reach = REACH / np.add.reduceat(weight, starts)
    log_reach = np.log(reach)
    limit = (np.repeat(reach, sizes) * weight * (1.001 * 2.0**48)).astype(np.float32)
    coarse, spare = np.empty(len(hashes), np.uint64), np.empty(len(hashes), np.uint64)
    bound, other = np.empty(len(hashes), np.float32), np.empty(len(hashes), np.float32)
    quarters = [coarse.view(np.uint16)[q::4] for q in range(4)]

    def draw(at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of elements from ``begins``: the place of the smallest a, its logarithm, its t."""
        more = mix(coarse[at] + np.uint64(_GOLDEN))
        fine = more.view(np.uint16)
        u = [(quarters[q][at] + (fine[q::4] + _HALF) * _SCALE) * _SCALE for q in range(4)]
        r = -np.log(u[0] * u[1])
        r += np.float32(1e-6)
        c = -np.log1p(-np.minimum(u[2], _BELOW)) - np.log1p(-np.minimum(u[3], _BELOW))
        b = (mix(more ^ hashes[at]) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w[at] / r + b)
        a = np.log(c) - r * (t - b) - r
        bits = a.view(np.int32).astype(np.int64)
        key = ((bits ^ ((bits >> 31) & 0x7FFFFFFF)) << 32) | np.arange(len(at))
        won = np.minimum.reduceat(key, begins) & 0xFFFFFFFF
        return at[won], a[won], t[won]

    drawn, turn, sure = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.float32), np.zeros(len(starts), bool)
    for k in range(seeds):
        np.multiply(hashes, np.uint64((2 * k + 1) * _GOLDEN % (1 << 64)), out=coarse)
        for shift, factor in _ROUNDS:
            coarse ^= np.right_shift(coarse, shift, out=spare)
            coarse *= factor
        coarse ^= np.right_shift(coarse, np.uint64(32), out=spare)
        np.multiply(quarters[0], quarters[1], out=bound, dtype=np.float32)
        np.add(quarters[2], quarters[3], out=other, dtype=np.float32)
        bound *= other
        at = np.flatnonzero(bound <= limit)
        begins = np.searchsorted(at, starts)
        some = np.diff(np.append(begins, len(at))) > 0
        sure[:] = False
        if len(at):
            drawn[some], least, turn[some] = draw(at, begins[some])
            sure[some] = least <= log_reach[some]
        if not sure.all():
            n = sizes[~sure]
            begins = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(starts[~sure] - begins, n)
            drawn[~sure], _, turn[~sure] = draw(at, begins)
        out[:, k] = mix(hashes[drawn] ^ (turn.astype(np.int64).view(np.uint64) * np.uint64(_GOLDEN)))
    return out


REACH = 6.0
_HALF, _SCALE, _BELOW = np.float32(0.5), np.float32(2.0**-16), np.float32(1 - 2.0**-24)
_ROUNDS = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(29), np.uint64(0x94D049BB133111EB)))


def _keys(hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bands of each set, one row per set."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    for i, j in _chunks(starts, len(hashes)):
        lo, hi = starts[i], starts[j] if j < len(starts) else len(hashes)
        drawn = sample(hashes[lo:hi], weight[lo:hi], starts[i:j] - lo, BANDS * ROWS)
        band = np.zeros((j - i, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            band = mix(band + drawn[:, r::ROWS])
        keys[i:j] = band
    return keys


def _bands(batches: Iterator[pa.RecordBatch], table: np.ndarray, n_docs: int, hot: frozenset, plain: bool):
    """(digest, doc_id, keys): the bands of every text; of a hot class, of one row per partition."""
    seen: set[str] = set()
    for batch in slices(batches, "text"):
        digests = batch.column("digest").to_pylist()
        take = []
        for d in digests:
            take.append(d not in seen)
            if d in hot:
                seen.add(d)
        batch = batch.filter(pa.array(take, pa.bool_()))
        hashes, owner, counts = _shingles(batch.column("text"))
        if len(hashes) == 0:
            continue
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        weight = weights(table, n_docs, hashes, counts)
        keys = _keys(hashes, weight, starts)
        n_keys = np.full(len(starts), BANDS)
        if plain:
            bare = 1 + np.log(counts)
            common = np.logical_or.reduceat(weight != bare, starts)
            if common.any():
                sizes = np.diff(np.append(starts, len(hashes)))
                of = np.repeat(common, sizes)
                more = _keys(hashes[of], bare[of], np.cumsum(sizes[common]) - sizes[common])
                place = np.concatenate([np.arange(len(starts)), np.flatnonzero(common)])
                keys = np.concatenate([keys, more])[np.argsort(place, kind="stable")]
                n_keys[common] += BANDS
        at = pa.array(owner[starts])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("digest").take(at),
                batch.column("doc_id").take(at),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n_keys)]), pa.int32()),
                    pa.array(keys.reshape(-1).view(np.int64)),
                ),
            ],
            ["digest", "doc_id", "keys"],
        )


def _chunks(starts: np.ndarray, n: int, size: int = 1 << 15) -> list[tuple[int, int]]:
    """Runs of whole sets with about ``size`` elements, so that arrays stay in the processor's cache."""
    cuts = np.searchsorted(starts, np.arange(0, n, size))
    cuts = np.unique(np.concatenate([cuts, [0, len(starts)]]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


# -- exact similarity -------------------------------------------------------------------------------


def _measures(table: np.ndarray, n_docs: int, hashes: np.ndarray, counts: np.ndarray, plain: bool) -> list[np.ndarray]:
    """The weights by which two texts may be alike."""
    weight = weights(table, n_docs, hashes, counts)
    return [weight, 1 + np.log(counts)] if plain else [weight]


def _similar(batches: Iterator[pa.RecordBatch], table: np.ndarray, n_docs: int, least: float, plain: bool):
    """(a, b) of the pairs whose texts have at least this weighted Jaccard similarity, with or (plain) without idf."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        texts: dict[int, str] = {}
        for ids, name in ((a, "text_a"), (b, "text_b")):
            for k, i in enumerate(ids.tolist()):
                if i not in texts:
                    texts[i] = batch.column(name)[k].as_py()
        nodes = list(texts)
        hashes, owner, counts = _shingles(pa.array([texts[i] for i in nodes], pa.string()))
        measures = _measures(table, n_docs, hashes, counts, plain)
        cuts = np.searchsorted(owner, np.arange(len(nodes) + 1))
        at = {i: (cuts[k], cuts[k + 1]) for k, i in enumerate(nodes)}
        good = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            (p, q), (u, v) = at[x], at[y]
            _, i, j = np.intersect1d(hashes[p:q], hashes[u:v], assume_unique=True, return_indices=True)
            alike = False
            for weight in measures:
                shared = np.minimum(weight[p:q][i], weight[u:v][j]).sum()
                union = weight[p:q].sum() + weight[u:v].sum() - shared
                alike = alike or bool(union > 0 and shared >= (least - 1e-9) * union)
            good.append(alike)
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(mask)


def _verify(pairs: DataFrame, texts: DataFrame, spark_table, n_docs: int, least: float, plain: bool) -> DataFrame:
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda it: _similar(_small(it), spark_table.value, n_docs, least, plain), "a bigint, b bigint")


def _small(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from slices([batch], "text_a")


# -- the operator -----------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    plain: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, the smallest doc_id of the near-duplicates it is among.

    Classes are the connected components of the links between texts of at least this similarity; with
    ``plain``, also of those that have it without idf, as copies in a group of any size do. Exact
    copies of a text are in one class, texts without a word too; a row with a null text or a null id is a
    class of its own (class_id = doc_id). Rows of one id are in one class. Texts of fewer than five words
    are one shingle. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "near-duplicates")
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    members = rows.select("doc_id", F.md5("text").alias("digest"))
    usable = rows.where("doc_id is not null and text is not null").withColumn("digest", F.md5("text"))
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    classes = stages.write(classes, "classes")
    n_rows, n_docs = classes.agg(F.sum("n"), F.count("*")).first()
    n_rows = n_rows or 0
    kept = frozenset(r.digest for r in classes.where(F.col("n") > max(1, n_rows / HOT)).collect())

    frequencies = spark.sparkContext.broadcast(document_frequencies(usable))
    bands = usable.mapInArrow(
        lambda it: _bands(it, frequencies.value, n_docs, kept, plain), "digest string, doc_id bigint, keys array<bigint>"
    )
    bands = stages.write(bands, "bands")
    texts_of = bands.groupBy("digest").agg(F.any_value("keys").alias("keys"))
    keyed = texts_of.join(classes.select("digest", "node"), "digest")
    keyed = stages.write(keyed.select("node", "digest", F.explode(F.array_distinct("keys")).alias("key")), "keyed")
    buckets = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    buckets = stages.write(buckets.where("pivot <> last").select("key", "pivot"), "buckets")
    candidates = stages.write(keyed.join(buckets, "key").select("key", "pivot", "node", "digest"), "candidates")

    wanted = candidates.select("node", "digest").distinct()
    texts = usable.join(
        wanted.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi"
    ).dropDuplicates(["doc_id", "digest"])
    texts = stages.write(texts.select(F.col("doc_id").alias("node"), "text"), "texts")

    stars = candidates.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = stages.write(stars, "pairs")
    links = stages.write(_verify(stars, texts, frequencies, n_docs, similarity, plain), "verified")
    found = components(links, stages)

    more = stages.write(_cross_links(candidates, found, texts, frequencies, n_docs, similarity, plain), "crossed")
    if not more.isEmpty():
        found = components(links.union(more), stages)
    stages.drop(bands, keyed, buckets, candidates, texts)

    named = classes.join(found, "node", "left").select(
        "digest", "node", F.coalesce("label", "node").alias("class_id")
    )
    # rows of one id with several texts unite what their texts are in
    out = members.join(stages.write(named, "named"), "digest", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _cross_links(
    candidates: DataFrame, found: DataFrame, texts: DataFrame, table, n_docs: int, least: float, plain: bool = False
) -> DataFrame:
    """Links (a, b) between components that meet in a bucket.

    Of each such bucket, the texts outside the largest component ("strays") are compared with all texts.
    Both are dealt out by hash into blocks, and every pair of blocks is one group. A bucket of one
    component, as nearly all are after the first comparison, gives none.
    """
    labelled = candidates.join(found, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"),
        F.ceil(F.sum("n") / BLOCK_MEMBERS).alias("chunks"),
        F.ceil((F.sum("n") - F.max("n")) / BLOCK_STRAYS).alias("blocks"),
    )
    rows = labelled.join(mixed.where("blocks > 0"), "key").join(texts, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    place = lambda block, chunk, stray: F.struct(block.alias("block"), chunk.alias("chunk"), stray.alias("stray"))
    as_member = F.transform(every("blocks"), lambda b: place(b, deal("chunks"), F.lit(False)))
    as_stray = F.transform(every("chunks"), lambda c: place(deal("blocks"), c, F.lit(True)))
    places = F.when(F.col("label") == F.col("main"), as_member).otherwise(F.concat(as_member, as_stray))
    main = (F.col("label") == F.col("main")).alias("main")
    dealt = rows.select("key", "node", "label", "text", main, F.explode(places).alias("at"))
    group = ["key", "block", "chunk"]
    dealt = dealt.select("key", "at.block", "at.chunk", "at.stray", "node", "label", "main", "text")
    ordered = dealt.repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInArrow(
        lambda it: _compare_groups(it, table.value, n_docs, least, plain), "a bigint, b bigint"
    ).distinct()


def _group_starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where each group of rows of equal key, block and chunk starts, and the end."""
    at = [batch.column(c).to_numpy() for c in ("key", "block", "chunk")]
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in at])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]])


def _compare_groups(batches: Iterator[pa.RecordBatch], table: np.ndarray, n_docs: int, least: float, plain: bool):
    """Links (a, b) of all groups, from rows sorted by group; the last group of a slice waits for its other rows."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in slices(batches, "text"):
        if not batch.num_rows:
            continue
        if held and len(_group_starts(joined([held[-1].slice(held[-1].num_rows - 1), batch]))) == 2:
            held.append(batch)  # all of the group that waits
            continue
        batch = joined([*held, batch])
        last = int(_group_starts(batch)[-2])
        if last:
            yield _compare_blocks(batch.slice(0, last), table, n_docs, least, plain)
        held = [batch.slice(last)]
    if held:
        yield _compare_blocks(joined(held), table, n_docs, least, plain)


def _compare_blocks(batch: pa.RecordBatch, table: np.ndarray, n_docs: int, least: float, plain: bool) -> pa.RecordBatch:
    """Links between the strays and the members of each group that are in different components.

    A text with less than ``least`` of another's weight is not alike it, so most pairs are settled by their totals;
    others are compared one by one, or through an index of the strays' shingles where a member has many. Of two
    strays one looks at the other.
    """
    links: list[tuple[int, int]] = []
    text = batch.column("text").dictionary_encode()
    code, n_texts = text.indices.to_numpy(), len(text.dictionary)
    hashes, owner, counts = _shingles(text.dictionary)
    measures = _measures(table, n_docs, hashes, counts, plain)
    totals = [np.bincount(owner, weight, n_texts)[code] for weight in measures]
    cuts = np.searchsorted(owner, np.arange(n_texts + 1)).tolist()
    stray, main = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "main"))
    nodes, labels = batch.column("node").to_numpy(), batch.column("label").to_numpy()
    starts = _group_starts(batch).tolist()
    for begin, end in zip(starts[:-1], starts[1:], strict=True):
        rows = np.arange(begin, end)
        strays, members = rows[stray[begin:end]], rows[~stray[begin:end]]
        may = np.zeros((len(members), len(strays)), bool)
        for total in totals:
            one, two = total[members][:, None], total[strays][None, :]
            may |= np.minimum(one, two) * (1 + 1e-9) >= (least - 1e-9) * np.maximum(one, two)
        may &= labels[members][:, None] != labels[strays][None, :]
        may &= main[members][:, None] | (nodes[members][:, None] > nodes[strays][None, :])
        index = None
        for k in np.flatnonzero(may.any(1)).tolist():
            member, wanted = int(members[k]), strays[may[k]]
            p, q = cuts[code[member]], cuts[code[member] + 1]
            if len(wanted) > FEW:
                index = index or _Index(code[strays], cuts, hashes, measures)
                shared = [x[may[k]] for x in index.shared(hashes[p:q], [weight[p:q] for weight in measures])]
            else:
                shared = np.zeros((len(measures), len(wanted)))
                for j, c in enumerate(code[wanted].tolist()):
                    u, v = cuts[c], cuts[c + 1]
                    at = np.minimum(np.searchsorted(hashes[u:v], hashes[p:q]), max(v - u - 1, 0))
                    both = np.flatnonzero(hashes[u:v][at] == hashes[p:q]) if v > u else np.zeros(0, np.int64)
                    for i, weight in enumerate(measures):
                        shared[i, j] = np.minimum(weight[u:v][at[both]], weight[p:q][both]).sum()
            good = np.zeros(len(wanted), bool)
            for common, total in zip(shared, totals, strict=True):
                union = total[wanted] + total[member] - common
                good |= (union > 0) & (common >= (least - 1e-9) * union)
            node = int(nodes[member])
            links += [(min(node, x), max(node, x)) for x in nodes[wanted[good]].tolist()]
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


FEW = 8  # comparisons of a member one by one


class _Index:
    """The shingles of several texts, each with the texts that have it."""

    def __init__(self, codes: np.ndarray, cuts: list[int], hashes: np.ndarray, measures: list[np.ndarray]):
        spans = [np.arange(cuts[c], cuts[c + 1]) for c in codes.tolist()]
        places = np.concatenate(spans)
        order = np.argsort(hashes[places], kind="stable")
        places = places[order]
        self.n = len(codes)
        self.owner = np.repeat(np.arange(self.n), [len(s) for s in spans])[order]
        self.weights = [weight[places] for weight in measures]
        self.kinds, self.first = np.unique(hashes[places], return_index=True)
        self.many = np.diff(np.append(self.first, len(places)))

    def shared(self, hashes: np.ndarray, measures: list[np.ndarray]) -> list[np.ndarray]:
        """For each measure, the weight that a text has in common with each text of the index."""
        if not len(self.kinds):
            return [np.zeros(self.n) for _ in measures]
        at = np.minimum(np.searchsorted(self.kinds, hashes), len(self.kinds) - 1)
        both = np.flatnonzero(self.kinds[at] == hashes)
        n = self.many[at[both]]
        begin = np.repeat(self.first[at[both]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = self.owner[begin]
        return [
            np.bincount(own, np.minimum(held[begin], np.repeat(weight[both], n)), self.n)
            for held, weight in zip(self.weights, measures, strict=True)
        ]


def keep_one(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    plain: bool = False,
) -> DataFrame:
    """The rows of ``docs``, with all columns, of which one per class stays: that with the smallest id.

    Rows without an id or a text all stay; of repeated rows with the kept id one stays.
    """
    ident, text = column(id_col), column(text_col)
    classes = near_duplicates(docs, similarity, id_col, text_col, plain)
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    kept = Stages(docs.sparkSession, "kept").write(kept, "kept")
    whole = docs.where(ident.isNotNull() & text.isNotNull())
    one = whole.join(kept, ident.cast("long") == kept["_kept"], "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.where(ident.isNull() | text.isNull()))

"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects in a window; positions it ignores may differ.
Seeds of all benchmark items and of all documents are joined, each join names a diagonal (place in the
document less place in the item), and the words along the diagonal are compared, so substitutions are
tolerated: a run counts when at least 80 % of its words match, and of all such runs the one with the most
matches decides.

Documents are read once. A bit table of fixed size, made of all benchmark seeds, lets a task skip nearly
all places before anything is shuffled; what passes is joined exactly. Documents with such a place, and
no others, are written to the shared folder as word hashes, to be compared along the diagonals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, column, slices
from .words import mix, word_hashes

#: Fixed masks: 1 selects a word, 0 ignores it.
MASKS = ("1110111", "110110011", "11010010011", "101100011001")
#: Masks for short items only, with the numbers of words of these: together with ``MASKS`` they leave a seed wherever
#: the words stand that needn't match. Of items of up to ``WHOLE`` words all must match, so their seed is the item.
SHORT_MASKS = (
    ("1", (1,)),
    ("11", (2,)),
    ("111", (3,)),
    ("1111", (4,)),
    ("111", (5,)),
    ("1101", (5,)),
    ("1111", (6, 10, 11)),
    ("110011", (6,)),
    ("11011", (7, 8, 10, 11)),
)
WHOLE = 4
LEAST_WORDS = 12  # that must match; of shorter items 80 %
DENSITY = 0.8
BITS = 1 << 24  # of the table
_PARTS = 64
_GOLDEN = 0x9E3779B97F4A7C15


def plain(word: str) -> str:
    """A word in lower case, without punctuation at its ends; of punctuation alone nothing is taken off."""
    return word.lower().strip(".,;:!?\"'()[]{}…«»„“”‚‘’") or word


def masks_for(lengths: Iterable[int]) -> list[tuple[int, str, tuple[int, ...]]]:
    """The masks that a benchmark with items of these numbers of words needs: number, mask and, of a mask for short
    items, their numbers of words. Numbers are part of the seeds."""
    short = set(lengths)
    return [(m + 1, mask, ()) for m, mask in enumerate(MASKS)] + [
        (len(MASKS) + m + 1, mask, own) for m, (mask, own) in enumerate(SHORT_MASKS) if short & set(own)
    ]


def seeds(words: np.ndarray, starts: np.ndarray, masks) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, ...]]]:
    """For each mask: the seed at each place of the concatenated texts, whether it ends in its text, and the numbers
    of words of the items it is for (none: all)."""
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(len(words))
    for number, mask, own in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, np.uint64), np.zeros(0, bool), own
            continue
        out = np.full(n, number, np.uint64)
        for k, taken in enumerate(mask):
            if taken == "1":
                out *= np.uint64(_GOLDEN)
                out += words[k : k + n]
        yield mix(out), at[:n] + len(mask) <= ends[:n], own


def _bits(seed: np.ndarray) -> list[np.ndarray]:
    return [((seed >> np.uint64(s)) & np.uint64(BITS - 1)).astype(np.int64) for s in (0, 20, 40)]


# -- the benchmark ----------------------------------------------------------------------------------


def _item_seeds(batches: Iterator[pa.RecordBatch], least: int):
    for batch in slices(batches, "text"):
        words, starts = word_hashes(batch.column("text"), plain)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        length = np.diff(starts)
        for seed, inside, sizes in seeds(words, starts, masks_for(length.tolist())):
            at = np.flatnonzero(inside)
            at = at[length[owner[at]] >= least]
            if sizes:
                at = at[np.isin(length[owner[at]], sizes)]
            own = owner[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[at].view(np.int64)), batch.column("item_id").take(pa.array(own)), pa.array(at - starts[own])],
                ["seed", "item_id", "item_place"],
            )


def _item_words(batches: Iterator[pa.RecordBatch]):
    for batch in slices(batches, "text"):
        words, starts = word_hashes(batch.column("text"), plain)
        data = [words[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(data, pa.binary())], ["item_id", "item_words"])


def _bit_parts(batches: Iterator[pa.RecordBatch]):
    table = np.zeros(BITS, bool)
    for batch in batches:
        for at in _bits(batch.column("seed").to_numpy().view(np.uint64)):
            table[at] = True
    if table.any():
        parts = [pa.compress(np.packbits(p).tobytes(), "zstd", asbytes=True) for p in table.reshape(_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "bits"])


def _join_bits(frame):
    import pandas as pd

    size = BITS // 8 // _PARTS
    total = np.zeros(size, np.uint8)
    for bits in frame["bits"]:
        total |= np.frombuffer(pa.decompress(bits, size, "zstd", asbytes=True), np.uint8)
    return pd.DataFrame({"part": frame["part"].iloc[:1], "bits": [pa.compress(total.tobytes(), "zstd", asbytes=True)]})


def bit_table(item_seeds: DataFrame) -> np.ndarray:
    """A table of ``BITS`` bits with three set for each seed. Its size doesn't grow with the benchmark."""
    parts = item_seeds.select("seed").mapInArrow(_bit_parts, "part int, bits binary")
    size = BITS // 8 // _PARTS
    table = np.zeros((_PARTS, size), np.uint8)
    for row in parts.groupBy("part").applyInPandas(_join_bits, "part int, bits binary").collect():
        table[row.part] = np.frombuffer(pa.decompress(row.bits, size, "zstd", asbytes=True), np.uint8)
    return np.unpackbits(table.reshape(-1)).view(bool)


# -- the documents ----------------------------------------------------------------------------------


def _document_hits(batches: Iterator[pa.RecordBatch], table: np.ndarray, masks):
    """Documents with a place whose seed may be one of the benchmark's: their words and those places. Of a seed that is
    a whole item, only its first place in a document is needed."""
    row_id = TaskContext.get().partitionId() << 33
    for batch in slices(batches, "text"):
        words, starts = word_hashes(batch.column("text"), plain)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        found_at, found = [], []
        for seed, inside, sizes in seeds(words, starts, masks):
            at = np.flatnonzero(inside)
            for bits in _SHIFTS:
                at = at[table[((seed[at] >> bits) & np.uint64(BITS - 1)).astype(np.int64)]]
            if sizes and max(sizes) <= WHOLE:
                order = np.lexsort((at, seed[at], owner[at]))
                own, held = owner[at][order], seed[at][order]
                at = at[order[np.concatenate([np.ones(min(len(at), 1), bool), (own[1:] != own[:-1]) | (held[1:] != held[:-1])])]]
            found_at.append(at)
            found.append(seed[at])
        at, seed = np.concatenate(found_at), np.concatenate(found)
        own = owner[at]
        order = np.argsort(own, kind="stable")
        at, seed, own = at[order], seed[order], own[order]
        docs = np.unique(own)
        cuts = np.searchsorted(own, docs, "left").tolist() + [len(own)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row_id + docs),
                batch.column("doc_id").take(pa.array(docs)),
                batch.column("digest").take(pa.array(docs)),
                pa.array([words[starts[d] : starts[d + 1]].tobytes() for d in docs], pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(seed.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at - starts[own], pa.int64())),
            ],
            ["row_id", "doc_id", "digest", "doc_words", "seeds", "places"],
        )
        row_id += batch.num_rows


_SHIFTS = tuple(np.uint64(s) for s in (0, 20, 40))


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Start in the document, length and matches of the best run along a diagonal.

    A match scores 1 - DENSITY and a mismatch -DENSITY, so a run is dense enough if its sum isn't negative.
    Of these the run with the most matches counts; ties go to the shortest, then to the first. The widest run
    to an end starts at the first prefix whose sum isn't larger, which is a new low of all sums so far.
    """
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = np.asarray(doc[lo:hi] == item[lo - diagonal : hi - diagonal], bool)
    at = np.flatnonzero(same)
    if len(at) == 0:
        return lo, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 10 - round(10 * DENSITY), -round(10 * DENSITY)))])
    low = np.minimum.accumulate(total)
    stop = at + 1
    start = np.searchsorted(-low, -total[stop])
    first = np.searchsorted(at, start)  # mismatches at the start are left out
    matches = np.arange(1, len(at) + 1) - first
    start = at[first]
    k = np.lexsort((start, stop - start, -matches))[0]
    return lo + int(start[k]), int(stop[k] - start[k]), int(matches[k])


def _compare(batches: Iterator[pa.RecordBatch]):
    names = ["row_id", "doc_id", "digest", "item_id", "doc_start", "item_start", "n_words", "n_matches"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            doc, item = np.frombuffer(r["doc_words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
            start, length, matches = best_run(doc, item, r["diagonal"])
            if matches >= min(LEAST_WORDS, -(-8 * len(item) // 10)):
                rows.append((r["row_id"], r["doc_id"], r["digest"], r["item_id"], start, start - r["diagonal"], length, matches))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    least_item_words: int = 1,
) -> DataFrame:
    """One row per row of ``docs`` and item that it overlaps with, at the best place.

    Columns: doc_id, item_id, doc_start and item_start (words), n_words and n_matches of the run, digest
    (md5 of the text) and row_id (any number, one per row of ``docs``). At least ``LEAST_WORDS`` words
    match, of shorter items four in five, rounded up: items of up to 4 words are found where all of them stand
    together. Items of fewer than ``least_item_words`` words are left out. Null texts have no words; null ids are carried through. Repeated rows each give their
    own; ties go to the first place. Empty tables give an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "decontaminate")
    items = benchmark.select(column(item_id_col).cast("long").alias("item_id"), column(item_text_col).alias("text"))
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))

    item_words = stages.write(items.mapInArrow(_item_words, "item_id bigint, item_words binary"), "items")
    size = F.call_function("div", F.octet_length("item_words"), F.lit(8))
    held = item_words.select(size.alias("n")).where(f"n >= {int(least_item_words)} AND n < {LEAST_WORDS}").distinct()
    masks = masks_for(r.n for r in held.collect())  # fewer than 12 rows
    item_seeds = stages.write(items.mapInArrow(lambda it: _item_seeds(it, least_item_words), "seed bigint, item_id bigint, item_place bigint"), "seeds")
    table = spark.sparkContext.broadcast(bit_table(item_seeds))
    hits = stages.write(
        rows.mapInArrow(
            lambda it: _document_hits(it, table.value, masks),
            "row_id bigint, doc_id bigint, digest string, doc_words binary, seeds array<bigint>, places array<bigint>",
        ),
        "hits",
    )
    places = hits.select("row_id", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    places = places.select("row_id", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    diagonals = places.join(item_seeds, "seed").select(
        "row_id", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")
    )
    diagonals = stages.write(diagonals.distinct(), "diagonals")
    both = diagonals.join(hits.drop("seeds", "places"), "row_id").join(item_words, "item_id")
    runs = both.mapInArrow(
        _compare,
        "row_id bigint, doc_id bigint, digest string, item_id bigint, doc_start bigint, item_start bigint, "
        "n_words bigint, n_matches bigint",
    )
    best = F.max_by(
        F.struct("doc_id", "digest", "doc_start", "item_start", "n_words", "n_matches"),
        F.struct(F.col("n_matches"), -F.col("n_words"), -F.col("doc_start")),
    )
    return runs.groupBy("row_id", "item_id").agg(best.alias("b")).select(
        "b.doc_id", "item_id", "b.doc_start", "b.item_start", "b.n_words", "b.n_matches", "b.digest", "row_id"
    )


def keep_unseen(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least_item_words: int = 5, **columns: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text overlaps with no item; null texts stay.

    Items of fewer than ``least_item_words`` words say nothing of where a text is from (``yes`` is in most), so they
    don't drop any.
    """
    found = overlaps(docs, benchmark, text_col=text_col, least_item_words=least_item_words, **columns)
    found = found.select(F.col("digest").alias("_digest")).distinct()
    found = Stages(docs.sparkSession, "seen").write(found, "seen")
    return docs.join(found, F.md5(column(text_col)) == found["_digest"], "left_anti")

"""Ranked lexical search over bit-sliced Bloom signatures.

1. One scan cuts every text into terms and writes the *index*: blocks of documents of like size, each with
   its texts, its numbers of terms and a bit-sliced signature, a bitmap over the documents of the block for
   every position of a Bloom filter. A term sets its positions once for each level of ``LEVELS`` that its
   occurrences reach. The same scan yields the document frequencies, added up per task and then by Spark.
2. For a query the bitmaps of a term's positions are joined by AND, which overestimates the documents that
   hold it so many times; the weighted sum over terms and levels is an upper bound of each score, in whole
   numbers. Only signatures and lengths are read for it.
3. The documents with the highest bounds, ten for each query, are scored exactly; the tenth of these scores
   is a floor that the tenth best document can't be below.
4. Each document whose bound reaches the floor is scored exactly from its text, in the block that holds it.
   No other can be among the ten. Per task and query ten remain, and a window ranks those.

Texts aren't shuffled or sorted. What is broadcast is a block of queries (``QUERY_TERMS``) with its weights and floors.
A block's texts and signature are two compressed values, opened by the worker that looks at the block, one block at
a time; the index has row groups of a few blocks (``GROUPS``), however large the parts of the input are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, column, slices

#: Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII. In UTF-8 all bytes of the
#: latter are above 7F, so the bytes can be searched and lower-cased as they are.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Documents and bytes of text in a block at most (or one document).
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Positions per entry of a signature, and bitmaps per entry.
WIDTH, PROBES = 16, 3
#: Occurrences at which a level begins. The last has no upper end but the document's length.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 11, 16, 24, 48, 128])
#: A block of queries has at most so many of them and so many terms (or is one query).
QUERIES, QUERY_TERMS = 512, 1 << 16
#: Terms that a task holds, and bytes of the texts they are from, before it passes their counts on.
HELD_TERMS, HELD_BYTES = 1 << 18, 32 << 20
#: Row groups of the index: a writer holds one and a reader opens one whole. Left alone, Parquet looks at the size
#: of pages and groups after 100 rows, which here are 100 blocks.
GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16}
#: Terms of a query block that are looked up at a time.
LOOK = 2048


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in UTF-8; only A to Z are lower-cased, a null has none."""
    return TERM.findall(text.translate(_LOWER)) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // n_terms


def _places(codes: np.ndarray, level: int, width: int) -> list[np.ndarray]:
    """The positions of terms, given by a 64-bit code, at a level."""
    out, mixed = [], codes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for _ in range(PROBES):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = mixed ^ (mixed >> np.uint64(32))
        out.append((mixed % np.uint64(width)).astype(np.int64))
    return out


def _codes(words) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


# -- the index --------------------------------------------------------------------------------------

_NAMES = ["kind", "block", "n_docs", "n_terms", "width", "ids", "counts", "slices", "sizes", "texts", "term", "df"]
_SCHEMA = (
    "kind string, block bigint, n_docs bigint, n_terms bigint, width bigint, ids array<bigint>, counts binary, slices binary, "
    "sizes binary, texts binary, term binary, df bigint"
)
_TYPES = [
    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(),
    pa.binary(), pa.binary(), pa.binary(), pa.int64(),
]


@dataclass
class _Block:
    """Documents of like size until they are written."""

    ids: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    entries: list = field(default_factory=list)  # (codes, occurrences) of each
    size: int = 0


def _rows(n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns.get(c, [None] * n), t) for c, t in zip(_NAMES, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _signed(block: _Block, number: int) -> pa.RecordBatch:
    """One row: the block with its signature, a bitmap of documents for each position, and its texts in a row."""
    n = len(block.ids)
    codes, times = (np.concatenate(parts) for parts in zip(*block.entries, strict=True))
    doc = np.repeat(np.arange(n), [len(c) for c, _ in block.entries])
    levels = np.searchsorted(LEVELS, times, "right")
    width = max(64, WIDTH * int(np.bincount(doc, levels).max()))
    signed = np.zeros((width, n), bool)
    for level in range(int(levels.max())):
        here = levels > level
        for places in _places(codes[here], level, width):
            signed[places, doc[here]] = True
    bits = np.packbits(signed, axis=1, bitorder="little")
    counts, sizes = np.array(block.counts, "<i8"), np.array([len(t) for t in block.texts], "<i8")
    return _rows(
        1, kind=["block"], block=[number], n_docs=[n], n_terms=[int(counts.sum())], width=[width], ids=[block.ids],
        counts=[counts.tobytes()], slices=[pa.compress(bits.tobytes(), "zstd", asbytes=True)], sizes=[sizes.tobytes()],
        texts=[pa.compress(b"".join(block.texts), "zstd", asbytes=True)],
    )


def _index(batches: Iterator[pa.RecordBatch]):
    """Blocks of documents, and (term, number of documents) counted within the task."""
    open_: dict[int, _Block] = {}
    found: Counter[bytes] = Counter()
    passed = 0  # bytes of text since terms were passed on
    numbers = count(TaskContext.get().partitionId() << 32)
    for batch in batches:
        for part in slices([batch], "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for key, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                held = Counter(terms(text))
                if not held:
                    continue
                found.update(held.keys())
                passed += len(text)
                times = np.fromiter(held.values(), np.int64, len(held))
                # Documents of one block differ in size by a factor of two at most, so one width fits all.
                block = open_.setdefault(len(held).bit_length(), _Block())
                block.ids.append(key)
                block.texts.append(text)
                block.counts.append(int(times.sum()))
                block.entries.append((_codes(held), times))
                block.size += len(text) + 16 * len(held)
                if len(block.ids) >= BLOCK_DOCS or block.size >= BLOCK_BYTES:
                    yield _signed(open_.pop(len(held).bit_length()), next(numbers))
                if len(found) >= HELD_TERMS or passed >= HELD_BYTES:
                    yield _rows(len(found), kind=["term"] * len(found), term=list(found), df=list(found.values()))
                    found.clear()
                    passed = 0
    for block in open_.values():
        yield _signed(block, next(numbers))
    if found:
        yield _rows(len(found), kind=["term"] * len(found), term=list(found), df=list(found.values()))


def build_index(docs: DataFrame, stages: Stages, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The blocks of all documents with a term, and the document frequency of every term; both written."""
    narrow = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    path = stages.path("index")
    # Both kinds in one file: a folder for each would be written from a sort of all blocks.
    narrow.mapInArrow(_index, _SCHEMA).write.options(compression="zstd", **GROUPS).parquet(path)
    read = stages.spark.read.schema(_SCHEMA).parquet(path)
    blocks = read.where("kind = 'block'").select("block", "n_docs", "n_terms", "width", "ids", "counts", "slices", "sizes", "texts")
    blocks._stage_path = path
    counts = read.where("kind = 'term'").groupBy("term").agg(F.sum("df").alias("df"))
    return blocks, stages.write(counts, "frequencies")


# -- queries ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Queries:
    """A block of queries: the distinct terms, and for each query the places of its terms and their weights."""

    words: list[bytes]
    rows: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    n_terms: int
    k: int

    def exact(self, q: int, held: Counter, m: int) -> int:
        """The score of a document with term counts ``held``."""
        total = 0
        for row, w in zip(self.rows[q].tolist(), self.weights[q].tolist(), strict=True):
            tf = held.get(self.words[row], 0)
            if tf:
                total += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        return total


def _bounds(queries: Queries, width: int, counts: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An upper bound of the score of every document (columns) for every query (rows), and all m."""
    n = len(counts)
    m = np.array([length_part(c, queries.n_docs, queries.n_terms) for c in counts.tolist()], np.int64)
    ends = [np.minimum(counts, after - 1) for after in LEVELS[1:].tolist()] + [counts]
    worth = np.stack([np.zeros(n, np.int64), *[(1_000_000_000 * tf) // (1000 * tf + 8 * m) for tf in ends]])
    out = np.zeros((len(queries.rows), n), np.int64)
    at = np.arange(n)
    for top in range(0, len(queries.words), LOOK):
        codes = _codes(queries.words[top : top + LOOK])
        reached = np.zeros((len(codes), n), np.int8)
        held = np.full((len(codes), bits.shape[1]), 255, np.uint8)
        for level in range(len(LEVELS)):
            for places in _places(codes, level, width):
                held &= bits[places]
            if not held.any():
                break
            reached += np.unpackbits(held, axis=1, count=n, bitorder="little").view(np.int8)
        value = worth[reached, at].astype(np.int32)
        for q, (rows, weights) in enumerate(zip(queries.rows, queries.weights, strict=True)):
            here = (rows >= top) & (rows < top + LOOK)
            for row, w in zip((rows[here] - top).tolist(), weights[here].tolist(), strict=True):
                out[q] += value[row] * np.int64(w)
    return out, m


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after another, so that a worker holds the values of one block beside the batch."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]
    batch = None
    pa.default_memory_pool().release_unused()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(row["counts"], "<i8")
    bits = pa.decompress(row["slices"], row["width"] * -(-len(counts) // 8), "zstd")
    return counts, np.frombuffer(bits, np.uint8).reshape(row["width"], -1)


def _texts(row: dict) -> tuple[bytes, list[int]]:
    """The texts of a block in a row, and where each begins and the last ends."""
    at = [0, *np.frombuffer(row["sizes"], "<i8").cumsum().tolist()]
    return pa.decompress(row["texts"], at[-1], "zstd", asbytes=True), at


def _first_docs(batches: Iterator[pa.RecordBatch], queries: Queries):
    """For each query the k highest bounds of the task: query, bound, block, place."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in queries.rows]
    for row in _each(batches):
        counts, bits = _opened(row)
        bounds, _ = _bounds(queries, row["width"], counts, bits)
        for q, found in enumerate(bounds):
            top = np.argpartition(-found, min(queries.k, len(found)) - 1)[: queries.k]
            best[q] = sorted([*best[q], *[(-int(found[d]), row["block"], int(d)) for d in top if found[d] > 0]])[: queries.k]
    out = [(q, -b, block, d) for q, rows in enumerate(best) for b, block, d in rows]
    columns = list(zip(*out, strict=True)) or [()] * 4
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["q", "bound", "block", "place"])


def _score_places(batches: Iterator[pa.RecordBatch], queries: Queries, wanted: dict[int, dict[int, list[int]]]):
    """Exact scores of chosen documents: query, score."""
    for row in _each(batches):
        out = []
        counts, (texts, at) = np.frombuffer(row["counts"], "<i8"), _texts(row)
        for place, qs in wanted.get(row["block"], {}).items():
            held = Counter(terms(texts[at[place] : at[place + 1]]))
            m = length_part(int(counts[place]), queries.n_docs, queries.n_terms)
            out += [(q, queries.exact(q, held, m)) for q in qs]
        columns = list(zip(*out, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())], ["q", "score"])


def _score_all(batches: Iterator[pa.RecordBatch], queries: Queries, floors: np.ndarray):
    """Exact scores of all documents whose bound reaches the floor of a query, the k best of the task for each."""
    best: list[list[tuple]] = [[] for _ in queries.rows]
    scored = 0
    for row in _each(batches):
        counts, bits = _opened(row)
        bounds, m = _bounds(queries, row["width"], counts, bits)
        able = bounds >= floors[:, None]
        texts, at = _texts(row) if able.any() else (b"", [])
        for place in np.flatnonzero(able.any(axis=0)).tolist():
            held, key = Counter(terms(texts[at[place] : at[place + 1]])), row["ids"][place]
            for q in np.flatnonzero(able[:, place]).tolist():
                score = queries.exact(q, held, int(m[place]))
                scored += 1
                if score > 0:
                    best[q].append((-score, key is None, key))
        for q, rows in enumerate(best):
            if len(rows) > queries.k:
                best[q] = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[: queries.k]
    out = [(q, key, -s, 0) for q, rows in enumerate(best) for s, _, key in rows]
    out.append((-1, None, 0, scored))
    columns = list(zip(*out, strict=True))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["q", "doc_id", "score", "scored"])


def _item_terms(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        lists = [sorted(set(terms(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "terms"])


def _query_blocks(items: DataFrame, stages: Stages) -> Iterator[list]:
    """Blocks of queries, each small enough for the driver and for every task."""
    listed = items.select("item_id", "text").distinct().mapInArrow(_item_terms, "item_id bigint, terms array<binary>")
    listed = stages.write(listed.where(F.size("terms") > 0), "items")
    sizes = listed.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    if not sizes[0]:
        return
    parts = max(-(-sizes[0] // QUERIES), -(-sizes[1] // QUERY_TERMS))
    part = F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts))
    for number in range(parts):
        rows = sorted(listed.where(part == number).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["terms"]))
        if rows:
            yield rows


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    measure: list | None = None,
) -> DataFrame:
    """The ``k`` best documents for each item: item_id, rank, doc_id, score.

    Scores are whole numbers as in the module's formulas; only documents with a score above 0 are ranked, and
    equal scores by ascending doc_id, a document without an id last. A null, empty or term-free text of a
    document or an item has no terms, is in no count and in no result. Every row of ``docs`` is a document,
    repeated rows too; equal rows of ``items`` are one query, and each text of a repeated item_id is ranked
    by itself. Texts and terms of any length are read whole. An empty table of either kind gives no rows.
    Other columns aren't read. ``measure`` receives, per block of queries, how many scores were computed.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "lexical")
    blocks, frequencies = build_index(docs, stages, id_col, text_col)
    totals = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    results = None
    items = items.select(column(item_id).cast("long").alias("item_id"), column(item_text).alias("text"))
    for rows in _query_blocks(items, stages) if totals[0] else ():
        rows = [(r["item_id"], [bytes(w) for w in r["terms"]]) for r in rows]
        words = sorted({w for _, held in rows for w in held})
        at = {w: i for i, w in enumerate(words)}
        wanted = spark.createDataFrame([(w,) for w in words], "term binary")
        df = {bytes(r["term"]): r["df"] for r in frequencies.join(F.broadcast(wanted), "term", "left_semi").collect()}
        weights = [weight(totals[0], df.get(w, 0)) for w in words]
        queries = Queries(
            words, [np.array([at[w] for w in held]) for _, held in rows],
            [np.array([weights[at[w]] for w in held], np.int64) for _, held in rows], totals[0], totals[1], k,
        )
        shared = spark.sparkContext.broadcast(queries)
        signed = blocks.select("block", "width", "counts", "slices")
        first = signed.mapInArrow(lambda it, s=shared: _first_docs(it, s.value), "q int, bound bigint, block bigint, place int")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block", "place"))
        chosen: dict[int, dict[int, list[int]]] = {}
        for r in first.withColumn("r", rank).where(F.col("r") <= k).collect():  # k for each query of the block
            chosen.setdefault(r["block"], {}).setdefault(r["place"], []).append(r["q"])
        picked = spark.sparkContext.broadcast(chosen)
        named = spark.createDataFrame([(b,) for b in sorted(chosen)], "block bigint")
        known = blocks.select("block", "counts", "sizes", "texts").join(F.broadcast(named), "block", "left_semi")
        scores = known.mapInArrow(lambda it, s=shared, p=picked: _score_places(it, s.value, p.value), "q int, score bigint")
        reached: dict[int, list[int]] = {}
        for r in scores.collect():
            reached.setdefault(r["q"], []).append(r["score"])
        floors = np.ones(len(rows), np.int64)
        for q, found in reached.items():
            if len(found) >= k:
                floors[q] = max(1, sorted(found)[-k])
        full = blocks.select("width", "counts", "slices", "ids", "sizes", "texts")
        final = full.mapInArrow(lambda it, s=shared, f=floors: _score_all(it, s.value, f), "q int, doc_id bigint, score bigint, scored bigint")
        found = stages.write(final, "scores")
        if measure is not None:
            measure.append(found.agg(F.sum("scored")).first()[0])
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.where("q >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        item = spark.createDataFrame([(q, key) for q, (key, _) in enumerate(rows)], "q int, item_id bigint")
        ranked = ranked.join(F.broadcast(item), "q").select("item_id", "rank", "doc_id", "score")
        results = ranked if results is None else results.union(ranked)
    stages.drop(blocks, frequencies)
    if results is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return results

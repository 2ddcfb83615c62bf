"""Token files compressed by Re-Pair: frequent pairs of ids become rules, shard by shard.

A shard is a run of documents in ascending order. Round after round its most frequent pairs of
neighbouring symbols each get a new symbol and are replaced, left to right, until no pair is frequent or
the symbols (16 bits) or rounds are used up. No rule crosses the end of a document, so any document can
be decoded by itself: a shard stores its symbols, where each document starts in them, the rules, and how
many ids each rule stands for.

Texts are range-partitioned by id once; the files are Parquet, one row per shard, read back by any Spark
job. Where a shard starts in the whole corpus follows from the totals of the files before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, slices
from .tokens import TEXT_BYTES, encoder

END_ID = 1
SHARD_IDS = 2_000_000
ROUNDS = 4
MIN_COUNT = 24
SYMBOLS = 1 << 16
_TABLE = 1 << 20

FILE_SCHEMA = (
    "part int, shard int, start_in_part bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
    "first_symbol array<bigint>, n_symbols bigint, terminals int, rules binary, expansions binary, symbols binary"
)


def repair(ids: np.ndarray, ends: np.ndarray, terminals: int, rounds: int = ROUNDS, min_count: int = MIN_COUNT):
    """Symbols, end marks and rules (pairs of symbols) for the ids of one shard.

    ``ends`` marks the last id of each document. A round counts all pairs exactly and takes the most
    frequent, its share of the symbols left. Where chosen pairs overlap, the left one is replaced.
    """
    if terminals > SYMBOLS:
        raise ValueError(f"symbols have 16 bits; the tokenizer has {terminals} ids")
    s, ends = ids.astype(np.uint32), ends.copy()
    rules = np.zeros((0, 2), np.uint32)
    table = np.zeros(_TABLE, np.uint16)
    for k in range(rounds):
        left = SYMBOLS - terminals - len(rules)
        quota = left if k == rounds - 1 else left // 2
        if quota <= 0 or len(s) < 2:
            break
        codes = (s[:-1] << np.uint32(16)) | s[1:]
        within = ~ends[:-1]
        pairs, counts = _frequent(codes[within], min_count)
        if not len(pairs):
            break
        chosen = pairs[np.argsort(-counts, kind="stable")[:quota]]
        # a table by hash says which pair may be at a place; one pair per slot, the others next round
        _, first = np.unique(_slots(chosen), return_index=True)
        chosen = chosen[np.sort(first)]
        expected = np.zeros(_TABLE, np.uint32)
        expected[0] = 1  # code 0 belongs here and code 1 doesn't: unless 0 is chosen, no pair is expected
        expected[_slots(chosen)] = chosen
        table[_slots(chosen)] = np.arange(len(chosen))
        slots = _slots(codes)
        places = np.flatnonzero((expected[slots] == codes) & within)
        if not len(places):
            break
        # of pairs that overlap in a run, every second one
        begins = np.flatnonzero(np.diff(places, prepend=-2) > 1)
        odd = np.arange(len(places)) - np.repeat(begins, np.diff(begins, append=len(places))) & 1
        places = places[odd == 0]
        s[places] = table[slots[places]] + np.uint32(terminals + len(rules))
        ends[places] = ends[places + 1]
        keep = np.ones(len(s), bool)
        keep[places + 1] = False
        keep = np.flatnonzero(keep)
        s, ends = s[keep], ends[keep]
        rules = np.concatenate([rules, np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1)])
    return s.astype("<u2"), ends, rules.astype("<u2")


def _frequent(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes found ``least`` times or more, ascending, and how often; sorts ``codes``."""
    codes.sort()
    reach = max(least, 1) - 1
    most = codes[: len(codes) - reach] if reach < len(codes) else codes[:0]
    found = most[most == codes[reach:]]
    first = np.ones(len(found), bool)
    first[1:] = found[1:] != found[:-1]
    pairs = found[first]
    return pairs, np.searchsorted(codes, pairs, "right") - np.searchsorted(codes, pairs, "left")


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(12)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses only symbols older than itself."""
    lengths = [1] * terminals
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths[terminals:], "<u4")


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of a run of symbols, all of a shard or one document of it."""
    grown = [b""] * terminals  # of an id itself, put in below
    one = [int(k).to_bytes(4, "little") for k in range(terminals)]
    for a, b in rules.tolist():
        grown.append((grown[a] or one[a]) + (grown[b] or one[b]))
    ids = np.frombuffer(b"".join(one) + b"".join(grown), "<u4")
    lengths = np.concatenate([np.ones(terminals, np.int64), expansion_lengths(rules, terminals).astype(np.int64)])
    starts = np.cumsum(lengths) - lengths
    n = lengths[symbols]
    ends = np.cumsum(n)
    places = np.repeat(starts[symbols] - (ends - n), n)
    places += np.arange(len(places))
    return ids[places]


def _encode_shards(batches: Iterator[pa.RecordBatch], path: str, shard_ids: int, rounds: int, min_count: int):
    words = encoder(path)
    terminals = len(words.ends) if len(words.ends) > END_ID else END_ID + 1
    terminals = max(terminals, max(words.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
    part = TaskContext.get().partitionId()
    shard, before = 0, 0
    keys, lengths, held, n_held = [], [], [], 0

    def flush():
        nonlocal shard, before, keys, lengths, held, n_held
        ids = np.concatenate(held)
        ends = np.zeros(len(ids), bool)
        ends[np.cumsum(lengths) - 1] = True
        symbols, ends, rules = repair(ids, ends, terminals, rounds, min_count)
        last = np.flatnonzero(ends)
        row = {
            "part": part, "shard": shard, "start_in_part": before, "n_ids": len(ids), "doc_ids": keys,
            "n_tokens": lengths, "first_symbol": np.concatenate([[0], last[:-1] + 1]), "n_symbols": len(symbols),
            "terminals": terminals, "rules": rules.tobytes(),
            "expansions": expansion_lengths(rules, terminals).tobytes(), "symbols": symbols.tobytes(),
        }
        shard, before = shard + 1, before + len(ids)
        keys, lengths, held, n_held = [], [], [], 0
        return pa.RecordBatch.from_pylist([row], _ARROW)

    for batch in slices(batches, "text", TEXT_BYTES):
        ids, starts = words.encode(batch.column("text"))
        for key, a, b in zip(
            batch.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True
        ):
            keys.append(key)
            lengths.append(b - a + 1)
            held += [ids[a:b], _END]
            n_held += b - a + 1
            if n_held >= shard_ids:
                yield flush()
        held = [np.concatenate(held)] if held else held  # let go of the slice
    if keys:
        yield flush()


_END = np.array([END_ID], "<u4")
_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_tokens", "first_symbol")]
    + [("n_symbols", pa.int64()), ("terminals", pa.int32())]
    + [(c, pa.binary()) for c in ("rules", "expansions", "symbols")]
)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_ids: int = SHARD_IDS,
    rounds: int = ROUNDS,
    min_count: int = MIN_COUNT,
) -> None:
    """Write the ids of all documents in ascending order of id.

    A document's ids end with id 1; a null or empty text has that id alone. Rows without an id come
    first; rows of one id follow each other in the order of a hash of their text. An empty table writes
    files without shards. Other columns aren't read.
    """
    narrow = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = ordered.mapInArrow(lambda it: _encode_shards(it, tokenizer, shard_ids, rounds, min_count), FILE_SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)


def _decode_shards(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
            ids = expand(np.frombuffer(row["symbols"], "<u2"), rules, row["terminals"])
            n = np.array(row["n_tokens"], np.int64)
            starts = np.cumsum(n) - n
            data = memoryview(ids.tobytes())
            crcs = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(starts.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(n), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start_in_part"], pa.int64()),
                    pa.array(n),
                    pa.array(crcs, pa.int64()),
                ],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before. The totals of the files (one row per file) are
    added up; no shard is moved.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = files.mapInArrow(
        _decode_shards, "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return docs.join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(shard: dict, place: int) -> np.ndarray:
    """Ids of one document of a shard (a row of the files as a dict), without decoding the others."""
    rules = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2)
    stops = [*shard["first_symbol"][1:], shard["n_symbols"]]
    symbols = np.frombuffer(shard["symbols"], "<u2")[shard["first_symbol"][place] : stops[place]]
    return expand(symbols, rules, shard["terminals"])

"""Packing of documents into sequences of fixed length by the sum-of-squares rule.

A document's ids are cut into pieces of the capacity; only the last piece is shorter. Each piece goes
where the sum over all residual gaps of the squared number of open sequences with that gap becomes
smallest; a new sequence is opened only when the piece fits nowhere. Pieces are placed from long to short.

A piece of the full capacity is a sequence by itself, whatever the rule says, and gets its number in the scan.
The rest, one piece of a document at most, is dealt out evenly to blocks of about ``BLOCK`` pieces and each block
is packed by itself, so memory and time per task are bounded at any input size; a block leaves about one
sequence unfilled in a thousand. Only lengths and checksums are shuffled, not ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, column, slices
from .tokens import TEXT_BYTES, encoder

BLOCK = 5_000  # pieces
END_ID = 1


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of every size, placed in the given order.

    With ``n[g]`` open sequences of residual gap ``g``, putting ``s`` into gap ``g`` changes the sum of
    squares by ``2 * (n[g - s] - n[g]) + 2``; a gap that it fills wholly vanishes: ``1 - 2 * n[g]``. Ties
    go to the smallest gap, then to the sequence that reached the gap last.
    """
    count = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    new = 0
    for k, s in enumerate(sizes.tolist()):
        gaps = s + np.flatnonzero(count[s:capacity])
        if s < capacity and len(gaps):
            change = 2 * (count[gaps - s] - count[gaps]) + 2
            if gaps[0] == s:
                change[0] = 1 - 2 * count[s]
            gap = int(gaps[np.argmin(change)])
            where = opened[gap].pop()
            count[gap] -= 1
        else:
            gap, where, new = capacity, new, new + 1
        sequence[k], offset[k] = where, capacity - gap
        if gap > s:
            count[gap - s] += 1
            opened[gap - s].append(where)
    return sequence, offset


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, blocks: int, with_ids: bool):
    """One row per piece: a full one with the number of its sequence, others with a block, dealt out in turn."""
    encode = encoder(path).encode
    task = TaskContext.get().partitionId()
    turn, full = task * 7919, task << 32
    for batch in slices(batches, "text", TEXT_BYTES):
        ids, starts = encode(batch.column("text"))
        keys, rows, kept = batch.column("doc_id").to_pylist(), [], []
        for key, a, b in zip(keys, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
            for piece, start in enumerate(range(0, len(own), capacity)):
                part = own[start : start + capacity]
                if len(part) == capacity:
                    full += 1
                    place = (None, -full)
                else:
                    place = (turn % blocks, None)
                    turn += 1
                rows.append((key, piece, start, len(part), zlib.crc32(part.tobytes()), *place))
                if with_ids:
                    kept.append(part.astype(np.int32))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        arrays = [pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)]
        if with_ids:
            arrays.append(pa.array(kept, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(arrays, [*_PIECE_NAMES, "ids"][: len(arrays)])


_PIECE_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "block", "sequence_id")
_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_PIECE_SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, sequence_id bigint"
)
_PLACE_SCHEMA = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``tokenizer``: path of a tokenizers file, there on every machine. A document's ids end with id 1, so
    a null or empty text is one piece of one id. Every row of ``docs`` is a document: repeated rows and
    rows without an id are packed like others. Ties in length keep doc_id order. An empty table gives
    none. Other columns aren't read.

    Pieces are written to the shared folder before they are packed, so texts are encoded once and a task that is
    repeated after the loss of an executor finds the same blocks. Sequences of one full piece have numbers below 0.
    """
    blocks = max(1, -(-docs.count() // BLOCK))
    narrow = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    schema = _PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    pieces = narrow.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, blocks, with_ids), schema)
    pieces = Stages(docs.sparkSession, "packing").write(pieces, "pieces")
    names = [*_PIECE_NAMES[:5], "sequence_id", "offset", *(["ids"] if with_ids else [])]
    whole = pieces.where(F.col("block").isNull()).withColumn("offset", F.lit(0).cast("long")).select(names)

    def place(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(
            ["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable"
        )
        sequence, offset = sum_of_squares(block["length"].to_numpy(), capacity)
        block["sequence_id"] = block.pop("block") * (1 << 32) + sequence
        block["offset"] = offset
        return block

    short = pieces.where(F.col("block").isNotNull()).drop("sequence_id").groupBy("block")
    packed = short.applyInPandas(place, _PLACE_SCHEMA + (", ids array<int>" if with_ids else ""))
    return whole.unionByName(packed)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, ids, doc_ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"),
        F.transform(parts, lambda p: p["doc_id"]).alias("doc_ids"),
    )

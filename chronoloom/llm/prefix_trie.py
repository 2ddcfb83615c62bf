"""The trie of all shared beginnings of conversations, by union-find over sorted neighbours.

1. Every turn becomes a digest of role and text and the bytes of its text; texts go no further. Conversations
   are rebuilt from these (the given rule, of which any trie of sequences is the case without heads).
2. Conversations are sorted by their digests and id (a range shuffle: a conversation that fills a third of
   the table is spread, as ids break ties) and cut into chunks of bounded size.
3. In a chunk every two neighbours are joined by an edge as deep as their longest common prefix. Edges are
   taken in descending depth; each joins two runs of neighbours, and each such merger makes, or adds to, the
   branching node of that depth. What lies between a run's node and the next is a chain of nodes with one child.
4. A chunk knows the depths it shares with the chunks before and after it. Nodes deeper than both are
   complete. The others, the two spines of a chunk, are contracted to one row a node; a node counts itself
   once, in the chunk where it begins, and a leaf where it ends, so all that a node holds is a sum over
   chunks, and a group-by merges the forests of all chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, column

#: Conversations and turns of a chunk at most (or one conversation).
CHUNK, CHUNK_TURNS = 8192, 1 << 16

_CHUNK_SCHEMA = "part int, place bigint, ids binary, lengths binary, digests binary, sizes binary, first binary, last binary"


def rebuilt(turns: DataFrame, heads: bool = True) -> DataFrame:
    """One row per conversation: conv_id, digests, sizes. ``heads``: begin with turns of another one.

    ``turns`` has conv_id, turn, role, text. With heads, conversation c begins with the first h turns of
    conversation c - c % 5, where h is crc32 of c in decimals modulo 9, and goes on with its own from h + 1.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    whole = turns.where("conv_id IS NOT NULL").select("conv_id", turn.alias("t"))
    whole = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    if heads:
        base = whole.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, 8).alias("head"))
        whole = whole.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
        whole = whole.withColumn("of", F.col("conv_id") - F.col("conv_id") % 5).join(base, F.col("of") == F.col("base"), "left")
        head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("own", 1, 0))
        rest = F.slice("own", F.col("h") + 1, F.size("own"))
        whole = whole.select("conv_id", F.concat(head, rest).alias("own"))
    return whole.select(
        "conv_id", F.transform("own", lambda t: t["digest"]).alias("digests"), F.transform("own", lambda t: t["size"]).alias("sizes")
    )


def _chunks(batches: Iterator[pa.RecordBatch], most: int):
    """Sorted conversations as rows of a chunk each."""
    part, place = TaskContext.get().partitionId(), 0
    names = [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]
    for batch in batches:
        lengths = pa.compute.list_value_length(batch.column("digests")).to_numpy(zero_copy_only=False)
        top = 0
        ends = np.cumsum(lengths)
        while top < batch.num_rows:
            room = (ends[top - 1] if top else 0) + CHUNK_TURNS
            stop = min(top + most, max(top + 1, int(np.searchsorted(ends, room, "right"))))
            rows = batch.slice(top, stop - top)
            digests = b"".join(rows.column("digests").flatten().to_pylist())
            ids = rows.column("conv_id").to_numpy().astype("<i8").tobytes()
            sizes = rows.column("sizes").flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            own = lengths[top:stop].astype("<i8")
            first, last = digests[: 16 * own[0]], digests[len(digests) - 16 * own[-1] :]
            values = [part, place, ids, own.tobytes(), digests, sizes, first, last]
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)
            place, top = place + 1, stop


def _common(a: bytes | None, b: bytes | None) -> int:
    """Digests at the beginning that two conversations share; -1 where one isn't there."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // 16
    x, y = (np.frombuffer(s, "S16", n) if n else np.zeros(0, "S16") for s in (a, b))
    x, y = x.view(np.uint64).reshape(-1, 2), y.view(np.uint64).reshape(-1, 2)
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _shared(batches: Iterator[pa.RecordBatch]):
    """Depths that a chunk shares with the one before and the one after it."""
    for batch in batches:
        rows = batch.to_pylist()
        before = [_common(r["before"], r["first"]) for r in rows]
        after = [_common(r["last"], r["after"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("chunk"), pa.array(before, pa.int64()), pa.array(after, pa.int64())], ["chunk", "before", "after"]
        )


def _neighbour_depths(lengths: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The longest common prefix of every conversation with the one before it (the first has -1)."""
    starts = np.cumsum(lengths) - lengths
    depth = np.full(len(lengths), 0, np.int64)
    depth[0] = -1
    alive = np.arange(1, len(lengths))
    while len(alive):
        d = depth[alive]
        alive = alive[(d < lengths[alive]) & (d < lengths[alive - 1])]
        d = depth[alive]
        alive = alive[(digests[starts[alive] + d] == digests[starts[alive - 1] + d]).all(axis=1)]
        depth[alive] += 1
    return depth


class Forest:
    """The nodes of one chunk, made by merging runs of neighbours in descending depth of their edges.

    ``before`` and ``after`` are the depths shared with the neighbouring chunks. Arrays with a value a node:
    depth, lo, hi (its run of conversations), up (its parent's place), children, saved (of its subtree).
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, digests: np.ndarray, sizes: np.ndarray, before: int, after: int):
        self.ids, self.lengths, self.before, self.after = ids, lengths, before, after
        self.starts = np.cumsum(lengths) - lengths
        self.sizes, n = sizes, len(ids)
        depths = _neighbour_depths(lengths, digests.view(np.uint64).reshape(-1, 2))
        ends = np.append(depths[1:], after)  # shared with the next one
        self.leaves = np.concatenate([[0], np.cumsum(ends < lengths)])
        self.depth, self.lo, self.hi, self.up, self.children, self.saved = [], [], [], [], [], []
        # A run is known by both its ends: the place of its top node.
        self.left, self.right = {}, {}
        for i, d in enumerate(lengths.tolist()):
            self.left[i] = self.right[i] = self._node(d, i, i)
        order = np.argsort(-depths[1:], kind="stable") + 1
        for i, d in zip(order.tolist(), depths[order].tolist(), strict=True):
            a, b = self._raised(self.right.pop(i - 1), d), self._raised(self.left.pop(i), d)
            lo, hi = self.lo[a], self.hi[b]
            self.hi[a], self.children[a], self.saved[a] = hi, self.children[a] + self.children[b], self.saved[a] + self.saved[b]
            self.up[b] = ~a  # the same node: its children find it there
            self.left[lo] = self.right[hi] = a
        self.top = self._raised(self.left[0], 0)
        self._finish(self.top)

    def _node(self, depth: int, lo: int, hi: int) -> int:
        for values, x in zip((self.depth, self.lo, self.hi, self.up, self.children, self.saved), (depth, lo, hi, None, 0, 0), strict=True):
            values.append(x)
        return len(self.depth) - 1

    def begins(self, k: int) -> bool:
        """Whether the node isn't one of the chunk before, too."""
        return self.lo[k] > 0 or self.depth[k] > self.before

    def open(self, k: int) -> bool:
        return not self.begins(k) or (self.hi[k] == len(self.ids) - 1 and self.depth[k] <= self.after)

    def _finish(self, k: int) -> None:
        d = self.depth[k]
        if d:
            size = int(self.sizes[self.starts[self.lo[k]] + d - 1])
            self.saved[k] += size * (self.hi[k] - self.lo[k] + 1 - self.begins(k))

    def _raised(self, k: int, depth: int) -> int:
        """The node of a run at a depth, above those made so far: a chain of nodes with one child."""
        while self.depth[k] > depth:
            self._finish(k)
            above = self._node(self.depth[k] - 1, self.lo[k], self.hi[k])
            self.up[k], self.children[above], self.saved[above] = above, int(self.begins(k)), self.saved[k]
            k = above
        return k

    def parent(self, k: int) -> int | None:
        """The place of the parent; mergers leave a trail from a node to the one that took it in."""
        at = self.up[k]
        if at is None:
            return None
        while (into := self.up[at]) is not None and into < 0:
            at = ~into
        return at

    def kept(self) -> list[int]:
        return [k for k, up in enumerate(self.up) if up is None or up >= 0]

    def members(self, k: int) -> np.ndarray:
        """Ids of the conversations that end in the node, ascending: they come first in its run."""
        lo, hi, d = self.lo[k], self.hi[k] + 1, self.depth[k]
        longer = np.flatnonzero(self.lengths[lo:hi] > d)
        return self.ids[lo : lo + longer[0] if len(longer) else hi]


_NODE_NAMES = (
    "chunk", "open", "depth", "side", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id",
    "up_side", "key", "up_key", "ends", "ends_sha256",
)
_NODE_SCHEMA = (
    "chunk bigint, open boolean, depth bigint, side int, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, parent_conv_id bigint, up_side int, key binary, up_key binary, ends binary, ends_sha256 string"
)
_NODE_TYPES = (
    pa.int64(), pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(),
)


def _decimal(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _nodes(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            read = lambda c: np.frombuffer(row[c], "<i8")  # noqa: B023, E731
            raw = row["digests"]
            forest = Forest(read("ids"), read("lengths"), np.frombuffer(raw, np.uint8), read("sizes"), row["before"], row["after"])
            least = lambda k: int(forest.ids[forest.lo[k] : forest.hi[k] + 1].min())  # noqa: B023, E731
            side = lambda k: 0 if forest.lo[k] == 0 else 1  # noqa: B023, E731
            starts = (16 * forest.starts).tolist()

            def key(k: int, depth: int) -> bytes:
                at = starts[forest.lo[k]]  # noqa: B023
                return hashlib.md5(raw[at : at + 16 * depth]).digest()  # noqa: B023

            kept = forest.kept()
            smallest = {}
            for k in kept:  # deep nodes come first, and their runs lie within those above
                smallest[k] = least(k) if forest.hi[k] > forest.lo[k] else int(forest.ids[forest.lo[k]])
            out = []
            for k in kept:
                d, opened, up = forest.depth[k], forest.open(k), forest.parent(k)
                above = None if up is None or opened or forest.open(up) else smallest[up]
                ends = _decimal(forest.members(k))
                out.append((
                    row["chunk"], opened, d, side(k) if opened else None, smallest[k], forest.hi[k] - forest.lo[k] + 1,
                    forest.children[k], int(forest.leaves[forest.hi[k] + 1] - forest.leaves[forest.lo[k]]), forest.saved[k], above,
                    side(up) if up is not None and above is None and not opened else None, key(k, d) if opened else None,
                    key(k, d - 1) if opened and d else None, ends if opened and ends else None,
                    None if opened else hashlib.sha256(ends).hexdigest(),
                ))
            for top in range(0, len(out), 1 << 14):
                columns = zip(*out[top : top + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES, strict=True)], _NODE_NAMES)


def _ends(batches: Iterator[pa.RecordBatch]):
    """The digest of all members of a node, from rows sorted by node and chunk; one row is held at a time."""
    now, state = None, None
    rows: list[tuple[bytes, str]] = []
    for batch in batches:
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    rows.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ends)
            else:
                state.update(b"," + ends)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "ends_sha256"])
            rows = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def prefix_trie(
    conversations: DataFrame,
    heads: bool = True,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk_rows: int = CHUNK,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first d turns (role and text) of conversations; the root has none
    and is there whenever a conversation is. Null role and text are empty. Turns go by number, null first;
    equal numbers, and repeated rows, which are turns of their own, by the digest of role and text. Rows
    without a conversation id belong to none. An empty table has no nodes. Texts of any length are read
    whole, as a digest. Other columns aren't read.

    A conversation is one row of 24 bytes for each of its turns, which a task must be able to hold. No other
    group is held: neither the members of a node nor the conversations that share a beginning.
    """
    stages = Stages(conversations.sparkSession, "trie")
    turns = conversations.select(
        column(conv_col).cast("long").alias("conv_id"), column(turn_col).cast("long").alias("turn"),
        column(role_col).alias("role"), column(text_col).alias("text"),
    )
    sequences = stages.write(rebuilt(turns, heads), "sequences")
    order = ["digests", "conv_id"]
    sorted_ = sequences.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = stages.write(sorted_.mapInArrow(lambda it: _chunks(it, chunk_rows), _CHUNK_SCHEMA), "chunks")
    # Chunks are numbered through; the driver sees one row per partition.
    sizes = dict(map(tuple, chunks.groupBy("part").count().collect()))
    before, at = {}, 0
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]
    if not before:
        return _named(conversations.sparkSession.createDataFrame([], _NODE_SCHEMA))
    offset: Column = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in before.items() for x in kv]), F.col("part").cast("bigint"))
    numbered = chunks.withColumn("chunk", offset + F.col("place"))
    ends = numbered.select("chunk", "first", "last")
    shared = (
        ends.join(ends.select((F.col("chunk") + 1).alias("chunk"), F.col("last").alias("before")), "chunk", "left")
        .join(ends.select((F.col("chunk") - 1).alias("chunk"), F.col("first").alias("after")), "chunk", "left")
        .mapInArrow(_shared, "chunk bigint, before bigint, after bigint")
    )
    blobs = numbered.select("chunk", "ids", "lengths", "digests", "sizes").join(shared, "chunk")
    nodes = stages.write(blobs.repartition(min(20_000, at), "chunk").mapInArrow(_nodes, _NODE_SCHEMA), "nodes")
    stages.drop(sequences, chunks)

    spine = nodes.where("open")
    merged = spine.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.first("up_key", ignorenulls=True).alias("up_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    hashed = spine.where("ends IS NOT NULL").select("key", "chunk", "ends").repartition("key").sortWithinPartitions("key", "chunk")
    hashed = hashed.mapInArrow(_ends, "key binary, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    merged = merged.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    merged = stages.write(merged, "spines")
    ups = merged.select(F.col("key").alias("up_key"), F.col("conv_id").alias("parent_conv_id"))
    joined = merged.join(ups, "up_key", "left")
    whole = nodes.where("NOT open")
    inner = whole.where("up_side IS NULL")
    tops = spine.select("chunk", (F.col("depth") + 1).alias("depth"), F.col("side").alias("up_side"), F.col("key").alias("up_key"))
    tops = tops.join(ups, "up_key").drop("up_key")
    outer = whole.where("up_side IS NOT NULL").drop("parent_conv_id").join(tops, ["chunk", "depth", "up_side"])
    return _named(joined).unionAll(_named(inner)).unionAll(_named(outer))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )

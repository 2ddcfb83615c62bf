"""Words of whole texts as 64-bit numbers, in numpy, for work on windows of words inside a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array, normal: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text starts in them (one more than texts).

    Words are separated by ASCII white space; ``normal`` is applied to each distinct word. A null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    full = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)
    found = flat.dictionary if normal else flat.dictionary.cast(pa.binary())
    words = found.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(normal, words) if normal else words), np.uint64, len(words))
    at = flat.indices.to_numpy(zero_copy_only=False)
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if len(at) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kept = full[at]
    return hashes[at[kept]], np.concatenate([[0], np.cumsum(kept)])[cuts].astype(np.int64)


def windows(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each window of ``size`` words within a text, and the text each belongs to.

    A text with fewer words, but any, has one window: all of them.
    """
    n = np.diff(starts)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[:-1], count)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    from_each = np.zeros(len(words), np.uint64)
    for k in range(size):
        from_each *= _ODD
        from_each += padded[k : k + len(words)]
    out = from_each[place]
    if (few := (n > 0) & (n < size)).any():
        at, stop = starts[:-1][few], starts[1:][few]
        own = np.zeros(len(at), np.uint64)
        for k in range(size):
            own = own * _ODD + np.where(at + k < stop, padded[at + k], np.uint64(k + 1))
        out[np.repeat(few, count)] = own
    return mix(out), owner


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, owner) in order of owner, and how often each occurs; owners come in ascending."""
    h, o = hashes.copy(), owner
    if len(h) == 0:
        return h, o, np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(o[1:] != o[:-1]) + 1, [len(h)]]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h[a:b].sort()
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    at = np.flatnonzero(first)
    return h[at], o[at], np.diff(np.concatenate([at, [len(h)]]))

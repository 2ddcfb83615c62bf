"""Token ids of whole texts by the ``tokenizers`` library, each piece of a word encoded once per worker.

The tokenizer drops white space and never joins across it, so the ids of a text are those of its
blank-separated words one after the other. A slice of texts is split and its distinct words found in
Arrow; those are cut into pieces, and only pieces not seen before go to the library.
"""

from __future__ import annotations

import os
import re
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of words kept per worker, some 200 bytes each; beyond them a worker keeps those that came up again.
CACHED_PIECES = 400_000

#: Distinct words cut into pieces at a time, which bounds the lists of a long text.
WORDS = 1 << 18

#: Bytes of text encoded at a time: each distinct word of a slice is looked up once, so longer slices take fewer.
TEXT_BYTES = 8 << 20

#: How the word tokenizer cuts a lower-cased word of the characters of ``_PLAIN``. Words with
#: others, whose lower case or composition may depend on neighbours, go to the library whole.
_PLAIN = r"^[\x21-\x7E\x{C0}-\x{FF}]+$"
_PIECES = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^\na-z0-9\xDF-\xF6\xF8-\xFF]+|\n"
)
_SPECIAL = "<|"


class WordEncoder:
    """Ids of texts under a tokenizer file whose words end in a suffix (``</w>``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for pieces, which are lower-cased and cut already
        self.cut = Tokenizer(self.tokenizer.model)
        self.cut.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Know only the line end, which closes a word and has no ids."""
        self.pieces = {"\n": 0}
        self.table, self.lengths = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.again = np.zeros(1, bool)

    def _keep_recurring(self) -> None:
        """Keep the pieces found again since they were learned; none of them, if they are over half of all."""
        self.again[0] = True  # the line end
        kept, pieces = np.flatnonzero(self.again), self.pieces
        if 2 * len(kept) > CACHED_PIECES:
            self._forget()
            return
        self.pieces = dict(zip(compress(pieces, self.again.tolist()), range(len(kept)), strict=True))
        self.table, _ = _gather(self.table, self.lengths, kept)
        self.lengths, self.again = self.lengths[kept], np.zeros(len(kept), bool)

    def _encode(self, texts: list[str], cut: bool = False) -> list[np.ndarray]:
        done = (self.cut if cut else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in done]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of plain pieces, encoded many to a text; the word-end ids say where each piece ends."""
        ids = np.concatenate(self._encode([" ".join(pieces[k : k + 512]) for k in range(0, len(pieces), 512)], True))
        ends = np.flatnonzero(self.ends[ids]) + 1
        lengths = np.diff(ends, prepend=0)
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            alone = self._encode(pieces)
            ids, lengths = np.concatenate(alone), np.fromiter(map(len, alone), np.int64, len(alone))
        self.pieces.update(zip(pieces, range(len(self.pieces), len(self.pieces) + len(pieces)), strict=True))
        self.table = np.concatenate([self.table, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])

    def _plain_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after the other, and how many each has, by their pieces, which recur more
        than words do."""
        if len(self.pieces) > CACHED_PIECES:
            self._keep_recurring()
        lines = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
        cut = _PIECES.findall(lines.lower() + "\n")
        piece = np.fromiter(map(self.pieces.get, cut, repeat(-1)), np.int64, len(cut))
        unknown = piece < 0
        self.again[piece[~unknown]] = True
        if unknown.any():
            fresh = list(compress(cut, unknown.tolist()))
            self._learn(list(dict.fromkeys(fresh)))
            piece[unknown] = np.fromiter(map(self.pieces.__getitem__, fresh), np.int64, len(fresh))
        n = self.lengths[piece]
        stops = np.cumsum(n)[piece == 0]
        return _gather(self.table, self.lengths, piece)[0], np.diff(stops, prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (no ASCII blanks within) one after the other, and how many each has. Words that
        aren't plain are encoded whole, and their ids put in between."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, _SPECIAL))
        odd = pc.invert(plain)
        ids, lengths = np.zeros(0, "<u4"), np.zeros(len(words), np.int64)
        plain, odd = plain.to_numpy(zero_copy_only=False), words.filter(odd).to_pylist()
        if plain.any():
            ids, lengths[plain] = self._plain_words(words.filter(pa.array(plain)))
        if odd:
            whole = self._encode(odd)
            before = np.cumsum(lengths)[~plain]  # ids of plain words ahead of each
            n = np.fromiter(map(len, whole), np.int64, len(whole))
            ids = np.insert(ids, np.repeat(before, n), np.concatenate(whole))
            lengths[~plain] = n
        return ids, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts in it (one more than texts).

        A null text has no ids.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = lists.flatten().dictionary_encode()
        known = [self._words(flat.dictionary.slice(k, WORDS)) for k in range(0, len(flat.dictionary), WORDS)]
        table = np.concatenate([np.zeros(0, "<u4"), *[ids for ids, _ in known]])
        lengths = np.concatenate([np.zeros(0, np.int64), *[n for _, n in known]])
        data, ends = _gather(table, lengths, flat.indices.to_numpy(zero_copy_only=False))
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return data, np.concatenate([[0], ends])[cuts]


def _gather(table: np.ndarray, lengths: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of items one after the other, and where each item ends; in ``table`` items follow by number."""
    n = lengths[items]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
    # place of every id in the table: the start of its item, plus its place in the item
    places = np.repeat(((np.cumsum(lengths) - lengths)[items] - (ends - n)).astype(kind), n)
    places += np.arange(total, dtype=kind)
    return table[places], ends


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; kept as long as the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]

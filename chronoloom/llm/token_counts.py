"""Token counts by unigram segmentation, shared over a trie of distinct pre-tokens.

A pre-token (a word with its leading blank) is segmented into vocabulary pieces of the largest total
score. The best score of a prefix depends on the prefix alone, so pre-tokens go into a trie and each node,
a prefix that any number of words share, is computed once: score and number of pieces. A word's count is
that of its node. Workers keep their trie between slices, up to ``NODES`` nodes. A pre-token of more than
``LONG`` characters shares little and would fill the trie: its scores are computed alike, but only those that a
further piece can start from are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column, slices

NODES = 1_000_000
LONG = 512
BLANK = "▁"  # fixed value: how the vocabulary writes the blank before a word


class Vocabulary:
    """Pieces with scores. Ranks become log-probabilities by Zipf's law: -ln(rank + 2).

    A character of which no piece is made costs one token per UTF-8 byte, each below any piece.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        top = max((model.get_score(i) for i in ids), default=0.0)
        return cls({model.id_to_piece(i): -math.log(top - model.get_score(i) + 2) for i in ids})

    def unknown(self, character: str) -> tuple[float, int]:
        n = len(character.encode("utf-8", "surrogatepass"))
        return self.byte * n, n


class Trie:
    """Prefixes of the pre-tokens seen, with the best score and its number of pieces at each."""

    def __init__(self, vocabulary: Vocabulary, nodes: int = NODES):
        self.vocabulary, self.limit = vocabulary, nodes
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]

    def add(self, token: str) -> int:
        """The number of pieces of a pre-token; only prefixes not in the trie are computed."""
        if len(token) > LONG:
            return self._long(token)
        if len(self.score) > self.limit:
            self._clear()
        path, node = [0], 0
        for k, character in enumerate(token):
            following = self.children[node].get(character)
            if following is None:
                following = self._grow(node, character, token, k + 1, path)
            node = following
            path.append(node)
        return self.count[node]

    def _grow(self, parent: int, character: str, token: str, end: int, path: list[int]) -> int:
        scores = self.vocabulary.scores
        best, pieces = -math.inf, 0
        for start in range(max(0, end - self.vocabulary.longest), end):
            gain = scores.get(token[start:end])
            if gain is not None:
                total, n = self.score[path[start]] + gain, self.count[path[start]] + 1
                if total > best or (total == best and n < pieces):
                    best, pieces = total, n
        if character not in scores:
            gain, n = self.vocabulary.unknown(character)
            if self.score[parent] + gain > best:
                best, pieces = self.score[parent] + gain, self.count[parent] + n
        node = len(self.score)
        self.children[parent][character] = node
        self.children.append({})
        self.score.append(best)
        self.count.append(pieces)
        return node


    def _long(self, token: str) -> int:
        """The same scores in a window as wide as the longest piece."""
        scores, width = self.vocabulary.scores, self.vocabulary.longest + 1
        score, count = [0.0] * width, [0] * width  # of the prefix of k characters, at k % width
        for end, character in enumerate(token, 1):
            best, pieces = -math.inf, 0
            for start in range(max(0, end - width + 1), end):
                gain = scores.get(token[start:end])
                if gain is not None:
                    total, n = score[start % width] + gain, count[start % width] + 1
                    if total > best or (total == best and n < pieces):
                        best, pieces = total, n
            if character not in scores:
                gain, n = self.vocabulary.unknown(character)
                before = (end - 1) % width
                if score[before] + gain > best:
                    best, pieces = score[before] + gain, count[before] + n
            score[end % width], count[end % width] = best, pieces
        return count[len(token) % width]


_TRIES: dict[str, Trie] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str):
    if path not in _TRIES:
        _TRIES[path] = Trie(Vocabulary.load(path))
    add = _TRIES[path].add
    for batch in slices(batches, "text"):
        lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        # sorted, so that words of one prefix follow each other
        order = sorted(range(len(words)), key=words.__getitem__)
        counts = np.zeros(len(words) + 1, np.int64)
        for k in order:
            if words[k]:
                counts[k] = add(BLANK + words[k])
        at = flat.indices.to_numpy(zero_copy_only=False)
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        tokens = np.concatenate([[0], np.cumsum(counts[at])])[cuts]
        real = np.concatenate([[0], np.cumsum(counts[at] > 0)])[cuts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(real)), pa.array(np.diff(tokens))], ["doc_id", "n_words", "n_tokens"]
        )


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens.

    ``vocabulary``: path of a sentencepiece model, there on every machine; its pieces and their ranks are
    used. Pre-tokens are separated by ASCII white space. A null or empty text has none; null ids and
    repeated rows are counted like others; equal scores go to fewer pieces. Other columns aren't read.
    """
    narrow = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return narrow.mapInArrow(lambda it: _count(it, vocabulary), "doc_id bigint, n_words bigint, n_tokens bigint")

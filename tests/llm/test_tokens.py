"""The word tokenizer, packing and token files."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import packing, token_files, tokens
from chronoloom.llm.common import slices
from chronoloom.llm.tokens import WordEncoder, encoder

from .data import edge, edge_texts, empty, prose, table

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def ids_of(text):
    return encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=40)))
def test_words_encode_like_whole_texts(text):
    ids, _ = encoder(PATH).encode(pa.array([text]))
    assert ids.tolist() == ids_of(text)


def test_special_strings_and_slices(spark):
    texts = ["a<|endoftext|>b <|startoftext|> it's 'tis !'s", None, "", *[t for _, t in edge_texts()]]
    ids, starts = encoder(PATH).encode(pa.array(["before", *texts])[1:])
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == ids_of(t), k


def test_pieces_that_recur_are_kept_and_others_go(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 60)
    words, learned = WordEncoder(PATH), Counter()
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda pieces: learned.update(pieces) or learn(pieces))
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = ["often " + " ".join(f"w{k}x{j}q".translate(letters) for j in range(9)) for k in range(40)]
    for t in texts:
        assert words.encode(pa.array([t]))[0].tolist() == ids_of(t)
        assert len(words.pieces) <= 60 + 10
    assert learned["often"] == 1
    for many in (texts[30:], texts[30:], texts):  # more of them recur than may be kept
        assert words.encode(pa.array(many))[0].tolist() == [i for t in many for i in ids_of(t)]


def test_arrow_gives_memory_back_after_the_last_slice(monkeypatch):
    class Pool:
        given = 0

        def release_unused(self):
            self.given += 1

    pool, batch = Pool(), pa.RecordBatch.from_pydict({"text": ["a" * 50, None, "b"]})
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    assert sum(b.num_rows for b in slices(iter([batch, batch]), "text", 20)) == 6
    assert pool.given == 1 and list(slices(iter([]), "text")) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=60), st.integers(1, 20))
def test_frequent_codes_are_counted(codes, least):
    pairs, counts = token_files._frequent(np.array(codes, np.uint32), least)
    want = {c: n for c, n in sorted(Counter(codes).items()) if n >= least}
    assert list(zip(pairs.tolist(), counts.tolist(), strict=True)) == list(want.items())


def check_packing(rows, docs, capacity):
    sequences, pieces = {}, Counter()
    want = Counter()
    for i, t in docs:
        own = np.array([*ids_of(t), 1], "<u4")
        for piece, start in enumerate(range(0, len(own), capacity)):
            part = own[start : start + capacity]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    for r in rows:
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(k[3] * n for k, n in want.items())


def test_packing_of_awkward_rows(spark):
    rows = packing.pack(edge(spark), PATH, capacity=512).collect()
    n, total = check_packing(rows, edge_texts(), 512)
    assert n <= -(-total // 512) + 1
    assert packing.pack(empty(spark), PATH).count() == 0


def test_packing_is_close_to_the_lower_bound(spark):
    docs = [(k, prose(k, 20 + 37 * k % 300)) for k in range(400)]
    n, total = check_packing(packing.pack(table(spark, docs), PATH, capacity=1024).collect(), docs, 1024)
    assert n <= 1.01 * total / 1024 + 1


def test_full_pieces_are_sequences_in_the_scan(spark):
    """Documents of many pieces: what meets in a block is one short piece of each at most."""
    docs = [(k, prose(k % 7, 400 + k)) for k in range(30)] + [(None, prose(1, 400)), (3, None)]
    rows = packing.pack(table(spark, docs).repartition(3), PATH, capacity=16).collect()
    n, total = check_packing(rows, docs, 16)
    full = [r for r in rows if r.length == 16]
    assert len(full) > 500 and all(r.sequence_id < 0 and r.offset == 0 for r in full)
    assert len({r.sequence_id for r in full}) == len(full) and n <= 1.01 * total / 16 + 3
    short = Counter((r.doc_id, r.ids_crc32) for r in rows if r.sequence_id >= 0)
    assert sum(short.values()) <= len(docs)


def test_sequences_hold_the_ids(spark):
    docs = [(k, prose(k, 30)) for k in range(20)]
    packed = packing.pack(table(spark, docs), PATH, capacity=256, with_ids=True)
    found = packing.sequences(packed).collect()
    assert Counter(i for r in found for i in r.ids) == Counter(i for _, t in docs for i in [*ids_of(t), 1])
    text = dict(docs)
    for r in found:
        first = [*ids_of(text[r.doc_ids[0]]), 1][:256]
        assert list(r.ids[: len(first)]) == first or len(r.ids) == 256


def brute_sum_of_squares(sizes, capacity):
    gaps, out = [], []
    for s in sizes:
        best = None
        for k, g in enumerate(gaps):
            if g >= s:
                after = Counter(x for x in [*gaps[:k], g - s, *gaps[k + 1 :]] if x)
                cost = sum(n * n for n in after.values())
                if best is None or (cost, g) < best[:2]:
                    best = (cost, g)
        if best is None:
            gaps.append(capacity - s)
            out.append(capacity)
        else:
            gaps.remove(best[1])
            gaps.append(best[1] - s)
            out.append(best[1])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_sum_of_squares_rule(sizes):
    sequence, offset = packing.sum_of_squares(np.array(sizes, np.int64), 20)
    assert (20 - offset).tolist() == brute_sum_of_squares(sizes, 20)
    fill = Counter()
    for s, q in zip(sizes, sequence.tolist(), strict=True):
        fill[q] += s
    assert not fill or max(fill.values()) <= 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=60), min_size=1, max_size=12), st.integers(1, 6))
def test_repair_round_trip(docs, rounds):
    ids = np.array([i for d in docs for i in d], "<u4")
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, last, rules = token_files.repair(ids, ends, 6, rounds, min_count=2)
    assert token_files.expand(symbols, rules, 6).tolist() == ids.tolist()
    assert int(last.sum()) == len(docs)
    for k, (a, b) in enumerate(rules.tolist()):
        assert a < 6 + k and b < 6 + k
    assert token_files.expansion_lengths(rules, 6).sum() >= 2 * len(rules)


def test_repair_shortens_what_repeats():
    ids = np.array(list(range(10)) * 500, "<u4")
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    symbols, _, rules = token_files.repair(ids, ends, 10, 4, 20)
    assert len(symbols) < len(ids) / 4 and len(rules) > 0


def test_token_files_of_awkward_rows(spark, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(edge(spark), path, PATH, shard_ids=2_000, min_count=3)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = Counter((i, len(ids_of(t)) + 1, zlib.crc32(np.array([*ids_of(t), 1], "<u4").tobytes())) for i, t in edge_texts())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    shards = spark.read.parquet(path).collect()
    texts = {(i, len(ids_of(t)) + 1): t for i, t in edge_texts()}
    for s in shards:
        s = s.asDict()
        for k, (i, n) in enumerate(zip(s["doc_ids"], s["n_tokens"], strict=True)):
            assert token_files.read_document(s, k).tolist() == [*ids_of(texts[i, n]), 1]


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(empty(spark), path, PATH)
    assert token_files.read_token_files(spark, path).count() == 0

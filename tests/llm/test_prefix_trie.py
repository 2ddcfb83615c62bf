"""The trie of conversations against one made of nested dictionaries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from chronoloom.llm import prefix_trie

SCHEMA = (
    "conv_id long, turn long, role string, text string, own string, depth string, chunk string, key string, digests string, h string"
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *"jjjjjj") for r in rows], SCHEMA)


def sequences(rows, heads):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    if not heads:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]  # the remainder of SQL
    return out


def brute(rows, heads=True):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in sorted(sequences(rows, heads).items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, cs in members.items():
        own = (len(cs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += not children[path]
    return sorted(
        (
            (min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children[path], leaves[path], saved[path],
             hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest())
            for path, cs in members.items()
        ), key=str,
    )


def run(spark, rows, heads=True, chunk_rows=prefix_trie.CHUNK):
    found = prefix_trie.prefix_trie(table(spark, rows), heads, chunk_rows=chunk_rows)
    assert found.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    return sorted((tuple(r) for r in found.collect()), key=str)


def talk(seed, n=60):
    """Conversations that branch off others, copies, a first turn of a third of all, and long ones."""
    rng, made, rows = random.Random(seed), [], []
    for c in range(n):
        ts = [("user", f"common {c % 3}")] if c % 3 else [("system", "the same")]
        if made and rng.random() < 0.6:
            ts = list(rng.choice(made)[: rng.randrange(1, 12)])
        ts += [(rng.choice(["user", "assistant"]), f"text {rng.randrange(3)} é") for _ in range(rng.choice([0, 0, 1, 3, 9]))]
        if c % 7 == 0 and made:
            ts = list(made[0])
        made.append(ts)
        rows += [(c * 3 - 40, t, *x) for t, x in enumerate(ts)]
    rng.shuffle(rows)
    return rows


def awkward():
    long = [(900, t, "user", f"t{t}") for t in range(120)]
    return [
        (0, 0, "user", "a"), (0, 1, None, None), (0, 2, "", ""), (0, None, "user", "first"), (0, None, None, "x"),
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (2, 5, "usera", ""), (3, 5, "user", "a"), (4, 7, None, "y" * 500_000),
        (None, 0, "user", "no id"), (None, None, None, None), (-7, 1, "user", "below"), (-10, 1, "user", "below"), (11, 0, "user", "alone"),
        *long, *[(901, t, r, x) for _, t, r, x in long], *[(903, t, r, x) for _, t, r, x in long[:80]],
    ]


@pytest.mark.parametrize(("heads", "chunk_rows"), [(True, 3), (False, 1), (False, 7)])
def test_against_nested_beginnings(spark, heads, chunk_rows):
    rows = talk(chunk_rows)
    assert run(spark, rows, heads, chunk_rows) == brute(rows, heads)


def test_awkward_long_and_empty_tables(spark):
    assert run(spark, awkward()) == brute(awkward())
    assert run(spark, awkward(), False, 2) == brute(awkward(), False)
    assert run(spark, []) == []


def test_a_conversation_that_fills_a_third_of_the_table(spark):
    """Its members are spread over many chunks, and their digest is still that of all of them in order."""
    rows = [(k, t, "user", f"same {t}") for k in range(300) for t in range(2)]
    rows += [(1000 + k, t, "user", f"same {t}" if t < k % 4 else f"{k}") for k in range(200) for t in range(4)]
    assert run(spark, rows, False, 16) == brute(rows, False)

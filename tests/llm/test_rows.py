"""Shards, quality rules and token counts: one row per document."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from chronoloom.llm import quality, sharding, token_counts

from .data import edge, edge_texts, empty, prose, table


def test_shards_on_awkward_rows(spark):
    rows = sharding.interleave_shards(edge(spark), 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_texts())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))
    assert sharding.interleave_shards(empty(spark)).count() == 0


def test_shards_have_the_mixture_of_the_whole(spark):
    docs = spark.range(9_000).selectExpr(
        "id AS doc_id", "cast(id AS string) AS text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end AS source"
    )
    rows = sharding.interleave_shards(docs, 9).groupBy("shard", "source").count().collect()
    whole = Counter()
    for r in rows:
        whole[r.source] += r["count"]
    for r in rows:
        assert abs(r["count"] - whole[r.source] / 9) <= 2
    again = sharding.interleave_shards(docs.repartition(13), 9).collect()
    assert sorted(again) == sorted(sharding.interleave_shards(docs, 9).collect())


def brute_shards(docs, n_shards, seed="shards-1"):
    """Where the rule puts every row, by sorting all of them."""
    rows = []
    for i, text, source in docs:
        data = (text or "").encode()
        mix = int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)
        rows.append(("null" if source is None else f"={source}", mix, i is not None, i or 0, zlib.crc32(data), len(data) + 1))
    total, sizes, seen, ranked = len(rows), Counter(r[0] for r in rows), Counter(), []
    for r in sorted(rows):
        ranked.append(((2 * seen[r[0]] + 1) / (2 * sizes[r[0]]), r))
        seen[r[0]] += 1
    found = Counter()
    for place, (_, r) in enumerate(sorted(ranked)):
        shard = place * n_shards // total
        found[r[3] if r[2] else None, r[4], shard, place - (shard * total + n_shards - 1) // n_shards] += 1
    return found


def test_shards_of_crowded_orders(spark):
    """A source for every row, so that all have one fraction; a third of the rows without an id; one id many times."""
    docs = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k}", f"own {k}" if k % 2 else None) for k in range(600)]
    docs += docs[:20]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    placed = sharding.interleave_shards(rows, 7)
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in placed.collect()) == brute_shards(docs, 7)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "Window " in line)  # one row per partition


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(grams)
    covered = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(lines), sum(w in quality.STOP_WORDS for w in words), len(re.findall("[A-Z]", text)),
    )


def test_quality_against_plain_python(spark):
    texts = [*edge_texts(), (20, "A#b$ | " * 30), (21, (prose(9, 12) + " ") * 3), (22, "THE!! " * 25), (23, prose(8, 9) * 2)]
    texts += [(24, " ".join(["a b c d e f g h i"] * 4)), (25, "\x0bleading\x0c and\rtrailing \x1cno blank ")]
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.judge(table(spark, texts)).collect()}
    for i, t in texts:
        m = brute_quality(t)
        r = got[i, m[0], m[1]]
        assert tuple(r[c] for c in quality.COUNTS) == m, i
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        assert r.base_failed == failed
        counts = dict(zip(quality.COUNTS, m, strict=True))
        rules = [
            x.name for x in quality.RULES
            if not x.low * counts[x.denominator] <= counts[x.numerator] <= x.high * counts[x.denominator]
        ]
        assert r.failed_rules == ",".join(rules) and r.kept == (not failed and not rules)
    assert quality.judge(empty(spark)).count() == 0


def test_quality_filter_keeps_columns_and_the_plan_native(spark):
    docs = edge(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    judged = {(r.doc_id, r.n_words) for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in judged}
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def brute_pieces(vocabulary, word):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        ways = []
        for i in range(j):
            if (gain := vocabulary.scores.get(word[i:j])) is not None:
                ways.append((best[i][0] + gain, -(best[i][1] + 1)))
        if word[j - 1] not in vocabulary.scores:
            gain, n = vocabulary.unknown(word[j - 1])
            ways.append((best[j - 1][0] + gain, -(best[j - 1][1] + n)))
        top = max(ways)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts_against_plain_dynamic_programming(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    vocabulary, memo = token_counts.Vocabulary.load(path), {}

    def count(text):
        words = [w.decode() for w in (text or "").encode().split()]
        for w in words:
            if w not in memo:
                memo[w] = brute_pieces(vocabulary, token_counts.BLANK + w)
        return len(words), sum(memo[w] for w in words)

    texts = [(i, t if i != 10 else t[:3000]) for i, t in edge_texts()]
    got = token_counts.count_tokens(table(spark, texts), path).collect()
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == Counter((i, *count(t)) for i, t in texts)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_trie_shares_prefixes_and_forgets_when_full():
    vocabulary = token_counts.Vocabulary({"a": -1.0, "b": -1.2, "ab": -1.5, "abb": -4.0, "bb": -1.1})
    trie = token_counts.Trie(vocabulary, nodes=6)
    words = ["ab", "abb", "abbb", "ba", "x", "aé", "abbabb"] * 2
    assert [trie.add(w) for w in words] == [brute_pieces(vocabulary, w) for w in words]
    fresh = token_counts.Trie(vocabulary)
    fresh.add("abb")
    size = len(fresh.score)
    fresh.add("abba")
    assert len(fresh.score) == size + 1


def test_long_words_leave_the_trie_alone():
    vocabulary = token_counts.Vocabulary({"a": -1.0, "b": -1.2, "ab": -1.5, "abb": -4.0, "bb": -1.1, "aaaa": -2.5})
    trie = token_counts.Trie(vocabulary)
    for word in ("ab" * 300, "abbaaaaxé" * 70, "a" * 513, "é" * 600):
        assert trie.add(word) == brute_pieces(vocabulary, word)
    assert len(trie.score) == 1
    at = "abb" * 400
    assert trie.add(at[: token_counts.LONG]) == brute_pieces(vocabulary, at[: token_counts.LONG])
    assert len(trie.score) == token_counts.LONG + 1

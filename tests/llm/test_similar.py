"""Near-duplicates, decontamination, license scans: found pairs against plain Python."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from chronoloom.llm import decontaminate, licenses, minhash
from chronoloom.llm.common import Stages
from chronoloom.llm.components import components
from chronoloom.llm.queries import QUERIES

from .data import edge, edge_texts, empty, prose, table


def shingles(text):
    words = text.split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(docs, least=0.8):
    """Components of all pairs of texts with the least weighted Jaccard similarity, by doc_id."""
    texts = sorted({t for i, t in docs if t is not None and i is not None})
    sets = {t: shingles(t) for t in texts}
    often = Counter(s for t in texts for s in sets[t])
    n = len(texts)

    def weight(s, c):
        return (1 + np.log(c)) * min(1.0, np.log1p(n / max(often[s] - minhash.FREE, 1e-9)) / np.log1p(1 / minhash.COMMON))

    weights = {t: {s: weight(s, c) for s, c in sets[t].items()} for t in texts}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            shared = sum(min(w, weights[b][s]) for s, w in weights[a].items() if s in weights[b])
            union = sum(weights[a].values()) + sum(weights[b].values()) - shared
            if shared and shared >= (least - 1e-9) * union:
                parent[root(a)] = root(b)
    first = {}
    for i, t in docs:
        if t is not None and i is not None:
            first[root(t)] = min(i, first.get(root(t), i))
    return Counter((i, i if t is None or i is None else first[root(t)]) for i, t in docs)


def near_copies():
    rng, docs = random.Random(3), []
    for group in range(12):
        base = prose(100 + group, 80 + 10 * group).split()
        for copy in range(6):
            words = list(base)
            for _ in range(copy % 4):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            docs.append((len(docs) + 50, " ".join(words)))
    return docs


def test_near_duplicates_against_all_pairs(spark):
    docs = [*edge_texts(), *near_copies()]
    got = minhash.near_duplicates(table(spark, docs)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes(docs)
    none = minhash.near_duplicates(empty(spark))
    assert none.count() == 0 and none.columns == ["doc_id", "class_id"]


def variants(n, words=81, own=3):
    """Texts that differ in the same few words: similarity is equal for all pairs."""
    base = prose(77, words).split()
    return [" ".join([*base[:40], *(f"v{k}w{j}" for j in range(own)), *base[40 + own :]]) for k in range(n)]


def test_copies_count_once_in_frequencies(spark):
    """Variants of a page with three copies each, too few to be hot; weighed as if there were no copies."""
    docs = [(1000 * c + k, t) for c in range(3) for k, t in enumerate(variants(60))]
    docs += [(10_000 + k, prose(5000 + k, 8)) for k in range(600)]
    got = minhash.near_duplicates(table(spark, docs)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes(docs)
    assert {r.class_id for r in got if r.doc_id < 10_000} == {0}


def plain_classes(texts, least=0.8):
    """Components of all pairs with the least five-word Jaccard similarity, each shingle weighing 1 + ln tf."""
    sets = [{s: 1 + np.log(c) for s, c in shingles(t).items()} for t in texts]
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            shared = sum(min(w, sets[b][s]) for s, w in sets[a].items() if s in sets[b])
            if shared >= (least - 1e-9) * (sum(sets[a].values()) + sum(sets[b].values()) - shared):
                label = [label[a] if x == label[b] else x for x in label]
    return [min(k for k, x in enumerate(label) if x == y) for y in label]


def test_near_copies_in_a_third_of_all_texts(spark, tmp_path):
    """The query finds them as in a small group; without idf all pairs are alike, with it none is."""
    rng, base = random.Random(8), prose(78, 200).split()
    texts = variants(60)
    for _ in range(30):  # another group, of which only some are alike
        words = list(base)
        for k in rng.sample(range(200), rng.randrange(8)):
            words[k] = f"w{rng.random()}"
        texts.append(" ".join(words))
    texts += [prose(6000 + k, 8) for k in range(110)]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_duplicates"](spark, str(tmp_path)).collect()}
    want = plain_classes(texts)
    assert want[:60] == [0] * 60
    assert sum(got[k] != want[k] for k in range(len(texts))) <= 1  # by the chance that a link isn't in any bucket
    kept = {r.doc_id for r in corpus_pipeline.single(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()}
    assert kept == {got[k] for k in got}


def test_a_large_group_of_alike_texts(spark):
    """One bucket with many components: copies whose links don't go through the smallest."""
    rng, base = random.Random(5), prose(9, 120).split()
    docs = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        docs.append((k, " ".join(words)))
    docs += [(1000 + k, base[0]) for k in range(50)]
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(table(spark, docs)).collect())
    want = brute_classes(docs)
    assert sum((got - want).values()) <= 4  # of 450, by the chance that a link isn't in any bucket


def test_blocks_compare_like_all_pairs(monkeypatch, spark):
    monkeypatch.setattr(minhash, "BLOCK_STRAYS", 7)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 11)
    docs = [(k, t) for k, (_, t) in enumerate(near_copies())]
    texts = spark.createDataFrame(docs, "node long, text string")
    candidates = texts.selectExpr("0L AS key", "0L AS pivot", "node", "'' AS digest")
    found = spark.createDataFrame([(0, 0), (1, 0)], "node long, label long")
    shared = spark.sparkContext.broadcast(np.zeros(2 * minhash.CELLS))
    links = minhash._cross_links(candidates, found, texts, shared, 72, 0.8).collect()
    sets = [set(shingles(t)) for _, t in docs]
    want = {(a, b) for b in range(len(docs)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in links} == want - {(0, 1)}


def test_samples_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    w = rng.uniform(0.3, 3.0, 300)
    v = w * rng.choice([1.0, 1.7], 300)
    a, b = np.sort(h[:250]), np.sort(h[50:])
    wa, wb = w[:250][np.argsort(h[:250])], v[50:][np.argsort(h[50:])]
    one = minhash.sample(a, wa, np.array([0]), 3000)
    two = minhash.sample(b, wb, np.array([0]), 3000)
    at, bt = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    shared = sum(min(at[x], bt[x]) for x in at if x in bt)
    want = shared / (wa.sum() + wb.sum() - shared)
    assert abs((one == two).mean() - want) < 0.03


def test_keep_one_keeps_columns_and_rows_without_text(spark):
    docs = edge(spark)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[11] == 1 and ids[4] == 1 and ids[None] == 2
    assert minhash.keep_one(empty(spark)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_random(spark, links):
    check_components(spark, links)


def test_components_of_chains_and_hubs(spark):
    check_components(spark, [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 300)])


def check_components(spark, links):
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components(df, Stages(spark, "components")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def bench(spark, rows):
    df = spark.createDataFrame(rows, "item_id long, text string, seed string")
    return df


def brute_overlaps(docs, items):
    out = Counter()
    for i, t in docs:
        words = [decontaminate.plain(w) for w in (t or "").split()]
        for item, text in items:
            own = [decontaminate.plain(w) for w in (text or "").split()]
            best = None
            for d in range(-len(own) + 1, len(words)):
                a, b = np.array(words, object), np.array(own, object)
                start, n, m = decontaminate.best_run(a, b, d)
                if m >= min(12, -(-8 * len(own) // 10)) and (best is None or (m, -n, -start) > best):
                    best = (m, -n, -start)
            if best and own:
                out[i, item, -best[2], -best[1], best[0]] += 1
    return out


def test_overlaps_against_every_diagonal(spark):
    items = [(k, prose(300 + k, 15 + 6 * k)) for k in range(6)]
    words = [t.split() for _, t in items]
    changed = list(words[3])
    changed[5], changed[16] = "other", "Words"
    docs = [
        *[(i, t) for i, t in edge_texts() if i not in (8, 10)],
        (100, prose(7, 30) + " " + items[0][1] + " " + prose(8, 20)),  # whole
        (101, " ".join(changed).upper() + "!"),  # substitutions, case, punctuation
        (102, prose(6, 12) + " " + " ".join(words[4][5:11]) + " " + prose(5, 10)),  # six words only
        (103, " ".join(words[5][3:20])),  # a part
        (104, items[1][1] + " " + items[1][1] + " " + items[2][1]),  # twice, and another
        (104, items[1][1] + " " + items[1][1] + " " + items[2][1]),
    ]
    full = [*items, (90, None), (91, ""), (92, "too short"), (None, "")]
    found = decontaminate.overlaps(table(spark, docs), bench(spark, [(i, t, "x") for i, t in full])).collect()
    got = Counter((r.doc_id, r.item_id, r.doc_start, r.n_words, r.n_matches) for r in found)
    assert got == brute_overlaps(docs, [x for x in full if x[0] is not None])
    assert {r.doc_id for r in found} == {100, 101, 103, 104}


def every_run(same):
    """(matches, -length, -start) of the best of all runs of which four in five match."""
    found = [(0, 0, 0)]
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            m = sum(same[i:j])
            if m and 5 * m >= 4 * (j - i):
                found.append((m, i - j, -i))
    return max(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([True, True, True, False]), max_size=40), st.integers(-3, 3))
def test_best_run_against_all_starts_and_ends(same, shift):
    item = np.arange(len(same), dtype=np.uint64)
    doc = np.where(np.array(same, bool), item, item + np.uint64(1000))
    doc = np.concatenate([np.full(shift, 999, np.uint64), doc]) if shift > 0 else doc[-shift:]
    start, n, matches = decontaminate.best_run(doc, item, shift)
    want = every_run(same[max(-shift, 0) :])
    assert (matches, -n) == want[:2] and (not matches or start - max(shift, 0) == -want[2])


def test_substitutions_anywhere_in_a_passage(spark):
    """Four in five words match, though the cleanest stretch alone has fewer than 12."""
    items = [(1, prose(300, 15)), (2, prose(301, 25)), (3, prose(302, 20))]
    docs = []
    for item, places in [(0, [3]), (0, [11]), (0, [3, 9]), (1, [4, 9, 14, 19, 24]), (2, [2, 9, 12, 17])]:
        words = items[item][1].split()
        for k in places:
            words[k] = f"other{k}"
        docs.append((100 * (item + 1) + len(docs), prose(8, 20) + " " + " ".join(words) + " " + prose(9, 20)))
    found = decontaminate.overlaps(table(spark, docs), bench(spark, [(i, t, "x") for i, t in items])).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i // 100) for i, _ in docs}
    assert all(5 * r.n_matches >= 4 * r.n_words and r.n_matches >= 12 for r in found)


def test_short_items_with_every_choice_of_other_words(spark):
    """Items of 1 to 14 words: a text for each way in which as many words differ as may; also at a text's ends."""
    items = [(n, " ".join(prose(400 + n, 60).split()[:n])) for n in range(1, 15)]
    docs, want = [], set()
    for n, text in items:
        own = text.split()
        for k, places in enumerate(combinations(range(n), n - min(12, -(-8 * n // 10)))):
            words = [f"other{i}" if i in places else w for i, w in enumerate(own)]
            around = ["", "before "][k % 2], ["", " behind"][k // 2 % 2]
            docs.append((1000 * n + k, around[0] + " ".join(words) + around[1]))
            want.add((1000 * n + k, n))
    docs += [(1, " ".join([items[0][1]] * 50)), (2, prose(9, 40))]
    found = decontaminate.overlaps(table(spark, docs), bench(spark, [(i, t, "x") for i, t in items])).collect()
    got = Counter((r.doc_id, r.item_id, r.doc_start, r.n_words, r.n_matches) for r in found)
    assert got == brute_overlaps(docs, items)
    assert want <= {(r.doc_id, r.item_id) for r in found}
    few = decontaminate.overlaps(table(spark, docs), bench(spark, [(i, t, "x") for i, t in items]), least_item_words=5).collect()
    assert {(r.doc_id, r.item_id) for r in few} == {(d, i) for d, i, *_ in got if i >= 5}


def test_unseen_documents_stay(spark):
    items = bench(spark, [(1, prose(300, 20), "x")])
    docs = table(spark, [*edge_texts(), (100, "a b " + prose(300, 20))])
    kept = decontaminate.keep_unseen(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in edge_texts())
    assert decontaminate.overlaps(empty(spark), items).count() == 0
    assert decontaminate.overlaps(docs, items.limit(0)).count() == 0


def test_patience_alignment():
    a, b = "x a b c c d e y".split(), "a b c d d e".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
    assert len({j for _, j in pairs}) == len(pairs) == 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert len(pairs) == len(a)


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 9)
    docs = [
        *edge_texts(),
        (100, prose(1, 2000) + "\n" + mit.upper() + " " + prose(2, 50)),
        (101, prose(3, 30) + " " + cut),
        (102, " ".join(mit.split()[:30])),
        (103, "Released under the MIT License."),
    ]
    rows = licenses.scan_licenses(table(spark, docs)).collect()
    got = {(r.doc_id, r.license): r for r in rows}
    assert set(got) == {(100, "MIT-text"), (101, "MIT-text"), (103, "MIT")}
    whole = got[100, "MIT-text"]
    assert whole.coverage == 1.0 and whole.end_word - whole.start_word == whole.n_matched
    assert 0.85 < got[101, "MIT-text"].coverage < 0.95
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert licenses.scan_licenses(table(spark, docs), {"none": " ... "}).count() == 0


def test_license_notice_after_a_stretch_of_its_words(spark):
    docs = [
        (1, "the MIT license was released under a board vote " + prose(1, 30) + " Released under the MIT License"),
        (2, "Released under the BSD License"),
        (3, "Licensed under CC BY-SA 4.0"),
        (4, "This work is licensed under the GNU General Public License, version 2"),
        (5, "Released\u00a0under\u2003the MIT License"),
        (6, "This work is licensed under the GNU General Public License, version 3"),
    ]
    rows = licenses.scan_licenses(table(spark, docs)).collect()
    assert {(r.doc_id, r.license, r.coverage) for r in rows} == {(1, "MIT", 1.0), (5, "MIT", 1.0), (6, "GPL-3.0", 1.0)}
    assert [(r.start_word, r.end_word) for r in rows if r.doc_id == 1] == [(39, 44)]


def test_license_bound_loses_nothing(spark):
    """Without the bound, every text and template aligned."""
    docs = [(k, prose(k, 15) + " " + " ".join(t.split()[: 3 + 4 * k])) for k, t in enumerate(licenses.TEMPLATES.values())]
    want = set()
    for i, t in docs:
        for name, text in licenses.TEMPLATES.items():
            words = licenses.words_of(text)
            if licenses.scan_words(licenses.words_of(t), words)[2] >= 0.8 * len(words):
                want.add((i, name))
    assert {(r.doc_id, r.license) for r in licenses.scan_licenses(table(spark, docs)).collect()} == want


def test_word_windows_stay_within_their_text():
    from chronoloom.llm.words import distinct, windows, word_hashes

    words, starts = word_hashes(pa.array(["a b c d e f", None, "a b", "", " a  b c d e "]))
    assert starts.tolist() == [0, 6, 6, 8, 8, 13]
    hashes, owner = windows(words, starts, 5)
    assert owner.tolist() == [0, 0, 2, 4] and hashes[0] == hashes[3]
    h, o, n = distinct(np.array([5, 5, 7, 5], np.uint64), np.array([0, 0, 0, 1]))
    assert h.tolist() == [5, 7, 5] and o.tolist() == [0, 0, 1] and n.tolist() == [2, 1, 1]



NOTICES = {
    "This work is licensed under the GNU General Public License, version 3": {"GPL-3.0"},
    "This work is licensed under the GNU Affero General Public License, version 3": set(),
    "This work is licensed under the GNU Lesser General Public License, version 3": set(),
    "This work is licensed under a Creative Commons Attribution 4.0 International License": {"CC-BY-4.0"},
    "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License": set(),
    "This work is licensed under a Creative Commons Attribution Non Commercial 4.0 International License": set(),
    "Released under the BSD License": set(),
    "Released under the MIT License": {"MIT"},
    # a broken phrase first, the notice itself after it
    "licensed under the GNU Lesser General Public License, version 3. This work is licensed under the GNU General Public "
    "License, version 3": {"GPL-3.0"},
}


def test_other_words_within_a_name_are_another_license(spark):
    docs = [(k, f"{prose(k, 40)} {text} {prose(50 + k, 40)}") for k, text in enumerate(NOTICES)]
    found = {k: set() for k in range(len(docs))}
    for r in licenses.scan_licenses(table(spark, docs)).collect():
        found[r.doc_id].add(r.license)
    assert [found[k] for k in range(len(docs))] == list(NOTICES.values())
    with pytest.raises(ValueError):
        licenses.phrases_in(["the", "mit", "license"], ("license mit",))

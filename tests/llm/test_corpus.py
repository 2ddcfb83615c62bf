"""Toxicity, archives and the pipeline."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import toxicity, warc

from .data import edge, edge_texts, empty, prose, table

# -- toxicity ---------------------------------------------------------------------------------------


def toxic_docs(n=600):
    """An insult counts; so does a pair of words of which either alone is harmless."""
    rng, docs, labels = random.Random(2), [], []
    for k in range(n):
        words = prose(1000 + k, 30).split()
        kind = k % 6
        add = {0: ["idiotx"], 1: ["shovel", "group"], 2: ["shovel"], 3: ["group"]}.get(kind, [])
        for w in add:
            words.insert(rng.randrange(len(words)), w)
        docs.append((k, " ".join(words)))
        labels.append((k, int(kind in (0, 1))))
    return docs, labels


def labels_of(spark, rows):
    return spark.createDataFrame([(i, None, t) for i, t in rows], "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_interactions_are_learnt_and_held_out_rows_are_not_read(spark):
    docs, labels = toxic_docs()
    model = toxicity.fit(table(spark, docs), labels_of(spark, labels))
    rows = {r.doc_id: r for r in toxicity.score(table(spark, docs), model).collect()}
    truth = dict(labels)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    test = [i for i in rows if held(i)]
    assert np.mean([rows[i].predicted == truth[i] for i in test]) >= 0.95
    pairs = [i for i in test if i % 6 == 1]
    assert np.mean([rows[i].predicted for i in pairs]) >= 0.9
    wrong = [(i, t if not held(i) else 1 - t) for i, t in labels]
    same = toxicity.fit(table(spark, docs), labels_of(spark, wrong))
    assert np.array_equal(same.weight, model.weight) and np.array_equal(same.vectors, model.vectors)


def test_score_is_that_of_the_formula(spark):
    docs, labels = toxic_docs(240)
    model = toxicity.fit(table(spark, docs), labels_of(spark, labels))
    place = {t: k for k, t in enumerate(model.terms.tolist())}
    rows = {r.doc_id: r.score for r in toxicity.score(table(spark, docs), model).collect()}
    for i, text in docs[:40]:
        known = {place[c] for c in toxicity.hashed(text.split()).reshape(-1).tolist() if c in place}
        total = model.constant + sum(model.weight[k] for k in known)
        total += sum(model.vectors[a] @ model.vectors[b] for a in known for b in known if a < b)
        assert rows[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_toxicity_on_awkward_rows(spark):
    docs, labels = toxic_docs(240)
    both = [*edge_texts(), *[(i + 5000, t) for i, t in docs]]
    known = [(i + 5000, t) for i, t in labels] + [(None, 1), (4, None), (11, 0), (11, 0), (1, 0)]
    model = toxicity.fit(table(spark, both), labels_of(spark, known))
    rows = toxicity.score(edge(spark), model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in edge_texts())
    assert all(r.score is not None and r.predicted == 0 for r in rows)
    kept = toxicity.keep_civil(edge(spark), labels_of(spark, [(1, 0), (2, 1)]))
    assert kept.columns == edge(spark).columns
    for none in (labels_of(spark, []), labels_of(spark, [(1, 0)])):
        fitted = toxicity.fit(edge(spark), none)
        assert {r.predicted for r in toxicity.score(edge(spark), fitted).collect()} <= {0, 1}
    assert toxicity.score(empty(spark), model).count() == 0


# -- archives ---------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, salt int, first long"


def pages():
    long_text = "<p>" + "ü" * 120 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n"
    rows = [
        (5, "http://a/5", long_text), (3, "http://a/3", long_text), (9, None, long_text),
        (1, "http://a/1", "short"), (2, "http://a/2\r\nX: y", "short"), (4, "u", None), (6, "u", ""),
        (7, "u", "x" * 300_000), (8, "u", "\x00\x1f" * 60), (8, "u", "\x00\x1f" * 60), (None, "u", "no id" * 40), (None, "u", None),
    ]
    return [(*r, "j", 1, 1) for r in rows]


def brute_records(rows):
    first = {}
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    out = Counter()
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        to = first.get(data)
        revisit = to is not None and to != i
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


def test_archives_round_trip(spark, tmp_path):
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    warc.write_monolithic(df, whole)
    for f in (tmp_path / "whole").glob("*.gz"):  # one stream each
        machine = zlib.decompressobj(31)
        machine.decompress(f.read_bytes())
        assert machine.eof and not machine.unused_data
    warc.normalise(spark, whole, split)
    rows = warc.read_archives(spark, split).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert got == brute_records(pages())
    html = {i: (h or "").encode() for i, _, h, *_ in pages()}
    assert all(bytes(r.payload) == html[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)
    index = warc.read_index(spark, split).collect()
    assert len(index) == len(rows)
    for r in index:  # every record is a gzip member of its own, where the index says
        data = (tmp_path / "split" / "kind=0" / r.name).read_bytes()
        record = gzip.decompress(data[r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    wanted = spark.createDataFrame([(7,), (3,), (77,)], "page_id long")
    found = {r.page_id: bytes(r.payload) for r in warc.fetch(spark, split, wanted).collect()}
    assert found == {7: html[7], 3: html[3]}


def test_archives_of_an_empty_table(spark, tmp_path):
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    warc.write_monolithic(spark.createDataFrame([], PAGES), whole)
    warc.normalise(spark, whole, split)
    assert warc.read_archives(spark, split).count() == 0
    assert warc.read_index(spark, split).count() == 0


def test_long_records_end_in_a_zero_byte(monkeypatch):
    monkeypatch.setattr(warc, "_LONG", 50)
    parts = [b"a" * 10, b"b" * 100, b"c" * 49]
    data = b"".join(map(warc.deflate, parts))
    assert all(warc.deflate(p)[-1] == 0 for p in parts)
    found = list(warc.members(memoryview(data)))
    assert [r for _, _, r in found] == parts
    assert [o for o, _, _ in found] == [0, *np.cumsum([n for _, n, _ in found])[:-1].tolist()]
    assert b"".join(warc.inflate(data)) == b"".join(parts) == gzip.decompress(data)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=8), st.integers(1, 50))
def test_records_are_cut_by_their_length(payloads, step):
    whole = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(p), p) for p in payloads]
    data = b"".join(whole)
    pieces = [data[k : k + step] for k in range(0, len(data), step)]
    assert list(warc.records(iter(pieces))) == whole
    if whole and len(data) > 4:
        with pytest.raises(ValueError):
            list(warc.records(iter([data[:-3]])))


# -- the pipeline -----------------------------------------------------------------------------------


def test_pipeline_against_its_stages_in_plain_python(spark):
    import corpus_pipeline
    from chronoloom.llm import decontaminate, packing, quality

    from .test_rows import brute_quality
    from .test_similar import brute_classes

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    names = list(rows)
    features = model.features(*toxicity._terms(pa.array([rows[i] for i in names])))
    scores = dict(zip(names, model.score(*features, len(names)), strict=True))
    kept = {i: t for i, t in rows.items() if scores[i] < 0.5}
    civil = set(kept)

    def good(text):
        m = brute_quality(text)
        counts = dict(zip(quality.COUNTS, m, strict=True))
        ratios = all(
            x.low * counts[x.denominator] <= counts[x.numerator] <= x.high * counts[x.denominator] for x in quality.RULES
        )
        return m[0] >= 20 and 100 * m[4] <= 30 * m[0] and ratios

    kept = {i: t for i, t in kept.items() if good(t)}
    kept = {i: kept[i] for i, label in brute_classes(list(kept.items())) if i == label}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    grams = {}
    for b in bench:
        items = [decontaminate.plain(w) for w in b.text.split()]
        for k in range(len(items) - 2):
            grams.setdefault(tuple(items[k : k + 3]), []).append((np.array(items, object), k))

    def seen(text):
        words = [decontaminate.plain(w) for w in text.split()]
        ways = {(id(own), j - k): own for j in range(len(words) - 2) for own, k in grams.get(tuple(words[j : j + 3]), ())}
        a = np.array(words, object)
        return any(
            decontaminate.best_run(a, own, d)[2] >= min(12, -(-8 * len(own) // 10)) for (_, d), own in ways.items()
        )

    kept = {i: t for i, t in kept.items() if not seen(t)}
    assert 0 < len(kept) < len(civil) < len(rows)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(kept)
    public = pytest.importorskip("public_tokenizers")
    lengths = Counter()
    for r in out:
        lengths[r.doc_id] += r.length
    from chronoloom.llm.tokens import encoder

    tokenizer = encoder(public.path("word_bpe_49k.json")).tokenizer
    assert lengths == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert max(Counter(r.sequence_id for r in out).values()) >= 1 and packing.END_ID == 1


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, edge_texts(), extra=False)
    sf = "/root/testdata/sf0.001"
    given_ids = Counter(i for i, _ in edge_texts())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert not Counter(r.doc_id for r in out.collect()) - given_ids
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality rules", "near-duplicates", "decontamination", "packing",
    ]
    none = empty(spark).select(docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_queries_are_registered_once_per_operator():
    import __spark_entry__
    from chronoloom.llm.queries import ORACLES, QUERIES

    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())

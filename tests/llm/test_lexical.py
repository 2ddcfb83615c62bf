"""Ranked search against scores of every document for every item."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from chronoloom.llm import lexical
from chronoloom.llm.common import Stages

from .data import edge_texts, empty, prose, table

UPPER = {c: chr(c + 32) for c in range(65, 91)}


def cut(text):
    """Terms by the definition: maximal runs of anything that isn't an ASCII sign, blank or control."""
    out, run = [], ""
    for c in (text or "").translate(UPPER) + " ":
        if c.isascii() and not c.isalnum():
            if run:
                out.append(run)
            run = ""
        else:
            run += c
    return out


def brute(docs, items, k):
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                for w in set(cut(text)) if w in c
            )
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, parts=5, measure=None):
    df = spark.createDataFrame([(i, t, "j", "j", "j") for i, t in items], "item_id long, text string, q string, rank string, terms string")
    rows = lexical.search(table(spark, docs).repartition(parts), df, k, measure=measure)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


ITEMS = [
    (1, prose(1, 30)), (2, "ALPHA beta-gamma; the the THE"), (3, None), (4, ""), (5, "?! ..."), (6, "nowhere-to-be-found qqqq"),
    (1, prose(2, 20)), (1, prose(2, 20)), (None, "日本語 👍🏽 ünïcode Ünïcode é"), (7, "x" * 20_000 + " xx one"), (8, prose(8, 3000)),
]


def test_against_every_document(spark, monkeypatch):
    docs = [*edge_texts(), *[(100 + k % 60, prose(k % 45, 5 + 7 * (k % 30))) for k in range(150)], (500, "the " * 900 + "alpha")]
    monkeypatch.setattr(lexical, "QUERIES", 4)  # several blocks of queries
    assert found(spark, docs, ITEMS) == brute(docs, ITEMS, 10)


def test_a_common_passage_and_few_scores(spark):
    """A third of all documents hold one passage; ties at the tenth place go by id."""
    passage = prose(99, 40)
    docs = [(k, passage + " " + prose(k, 30) if k % 3 == 0 else prose(k, 70)) for k in range(600)]
    docs += [(1000 + k, passage) for k in range(30)]
    random.Random(3).shuffle(docs)
    items, seen = [(1, passage), (2, prose(7, 25)), (3, "kappa7 lambda3")], []
    assert found(spark, docs, items, measure=seen) == brute(docs, items, 10)
    assert seen[0] < 0.5 * len(docs) * len(items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(empty(spark), some).count() == 0
    assert lexical.search(table(spark, [(1, "the end"), (2, None)]), none).count() == 0
    assert lexical.search(table(spark, [(1, None), (2, " .")]), some).count() == 0


def test_memory_does_not_follow_a_part(spark, monkeypatch):
    """One part of 300 blocks: row groups of the index and what a worker holds are a few blocks."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 1)
    text = F.expr("array_join(transform(sequence(1, 3000), x -> sha2(concat(id, ' ', x), 256)), '')")
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    blocks, frequencies = lexical.build_index(docs, Stages(spark, "lexical"))
    assert blocks.count() == frequencies.count() == 300
    for path in blocks.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
        assert max(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups) < 18 << 20
    (batch,) = blocks.toArrow().combine_chunks().to_batches()
    queries = lexical.Queries([b"none"], [np.array([0])], [np.array([1])], 300, 300, 10)
    tracemalloc.start()
    try:
        rows = [len(b) for b in lexical._score_all(iter([batch]), queries, np.array([1 << 60]))]
        assert rows == [1] and tracemalloc.get_traced_memory()[1] < batch.nbytes / 4
    finally:
        tracemalloc.stop()

"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms, words and their beginnings, hashed to 32 bits. The score is the logistic function of
``w0 + sum(w_i) + sum over pairs of (v_i . v_j)``: besides a weight, each term has a short vector, so two
terms that are harmless alone can count together, which additive weights miss.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, by hash of the id). Spark counts the
terms of the sample by label and keeps those that go with it; one task fits weights and vectors of these.
So the size of the model is bounded too. Every document is scored whole in the scan, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, column, slices

SAMPLE = 12_000  # labelled rows to learn from
LEAST_DOCUMENTS = 4  # of the sample that a term must be in
LEAST_Z = 3.0  # standard errors between how often toxic and other documents have the term
BEGINNINGS = (3, 4, 5)  # characters of a word that are a term too
FACTORS = 4
EPOCHS = 80
TOXIC_WEIGHT = 2.0  # of a toxic row against another in the loss


def held_out(id_col: str) -> Column:
    """Whether a row is kept for testing: crc32 of the id as text is divisible by five."""
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit(""))) % 5 == 0


def term(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}…«»„“”‚‘’#*$%&|<>_-")


def hashed(words: list[str]) -> np.ndarray:
    """Hashes of the terms of each word, a row per word: the word and its beginnings; -1 where there is none.

    Beginnings catch words that share a stem with words of the sample.
    """
    out = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int64)
    for k, word in enumerate(map(term, words)):
        if word:
            out[k, 0] = xxhash.xxh32_intdigest(word)
            for j, n in enumerate(BEGINNINGS, 1):
                if len(word) > n:
                    out[k, j] = xxhash.xxh32_intdigest(word[:n] + "*")
    return out


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of all texts, each once."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    rows = hashed(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    kinds = len(rows) or 1
    both = np.unique(owner * kinds + flat.indices.to_numpy(zero_copy_only=False))
    codes = rows[both % kinds] if len(rows) else rows
    docs = np.repeat(both // kinds, rows.shape[1])
    return docs, codes.reshape(-1)


@dataclass(frozen=True)
class Machine:
    """A fitted model: sorted term hashes, their weights and vectors, and the constant."""

    terms: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    constant: float

    def features(self, docs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place of the term in the model) for the terms it holds, each once."""
        if len(self.terms) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        known = (self.terms[at] == codes) & (codes >= 0)
        both = np.unique(docs[known] * len(self.terms) + at[known])
        return both // len(self.terms), both % len(self.terms)

    def score(self, docs: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_margin(self, docs, features, n)[0], -30, 30)))


def _margin(model: Machine, docs: np.ndarray, features: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The argument of the logistic function, and each document's sum of vectors."""
    linear = np.bincount(docs, model.weight[features], n)
    sums = np.stack([np.bincount(docs, v[features], n) for v in model.vectors.T], 1)
    squares = np.bincount(docs, (model.vectors[features] ** 2).sum(1), n)
    return model.constant + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def fit_machine(docs: np.ndarray, codes: np.ndarray, labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """Fit by AdaGrad on the logistic loss, with all sampled rows in each of many small batches.

    ``docs`` and ``codes`` say which document has which of the chosen terms, ``docs`` ascending.
    """
    n, rng = len(labels), np.random.default_rng(7)
    kinds, at = np.unique(codes, return_inverse=True)
    toxic, m = int(labels.sum()), len(kinds)
    rate = (toxic + 0.5) / (n + 1)
    model = Machine(kinds, np.zeros(m), rng.normal(0, 0.05, (m, factors)), float(np.log(rate / (1 - rate))))
    if m == 0 or toxic in (0, n):
        return model
    starts = np.searchsorted(docs, np.arange(n + 1))
    constant, weight, vectors = model.constant, model.weight, model.vectors
    past = [1e-6, np.full(m, 1e-6), np.full((m, factors), 1e-6)]
    for _ in range(epochs):
        order = rng.permutation(n)
        for rows in np.array_split(order, max(1, n // 256)):
            lengths = starts[rows + 1] - starts[rows]
            own = np.repeat(np.arange(len(rows)), lengths)
            f = at[np.repeat(starts[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
            now = Machine(model.terms, weight, vectors, constant)
            margin, sums = _margin(now, own, f, len(rows))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            error *= np.where(labels[rows] == 1, TOXIC_WEIGHT, 1.0)
            g0 = error.sum()
            g1 = np.bincount(f, error[own], m) + 1e-5 * weight
            slope = error[own][:, None] * (sums[own] - vectors[f])
            g2 = np.stack([np.bincount(f, s, m) for s in slope.T], 1) + 1e-4 * vectors
            past = [past[0] + g0**2, past[1] + g1**2, past[2] + g2**2]
            constant -= 0.1 * g0 / np.sqrt(past[0])
            weight = weight - 0.1 * g1 / np.sqrt(past[1])
            vectors = vectors - 0.05 * g2 / np.sqrt(past[2])
    return Machine(model.terms, weight, vectors, float(constant))


def _sample_terms(batches: Iterator[pa.RecordBatch]):
    for batch in slices(batches, "text"):
        docs, codes = _terms(batch.column("text"))
        both = np.unique((docs[codes >= 0] << 33) | codes[codes >= 0])
        docs, codes = both >> 33, both & ((1 << 33) - 1)
        starts = np.searchsorted(docs, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(codes))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "terms"])


def _fit_sample(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("doc_id")
    docs = np.repeat(np.arange(len(frame)), frame["terms"].map(len))
    codes = np.concatenate([*frame["terms"], np.zeros(0, np.int64)]).astype(np.int64)
    model = fit_machine(docs, codes, frame["toxic"].to_numpy(np.int64))
    return pd.DataFrame(
        {
            "terms": [model.terms.tobytes()], "weight": [model.weight.tobytes()],
            "vectors": [model.vectors.tobytes()], "constant": [model.constant],
        }
    )


def _telling(each: DataFrame, n: int, toxic: int) -> DataFrame:
    """The terms that go with the label: in ``LEAST_DOCUMENTS`` rows, and ``LEAST_Z`` standard errors
    between the shares of toxic and of other rows that have them."""
    counted = each.where("term is not null").groupBy("term").agg(F.count("*").alias("seen"), F.sum("toxic").alias("bad"))
    share = (F.col("seen") + 1) / (n + 2)
    gap = (F.col("bad") + 0.5) / (toxic + 1) - (F.col("seen") - F.col("bad") + 0.5) / (n - toxic + 1)
    z = gap / F.sqrt(share * (1 - share) * (1 / (toxic + 1) + 1 / (n - toxic + 1)))
    telling = counted.where((F.col("seen") >= LEAST_DOCUMENTS) & (F.abs(z) >= LEAST_Z))
    return telling.select("term", F.lit(True).alias("telling"))


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> Machine:
    """Learn from at most ``sample`` labelled rows whose id isn't held out.

    ``labels`` has the id column and ``toxic``; null ids and labels are left out, of several labels of an
    id the largest counts. The rows are those with the smallest hash of the id, so they are spread over
    the table. Without rows of both labels the model is a constant.
    """
    ident = column(id_col).cast("long").alias("doc_id")
    known = labels.select(ident, column("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    stages = Stages(docs.sparkSession, "toxicity")
    chosen = stages.write(chosen, "sample")
    texts = docs.select(ident, column(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    terms = rows.mapInArrow(_sample_terms, "doc_id bigint, toxic int, terms array<bigint>")
    terms = stages.write(terms.groupBy("doc_id", "toxic").agg(F.any_value("terms").alias("terms")), "terms")
    each = terms.select("doc_id", "toxic", F.explode_outer("terms").alias("term"))
    chosen = stages.write(_telling(each, *terms.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()), "chosen")
    features = each.join(chosen, "term", "left").groupBy("doc_id", "toxic").agg(
        F.sort_array(F.collect_list(F.when(F.col("telling"), F.col("term")))).alias("terms")
    )
    fitted = features.groupBy().applyInPandas(
        _fit_sample, "terms binary, weight binary, vectors binary, constant double"
    )
    row = fitted.first()
    stages.drop(terms)
    if row is None:
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    return Machine(
        np.frombuffer(row.terms, np.int64),
        np.frombuffer(row.weight),
        np.frombuffer(row.vectors).reshape(-1, FACTORS),
        row.constant,
    )


def _scores(batches: Iterator[pa.RecordBatch], model: Machine):
    for batch in slices(batches, "_text"):
        docs, features = model.features(*_terms(batch.column("_text")))
        score = model.score(docs, features, batch.num_rows)
        columns = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "_text"]
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [*names, "_score"])


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    A null or empty text has no terms and gets the score of the constant. A null id counts as held out.
    Repeated rows are scored alike; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("_text"))
    scored = narrow.mapInArrow(lambda it: _scores(it, shared.value), "doc_id bigint, _score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5 under a model fitted on them."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))
    names = [f"_c{k}" for k in range(len(docs.columns))]
    given = docs.select(*[column(c).alias(a) for c, a in zip(docs.columns, names, strict=True)])
    given = given.withColumn("_text", F.col(names[docs.columns.index(text_col)]))
    types = ", ".join(f"{a} {t}" for a, (_, t) in zip(names, docs.dtypes, strict=True))
    scored = given.mapInArrow(lambda it: _scores(it, shared.value), f"{types}, _score double")
    return scored.where("_score < 0.5").select(*[F.col(a).alias(c) for c, a in zip(docs.columns, names, strict=True)])

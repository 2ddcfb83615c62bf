"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and all but the last return
the columns of ``documents``. ``run`` writes every stage to the shared folder and reads it again, so a lost
executor never reaches back beyond its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import Stages
from chronoloom.llm.decontaminate import keep_unseen
from chronoloom.llm.minhash import keep_one
from chronoloom.llm.packing import pack
from chronoloom.llm.quality import keep_good
from chronoloom.llm.queries import table, word_tokenizer
from chronoloom.llm.toxicity import keep_civil


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, scores below 0.5."""
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the table of quality rules."""
    return keep_good(docs)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates."""
    return keep_one(docs, plain=True)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return keep_unseen(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return pack(docs, word_tokenizer(), capacity=4096)


STAGES = [
    ("toxicity", civil),
    ("quality rules", good),
    ("near-duplicates", single),
    ("decontamination", unseen),
    ("packing", packed),
]

#: A fitted model, hashed candidate search and a tokenizer are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stages = Stages(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stages.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            stages.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import Stages, remove
from .decontaminate import overlaps
from .embeddings import vector_links
from .lexical import search
from .licenses import scan_licenses
from .minhash import near_duplicates
from .packing import pack
from .prefix_trie import prefix_trie
from .quality import judge
from .sharding import interleave_shards
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .toxicity import fit, score
from .warc import normalise, read_archives, write_monolithic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def wrap(run):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Where the public word tokenizer is; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), plain=True)


@query(sql.SHARDS)
def op2_interleaved_shards(spark, sf_dir):
    return interleave_shards(table(spark, sf_dir, "documents"), n_shards=16)


@query()
def op3_trie_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(sql.QUALITY)
def op4_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


@query()
def op5_toxicity_machine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


@query(sql.WARC)
def op6_warc_normaliser(spark, sf_dir):
    stages = Stages(spark, "warc")
    whole, split = stages.path("whole"), stages.path("split")
    write_monolithic(table(spark, sf_dir, "pages"), whole)
    normalise(spark, whole, split)
    remove(spark, whole)
    found = read_archives(spark, split, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op7_patience_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op8_sum_of_squares_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096)


@query()
def op9_repair_token_files(spark, sf_dir):
    path = Stages(spark, "tokens").path("files")
    write_token_files(table(spark, sf_dir, "documents"), path, word_tokenizer())
    return read_token_files(spark, path)


@query()
def op10_spaced_seed_decontamination(spark, sf_dir):
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches")


@query(sql.VECTORS)
def op11_pca_tiled_vectors(spark, sf_dir):
    return vector_links(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query(sql.TRIE)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query(sql.SEARCH)
def op13_bit_sliced_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)

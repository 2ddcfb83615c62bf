"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source. A row's fractional rank is where it stands in
its source, between 0 and 1. Sorted by that number the sources interleave in proportion, so any run of
the order has the mixture of the whole, and equal cuts make shards whose sizes differ by one row at most.

No source is ever in one task, nor a run of rows alike in what the order goes by: both orders are sorted by
range and numbered by the places of their partitions, and a source's first place is joined back with hot
sources dealt. Texts aren't shuffled, only their size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import global_positions, join
from .common import Stages, column


def interleave_shards(
    docs: DataFrame,
    n_shards: int = 16,
    seed: str = "shards-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, source, law, shard, slot, grown_shard.

    The law is ``rows``: counts of shards differ by one at most, and ``slot`` numbers the rows of a shard
    from 0 without gaps. ``grown_shard`` is null, since it belongs to another law. Equal texts aren't
    kept together: under this law a group larger than a shard couldn't be.

    Nulls: a null text counts as empty; null sources are one source of their own; a null id is shuffled
    like any other value. Repeated rows and ties are ordered by id, checksum and size; rows equal in all
    of these are interchangeable. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    text, ident = F.coalesce(column(text_col), F.lit("")), column(id_col)
    total = docs.count()
    mix = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))))
    rows = docs.select(
        ident.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        column(source_col).alias("source"),
        F.when(column(source_col).isNull(), "null").otherwise(F.concat(F.lit("="), column(source_col))).alias("stratum"),
        F.conv(F.substring(mix, 1, 15), 16, 10).cast("long").alias("mix"),
    )
    stages = Stages(spark, "interleave")
    rows = stages.write(rows, "rows")  # a sort by range looks at its input twice
    ties = ["mix", "doc_id", "text_crc32", "size"]
    own = global_positions(rows, [F.col(c) for c in ("stratum", *ties)], "own")
    sources = own.groupBy("stratum").agg(F.min("own").alias("first"), F.count("*").alias("n_source"))
    ranked = join(own, sources, ["stratum"], "inner", deal=True, rows_by=(["own"], ["stratum"]))
    rank = F.col("own") - F.col("first")
    fraction = (2 * rank + 1).cast("double") / (2 * F.col("n_source")).cast("double")
    ranked = stages.write(ranked.withColumn("fraction", fraction).drop("own", "first", "n_source"), "ranked")
    stages.drop(rows)
    placed = global_positions(ranked, [F.col(c) for c in ("fraction", "stratum", *ties)], "place")
    shard = F.expr(f"place * {n_shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select(
            "doc_id", "size", "text_crc32", "source", F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

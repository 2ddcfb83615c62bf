"""Helpers of the operators: stages in the shared folder, private column names, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch_path

#: Bytes of text that a Python worker handles at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


class Stages:
    """Tables written to the shared folder between the steps of one operator.

    ``write`` cuts lineage at files that every executor can read, so a lost executor costs the tasks it
    ran and nothing before the last stage. ``drop`` removes the stages that the result doesn't read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)
        self.names = 0

    def path(self, name: str) -> str:
        self.names += 1
        return f"{self.root}/{self.names:03d}-{name}"

    def write(self, df: DataFrame, name: str = "stage") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._stage_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder, if it isn't there, through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def column(name: str):
    """A column by its exact name."""
    return F.col(f"`{name}`")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most ``most`` bytes (``SLICE_BYTES``) of the text column, or one row.

    At the end Arrow returns the memory it no longer uses, which a worker kept for later tasks would hold on to.
    """
    most = most or SLICE_BYTES
    for batch in batches:
        lengths = batch.column(text)
        size = lengths.nbytes
        if size <= most or batch.num_rows == 1:
            yield batch
            continue
        at, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        for k, n in enumerate(sizes):
            if k > at and held + n > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += int(n)
        yield batch.slice(at)
    batch = lengths = None
    pa.default_memory_pool().release_unused()

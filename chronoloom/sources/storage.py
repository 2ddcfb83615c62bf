"""Shared storage: the checkpoint folder, typed tables and text files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder; a cluster is refused, since
    its executors do not share a local disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="chronoloom-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage reliably; survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Write a table to a new path of the shared folder and read it back: lineage ends at the files, and
    every later reader prunes columns."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write a typed, gzip-compressed table, optionally partitioned so later scans prune."""
    writer = df.write.mode(mode).option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_csv_files(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType,
    same_layout: bool = True,
    pattern: str | None = None,
) -> DataFrame:
    """Read many headed CSV files as one table with lower-case names.

    ``same_layout``: one scan over all paths, each file's header checked against the schema. Otherwise
    each path (a file or a folder of like files) is read by its own header, and the tables are bound by
    name: columns may come in any order, and one that a path lacks is null. ``pattern`` keeps only files
    whose name matches the glob.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if same_layout:
        df = reader.schema(schema).option("enforceSchema", False).csv(paths)
        return lower_names(df)
    wanted = {f.name.lower(): f.dataType for f in schema.fields}
    bound: DataFrame | None = None
    for path in paths:
        part = lower_names(reader.csv(path))
        part = part.select(*[c for c in part.columns if c in wanted])
        bound = part if bound is None else bound.unionByName(part, allowMissingColumns=True)
    present = bound.columns
    typed = [
        (F.col(f"`{n}`").try_cast(t) if n in present else F.lit(None).cast(t)).alias(n) for n, t in wanted.items()
    ]
    return bound.select(*typed)


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])

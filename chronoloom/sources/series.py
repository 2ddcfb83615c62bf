"""Temporal tables stored by key and index, with their description: read again, series need no shuffle.

``write_series`` puts the rows of a series into one bucket, sorted by key and index, and a bucket into one
file. Windows, gaps and summaries by key of the table read again start at the files: no exchange. Rows are
still sorted in their task, which costs little where they are in order.

A series at a finer grain than a day has no bound, so it may be larger than a task can follow. Keys above
``hot_rows`` are therefore left out of the buckets and kept beside them, sorted by range; series never lie
in both parts. ``StoredSeries.each`` applies verbs that follow every series by itself to both parts, each
with its own placement, and binds the results.

The folder holds ``series`` (buckets), ``hot`` (only where there are such keys) and ``description``, which is
written last: a folder without one is what a lost job left, and is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Meta, Nested, TemporalFrame
from ..functions.calendar import Interval
from ..operators import layout as L
from .storage import staged

KEPT = ("index", "key", "dense", "shared_span", "max_rows", "lattice")


@dataclass(frozen=True)
class StoredSeries:
    """What ``read_series`` returns: ``cold`` is read from buckets; ``hot`` holds the keys left out of them."""

    cold: TemporalFrame
    hot: TemporalFrame | None = None

    @property
    def frame(self) -> TemporalFrame:
        """All rows as one table. Where there are hot keys it is a union, whose buckets Spark doesn't use."""
        if self.hot is None:
            return self.cold
        return self.hot.with_(self.cold.df.unionByName(self.hot.df))

    def each(self, verbs: Callable[[TemporalFrame], TemporalFrame]) -> TemporalFrame:
        """``verbs`` applied to both parts and bound: right for verbs that look at one series at a time (windows
        and row numbers without groups, gaps within a series, filters, new columns, summaries by key)."""
        done = verbs(self.cold)
        if self.hot is None:
            return done
        other = verbs(self.hot)
        if other.columns != done.columns:
            raise ValueError("both parts must get the same columns")
        return other.with_(done.df.unionByName(other.df))


def write_series(tf: TemporalFrame, path: str, buckets: int | None = None) -> None:
    """Write a keyed table to a new folder, in buckets of its key (jobs run).

    ``buckets`` is ``spark.sql.shuffle.partitions`` unless stated; a bucket becomes a task, so take about one
    per 100 MB. Null keys are a key like others. Groups of the table aren't kept. An empty table is
    written as such. Files are Parquet, compressed by gzip.
    """
    meta, spark = tf.meta, tf.df.sparkSession
    if not meta.key:
        raise ValueError("a table without a key is one series: write it with write_table")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n < 1:
        raise ValueError("a table needs at least one bucket")
    df, limit, hot = tf.df, meta.layout.hot_rows, None
    if L.mode_of(tf) == "mixed":
        df = staged(df) if meta.costly else df
        limit, hot = _hot_keys(df, meta)
    all_rows = df
    if hot is not None:
        same = [df[k].eqNullSafe(hot[f"__h{i}"]) for i, k in enumerate(meta.key)]
        df = df.join(F.broadcast(hot), same, "left_anti")
    # Partitions of this shuffle are the buckets, so a task writes one file. A folder in use is refused here.
    writer = df.repartition(n, *meta.key).write.format("parquet").option("compression", "gzip").option("path", f"{path}/series")
    name = _table_name(path, "write")
    writer.bucketBy(n, *meta.key).sortBy(*meta.key, meta.index).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # only its entry: the files belong to the folder
    if hot is not None:
        rows = all_rows.join(F.broadcast(hot), same, "left_semi")
        rows = rows.repartitionByRange(n, *meta.key, meta.index).sortWithinPartitions(*meta.key, meta.index)
        rows.write.option("compression", "gzip").parquet(f"{path}/hot")
    about = {k: getattr(meta, k) for k in KEPT}
    about |= {
        "ties": list(tf.ties),
        "nesting": [asdict(x) for x in meta.nesting],
        "interval": meta.interval and asdict(meta.interval),
        "layout": asdict(replace(meta.layout, hot_rows=limit)),
        "buckets": n,
        "hot": hot is not None,
        "bounded": L.mode_of(tf) == "mixed",
        "schema": tf.df.schema.jsonValue(),
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/description")


def read_series(spark: SparkSession, path: str) -> StoredSeries:
    """The table that ``write_series`` wrote, as it was declared. Only the description is read at once.

    The buckets become known to Spark through an entry in the session's catalog, named by folder and description.
    """
    text = spark.read.text(f"{path}/description").first().value
    about = json.loads(text)
    schema = T.StructType.fromJson(about["schema"])
    key, index = tuple(about["key"]), about["index"]
    meta = Meta(
        **{k: about[k] for k in KEPT if k != "key"},
        key=key,
        nesting=tuple(Nested(**x) for x in about["nesting"]),
        ties=tuple(about.get("ties", ())),
        interval=about["interval"] and Interval(**about["interval"]),
        layout=L.Layout(**about["layout"]),
    )
    name = _table_name(path, text)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(map(_quoted, key))
    where = f"{path}/series".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) "
        f"SORTED BY ({by}, {_quoted(index)}) INTO {about['buckets']} BUCKETS LOCATION '{where}'"
    )
    # No series in the buckets is above the limit, which is all the placement has to know.
    cold = replace(meta, max_rows=meta.layout.hot_rows) if about["bounded"] else meta
    hot = TemporalFrame(spark.read.schema(schema).parquet(f"{path}/hot"), meta) if about["hot"] else None
    return StoredSeries(TemporalFrame(spark.table(name), cold), hot)


def _hot_keys(df: DataFrame, meta: Meta) -> tuple[int, DataFrame | None]:
    """The limit of rows for a bucket's series, and the keys above it: fewer than ``L.HOT_KEYS``, or None."""
    counts = staged(df.groupBy(*meta.key).agg(F.count(F.lit(1)).alias("__n")))
    n = counts.agg(F.sum("__n")).first()[0] or 0
    limit = max(meta.layout.hot_rows, n // L.HOT_KEYS)
    hot = counts.where(F.col("__n") > limit).select(*[F.col(_quoted(k)).alias(f"__h{i}") for i, k in enumerate(meta.key)])
    return limit, None if hot.isEmpty() else hot


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _table_name(path: str, text: str) -> str:
    return "chronoloom_" + hashlib.md5(f"{path}\n{text}".encode()).hexdigest()

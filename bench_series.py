"""Long series made with ``spark.range``: whole against blocks. ``python bench_series.py [rows] [cpus]``.

Half-second steps; in the keyed table one of 5,001 series holds a third of all rows. Prints seconds per
operation, second run of two, every result row computed.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import chronoloom as cl

fam = cl.FAMILY


def tables(spark: SparkSession, rows: int):
    at = F.timestamp_micros(F.col("id") * 500_000).cast("timestamp_ntz").alias("t")
    value = (F.xxhash64("id") % 1000).cast("double").alias("x")
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(1 + F.col("id") % 5000).alias("k")
    base = spark.range(rows)
    return base.select(at, value), base.select(at, key, value)


def operations(rows: int):
    """(name, keyed, placement options, call); without blocks a series is followed in one task."""
    slide, stretch = fam["slide_dbl"]("x", "mean", size=20), fam["stretch_dbl"]("x", "mean")
    wide = fam["slide_dbl"]("x", "sum", size=1000)
    hot = cl.Layout(hot_rows=1 << 20)
    whole = {"max_rows": rows, "layout": cl.Layout(hot_rows=rows)}
    yield "slide mean of 20, keyed, whole", True, whole, slide
    yield "slide mean of 20, keyed, blocks", True, {"layout": hot}, slide
    yield "stretch mean, keyed, whole", True, whole, stretch
    yield "stretch mean, keyed, blocks", True, {"layout": hot}, stretch
    yield "slide mean of 20, one series, blocks", False, {}, slide
    yield "stretch mean, one series, blocks", False, {}, stretch
    yield "slide sum of 1000, one series, blocks", False, {}, wide


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 12_000_000
    cpus = sys.argv[2] if len(sys.argv) > 2 else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    one, keyed = tables(spark, rows)
    took = {}
    for name, by_key, options, call in operations(rows):
        df, key = (keyed, ["k"]) if by_key else (one, [])
        for _ in range(2):
            start = time.time()
            tf = cl.as_temporal(df, "t", key, interval=None, validate=False, **options)
            tf.mutate(out=call).df.write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 2)
    print(json.dumps({"rows": rows, "cpus": cpus, "seconds": took}))
    spark.stop()


if __name__ == "__main__":
    main()

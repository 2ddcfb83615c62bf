"""Series stored by key: what comes back, where hot keys go, and plans without a shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import chronoloom as cl

fam = cl.FAMILY
SCHEMA = "k string, at timestamp_ntz, x bigint, `odd name` array<int>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, n=400):
    """A third of all rows on one key and a third on the null key; the others have a few rows each."""
    start = dt.datetime(2024, 1, 1)
    key = lambda i: "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 7}"
    rows = [(key(i), start + dt.timedelta(seconds=i * 7), i, [i]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def frame(df, **more):
    return cl.as_temporal(df, "at", ["k"], interval=None, validate=False, **more)


def test_by_date_no_shuffle_and_same_description(spark, tmp_path):
    df = events(spark).select("k", F.expr("date_add(DATE'2024-01-01', CAST(x AS INT))").alias("day"), "x", F.lit("p").alias("p"))
    tf = cl.as_temporal(df, "day", [cl.nested("k", "p")], interval=cl.Interval(1, "day"), validate=False)
    path = str(tmp_path / "it's here")
    cl.write_series(tf, path, buckets=3)
    stored = cl.read_series(spark, path)
    assert stored.hot is None and stored.frame is stored.cold
    assert stored.frame.meta == tf.meta and stored.frame.df.dtypes == df.dtypes
    out = stored.frame.mutate(s=fam["slide"]("x", "sum", size=3)).mutate(n=fam["stretch"]("x", "length"))
    assert "Exchange" not in plan(out.df)
    by_key = stored.frame.df.groupBy("k", "p").agg(F.sum("x"))
    assert "Exchange" not in plan(by_key)
    want = tf.mutate(s=fam["slide"]("x", "sum", size=3)).mutate(n=fam["stretch"]("x", "length"))
    assert sorted(map(str, out.df.collect())) == sorted(map(str, want.df.collect()))
    files = [f for f in (tmp_path / "it's here" / "series").iterdir() if f.name.startswith("part-")]
    assert len(files) <= 3


@pytest.mark.parametrize("limit, expected", [(100, {"hot", None}), (1000, set())])
def test_hot_keys_are_kept_beside_the_buckets(spark, tmp_path, limit, expected):
    tf = frame(events(spark), layout=cl.Layout(hot_rows=limit, block=16))
    path = str(tmp_path / "t")
    cl.write_series(tf, path, buckets=4)
    stored = cl.read_series(spark, path)
    held = {r.k for r in stored.hot.df.select("k").distinct().collect()} if stored.hot else set()
    assert held == expected
    assert not held & {r.k for r in stored.cold.df.select("k").distinct().collect()}
    assert "Exchange" not in plan(stored.cold.mutate(s=fam["slide"]("x", "sum", size=5)).df)
    verbs = lambda t: t.mutate(s=fam["slide"]("x", "sum", size=5)).mutate(h=fam["stretch"]("x", "max"))
    got, want = stored.each(verbs).df, verbs(tf).df
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, stored.frame.df.collect())) == sorted(map(str, tf.df.collect()))


def test_empty_tables_and_refusals(spark, tmp_path):
    empty = frame(events(spark).limit(0))
    cl.write_series(empty, str(tmp_path / "empty"), buckets=2)
    stored = cl.read_series(spark, str(tmp_path / "empty"))
    assert stored.frame.df.count() == 0 and stored.frame.columns == empty.columns
    with pytest.raises(ValueError, match="one series"):
        cl.write_series(cl.as_temporal(events(spark), "at", interval=None, validate=False), str(tmp_path / "no"))
    with pytest.raises(Exception, match="(?i)exist|empty"):
        cl.write_series(frame(events(spark)), str(tmp_path / "empty"), buckets=2)
    with pytest.raises(ValueError, match="same columns"):
        path = str(tmp_path / "two")
        cl.write_series(frame(events(spark), layout=cl.Layout(hot_rows=10, block=16)), path, buckets=2)
        parts = cl.read_series(spark, path)
        parts.each(lambda t: t.mutate(y=F.lit(1)) if t is parts.cold else t)


def test_a_folder_without_a_description_is_refused(spark, tmp_path):
    frame(events(spark)).df.write.parquet(str(tmp_path / "lost" / "series"))
    with pytest.raises(Exception, match="(?i)path"):
        cl.read_series(spark, str(tmp_path / "lost"))

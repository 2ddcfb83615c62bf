"""What the physical plans must look like to hold at scale."""

import re

from pyspark.sql import functions as F

import chronoloom as cl
from chronoloom.plans import star
from chronoloom.plans.analysis import annual

SF = "/root/testdata/sf0.001"
fam = cl.FAMILY


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def daily_table(spark, tmp_path):
    path = str(tmp_path / "daily")
    star.daily(spark, SF).write.parquet(path)
    return cl.as_temporal(spark.read.parquet(path), "date", star.KEY, interval=star.DAY, validate=False)


def test_keyed_windows_share_one_shuffle(spark, tmp_path):
    tf = daily_table(spark, tmp_path)
    p = plan(tf.mutate(a=fam["slide"]("volume", "sum", size=7)).mutate(b=fam["stretch"]("volume", "sum")).df)
    assert p.count("Exchange ") == 1 and p.count("Sort ") == 1


def test_fill_shuffles_only_observed_rows(spark, tmp_path):
    tf = daily_table(spark, tmp_path).fill_na(max_ratio=None, volume=0)
    p = plan(tf.df)
    assert p.count("Exchange ") == 1 and "Join" not in p
    assert p.index("Generate") < p.index("Window") < p.index("Exchange ")  # printed from the top down


def test_summary_is_partially_aggregated_and_pruned(spark):
    p = plan(annual(star.filled(spark, SF, volume=0)).df)
    assert "partial_sum" in p and "partial_count" in p
    scans = re.findall(r"ReadSchema: (struct<.*?>)(?:\n|$)", p)
    assert "struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in scans


def test_long_series_has_no_unpartitioned_data_window(spark, tmp_path):
    tf = daily_table(spark, tmp_path)
    fine = tf.df.groupBy(F.col("date").cast("timestamp_ntz").alias("at")).agg(F.sum("volume").alias("v"))
    one = cl.as_temporal(fine, "at", interval=None, validate=False)
    for out in (
        one.mutate(m=fam["slide"]("v", "mean", size=7)).df,
        one.mutate(m=fam["stretch"]("v", "mean")).df,
        one.tiles(s=fam["tile"]("v", "sum", size=60)).df,
    ):
        p = plan(out)
        # Single-partition steps scan block summaries, which an aggregate produced, or add up the count and
        # span of the table, one row per task.
        for m in re.finditer(r"Exchange SinglePartition", p):
            below = p[m.end() : m.end() + 400]
            assert "HashAggregate(keys=[__c" in below or "Aggregate(keys=[], functions=[partial_" in below
        assert "hashpartitioning(__c" in p or "hashpartitioning(__copy" in p


def test_a_table_by_date_without_a_key_is_read_once(spark, tmp_path):
    """It has no more rows than there are days, so there are no blocks, no second pass and no subquery."""
    tf = daily_table(spark, tmp_path)
    days = tf.df.groupBy("date").agg(F.sum("volume").alias("v"))
    one = cl.as_temporal(days, "date", interval=star.DAY, validate=False)
    p = plan(one.mutate(m=fam["slide"]("v", "mean", size=7)).df)
    assert "ubquery" not in p and "__c" not in p
    assert len(re.findall(r"Scan parquet", p)) == len(re.findall(r"Scan parquet", plan(days)))


def test_hot_keys_are_found_without_collecting_rows(spark):
    p = plan(star.event_series(spark, SF).mutate(m=fam["slide"]("value", "mean", size=4)).df)
    assert "partial_count" in p and "BroadcastExchange" in p and "CartesianProduct" not in p


def test_top_k_and_slices_do_not_sort_everything(spark):
    volumes = star.daily(spark, SF).groupBy("service").agg(F.sum("volume").alias("n"))
    assert "TakeOrderedAndProject" in plan(cl.top_k(volumes, "n", 11, ["service"]))
    tf = star.enquiries(spark, SF)
    assert "TakeOrderedAndProject" in plan(tf.preview())
    assert "TakeOrderedAndProject" in plan(tf.slice(3, 9).df)
    assert "WindowGroupLimit" in plan(tf.group_by("category").slice(1, 11).df)


def test_filters_reach_the_scan(spark):
    customers = star.table(spark, SF, "customer").where(F.col("c_mktsegment") == "BUILDING")
    assert "EqualTo(c_mktsegment,BUILDING)" in plan(customers.select("c_custkey"))


def test_spread_is_one_shuffle(spark, tmp_path):
    tf = daily_table(spark, tmp_path).select("volume")
    wide = tf.with_(tf.df.drop("value")).spread("channel", "volume", ["BUILDING", "MACHINERY"])
    assert plan(wide.df).count("Exchange ") == 1


def test_share_does_not_window_a_panel(spark):
    p = plan(annual(star.enquiries(spark, SF)).share("annual_volume", ["category"]).df)
    assert "Window [" not in p

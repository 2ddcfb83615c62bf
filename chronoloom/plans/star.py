"""The star schema as a temporal table: orders per day, nation within region, crossed by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TemporalFrame, nested
from ..functions.calendar import Interval
from ..operators.declare import as_temporal

KEY = [nested("service", "category"), "channel"]
DAY = Interval(1, "day")


# Declared, so that no job reads file footers to find them out.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its day, its customer's segment and nation key; only those columns read."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("date"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "inner")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation key with its name and its region's name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "inner")
    return both.select("n_nationkey", F.col("n_name").alias("service"), F.col("r_name").alias("category"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, channel, category, service, volume (orders) and value (their price in cents).

    Aggregated by the integer nation key first; names are joined to the much smaller result.
    """
    counted = (
        orders_by_customer(spark, sf_dir)
        .groupBy("date", F.col("c_mktsegment").alias("channel"), "c_nationkey")
        .agg(F.count(F.lit(1)).alias("volume"), F.sum("cents").alias("value"))
    )
    where = places(spark, sf_dir)
    named = counted.join(where, counted["c_nationkey"] == where["n_nationkey"], "inner")
    return named.select("date", "channel", "category", "service", "volume", "value")


def enquiries(spark: SparkSession, sf_dir: str) -> TemporalFrame:
    """The declared table. Key and index are the grouping columns, so they are unique by construction."""
    return as_temporal(daily(spark, sf_dir), "date", KEY, interval=DAY, validate=False)


def filled(spark: SparkSession, sf_dir: str, **values: object) -> TemporalFrame:
    """Every day of every series; the calendar spans a few thousand days, so no size check is needed."""
    return enquiries(spark, sf_dir).fill_na(max_ratio=None, **values)


def total(spark: SparkSession, sf_dir: str) -> TemporalFrame:
    """The single series of daily totals, written once because windows read it more than once."""
    full = filled(spark, sf_dir, volume=0, value=0)
    return full.summarise(ttl_volume=F.sum("volume"), ttl_value=F.sum("value")).materialize()


def event_series(spark: SparkSession, sf_dir: str) -> TemporalFrame:
    """The irregular table: events of a type of a user, at arbitrary instants."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "event_id", "value")
    return as_temporal(events, "ts", ["user_id", "event_type"], interval=None, validate=False)

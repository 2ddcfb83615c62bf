"""Registration of queries with their SQL, and the SQL that both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(run(spark, sf_dir))

    QUERIES[name] = shown
    if sql is not None:
        ORACLES[name] = sql


def query(sql: str | None, name: str | None = None):
    def wrap(run):
        register(name or run.__name__, run, sql)
        return run

    return wrap


def present(df: DataFrame) -> DataFrame:
    """Dates as ISO text and doubles to six places, so that both engines print the same values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.when(F.abs(c) == float("inf"), c).otherwise(F.round(c, 6))
        out.append(c.alias(f.name))
    return df.select(*out)


# -- SQL building blocks --------------------------------------------------------------------------

ORDERS = """orders_by_customer AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS date,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, c_nationkey, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

DAILY = f"""{ORDERS},
daily AS (
  SELECT date, c_mktsegment AS channel, r_name AS category, n_name AS service,
         CAST(count(*) AS BIGINT) AS volume, CAST(sum(cents) AS BIGINT) AS value
  FROM orders_by_customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4)"""

FILLED = f"""{DAILY},
spine AS (
  SELECT channel, category, service, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT channel, category, service, min(date) AS lo, max(date) AS hi FROM daily GROUP BY 1, 2, 3)),
filled AS (
  SELECT s.date, s.channel, s.category, s.service, d.volume, d.value
  FROM spine s LEFT JOIN daily d
    ON s.date = d.date AND s.channel = d.channel AND s.category = d.category AND s.service = d.service)"""

FILLED0 = f"""{FILLED},
filled0 AS (SELECT date, channel, category, service, coalesce(volume, 0) AS volume, coalesce(value, 0) AS value
            FROM filled)"""

TOTAL = f"""{FILLED0},
total AS (SELECT date, CAST(sum(volume) AS BIGINT) AS ttl_volume, CAST(sum(value) AS BIGINT) AS ttl_value
          FROM filled0 GROUP BY date)"""

MONTHLY = f"""{FILLED0},
monthly AS (SELECT channel, category, CAST(date_trunc('month', date) AS DATE) AS yearmth,
                   CAST(sum(volume) AS BIGINT) AS monthly_volume
            FROM filled0 GROUP BY 1, 2, 3)"""


def day(column: str, name: str | None = None) -> str:
    """A date printed as text."""
    return f"CAST({column} AS VARCHAR) AS {name or column}"


SERIES = "PARTITION BY channel, category, service ORDER BY date"
EVENT = "PARTITION BY user_id, event_type ORDER BY ts"

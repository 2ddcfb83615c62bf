"""Declaration, checks, gaps, summaries, joins and the two composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

import chronoloom as cl
from chronoloom.plans import star
from chronoloom.plans.analysis import annual, channel_share, monthly
from chronoloom.plans.etl import TidyRules, load, tidy

from .base import DAILY, FILLED, FILLED0, MONTHLY, ORDERS, TOTAL, day, query
from .tables import raw_records

ANNUAL = f"""{FILLED0},
annual AS (SELECT channel, category, CAST(year(date) AS INT) AS year, CAST(sum(volume) AS BIGINT) AS annual_volume
           FROM filled0 GROUP BY 1, 2, 3)"""

# -- declaration and checks -----------------------------------------------------------------------


def _described(source: str, cols: int, interval: str, keys: str, groups: str, by: str, key: str) -> str:
    n_groups = f"(SELECT count(*) FROM (SELECT DISTINCT {by} FROM {source}))" if by else "0"
    return f"""CAST((SELECT count(*) FROM {source}) AS BIGINT) AS n_rows, {cols} AS n_cols, '{interval}' AS interval,
    '{key}' AS key, CAST((SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source})) AS BIGINT) AS n_keys,
    '{groups}' AS groups, CAST({n_groups} AS BIGINT) AS n_groups"""


@query(
    f"WITH {DAILY} SELECT "
    + _described("daily", 6, "1DAY", "service, category, channel", "", "", "service | category, channel")
)
def declare_describe(spark, sf_dir):
    return cl.as_temporal(star.daily(spark, sf_dir), "date", star.KEY).describe()


@query(
    f"WITH {DAILY}, y AS (SELECT *, year(date) AS year FROM daily) SELECT "
    + _described(
        "y", 7, "1DAY", "service, category, channel", "channel, category @ year", "channel, category, year",
        "service | category, channel",
    )
)
def describe_grouped(spark, sf_dir):
    return star.enquiries(spark, sf_dir).group_by("channel", "category").index_by(year=cl.year("date")).describe()


@query(
    f"WITH {ANNUAL} SELECT " + _described("annual", 4, "1YEAR", "category, channel", "channel", "channel", "category, channel")
)
def describe_annual(spark, sf_dir):
    return annual(star.filled(spark, sf_dir, volume=0, value=0)).describe()


@query(
    f"""WITH {ORDERS}
    SELECT c_mktsegment AS channel, n_name AS service, r_name AS category, {day('date')}, CAST(count(*) AS BIGINT) AS n
    FROM orders_by_customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2, 3, date HAVING count(*) > 1"""
)
def duplicates(spark, sf_dir):
    orders = star.orders_by_customer(spark, sf_dir).withColumnRenamed("c_mktsegment", "channel")
    where = star.places(spark, sf_dir)
    raw = orders.join(where, orders["c_nationkey"] == where["n_nationkey"], "inner")
    return cl.duplicates(cl.as_temporal(raw, "date", star.KEY, interval=star.DAY, validate=False))


@query(
    """SELECT 'c_mktsegment' AS level, c_mktsegment AS child, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS n_parents
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 HAVING count(DISTINCT c_nationkey) > 1"""
)
def nesting_check(spark, sf_dir):
    key = [cl.nested("c_mktsegment", "c_nationkey"), cl.nested("o_custkey", "c_mktsegment")]
    tf = cl.as_temporal(star.orders_by_customer(spark, sf_dir), "date", key, interval=star.DAY, validate=False)
    return cl.broken_nesting(tf)


@query(
    f"""WITH {ORDERS}, pairs AS (
      SELECT DISTINCT 'o_orderkey' AS level, o_orderkey::VARCHAR AS child, o_custkey::VARCHAR AS parent FROM orders_by_customer
      UNION SELECT 'o_custkey', o_custkey::VARCHAR, c_mktsegment FROM orders_by_customer
      UNION SELECT 'c_mktsegment', c_mktsegment, o_orderpriority FROM orders_by_customer)
    SELECT level, child, count(*) AS n_parents FROM pairs GROUP BY level, child HAVING count(*) > 1"""
)
def nesting_deep(spark, sf_dir):
    """Four levels in one declaration; the outermost isn't one."""
    key = [cl.nested("o_orderkey", "o_custkey", "c_mktsegment", "o_orderpriority")]
    return cl.broken_nesting(cl.as_temporal(star.orders_by_customer(spark, sf_dir), "date", key, interval=None, validate=False))


@query(
    f"""WITH {ORDERS}
    SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_cols, '!' AS "interval", 'o_orderkey | o_custkey | c_nationkey, c_mktsegment' AS key,
      count(DISTINCT (o_orderkey, o_custkey, c_nationkey, c_mktsegment)) AS n_keys, '' AS groups, CAST(0 AS BIGINT) AS n_groups
    FROM orders_by_customer"""
)
def describe_deep(spark, sf_dir):
    """Three nested levels crossed with another column."""
    orders = star.orders_by_customer(spark, sf_dir).select("date", "o_orderkey", "o_custkey", "c_nationkey", "c_mktsegment", "cents")
    key = [cl.nested("o_orderkey", "o_custkey", "c_nationkey"), "c_mktsegment"]
    return cl.as_temporal(orders, "date", key, interval=None, validate=False).describe()


@query(
    f"""WITH RECURSIVE {DAILY},
    steps AS (SELECT DISTINCT date - lag(date) OVER (PARTITION BY service, category, channel ORDER BY daily.date) AS d FROM daily),
    ranked AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM steps WHERE d > 0),
    folded AS (SELECT i, CAST(d AS BIGINT) AS g FROM ranked WHERE i = 1
               UNION ALL SELECT r.i, gcd(f.g, CAST(r.d AS BIGINT)) FROM folded f JOIN ranked r ON r.i = f.i + 1)
    SELECT min(g) AS n, 'day' AS unit FROM folded"""
)
def interval(spark, sf_dir):
    return cl.interval_of(cl.as_temporal(star.daily(spark, sf_dir), "date", star.KEY, interval=None, validate=False))


@query(
    f"""WITH RECURSIVE {MONTHLY},
    steps AS (SELECT DISTINCT date_diff('month', lag(yearmth) OVER (PARTITION BY channel, category ORDER BY yearmth), yearmth) AS d
              FROM monthly),
    ranked AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM steps WHERE d > 0),
    folded AS (SELECT i, d AS g FROM ranked WHERE i = 1
               UNION ALL SELECT r.i, gcd(f.g, r.d) FROM folded f JOIN ranked r ON r.i = f.i + 1)
    SELECT CAST(min(g) AS BIGINT) AS n, 'month' AS unit FROM folded"""
)
def interval_monthly(spark, sf_dir):
    return cl.interval_of(monthly(star.filled(spark, sf_dir, volume=0, value=0)))


@query(
    """WITH RECURSIVE u AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS d
                  FROM events),
    ranked AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM u WHERE d > 0)),
    folded AS (SELECT i, d AS g FROM ranked WHERE i = 1
               UNION ALL SELECT r.i, gcd(f.g, r.d) FROM folded f JOIN ranked r ON r.i = f.i + 1)
    SELECT min(g) AS n, 'microsecond' AS unit FROM folded"""
)
def interval_irregular(spark, sf_dir):
    return cl.interval_of(star.event_series(spark, sf_dir))


# -- gaps -----------------------------------------------------------------------------------------


@query(f"WITH {FILLED} SELECT {day('date')}, channel, category, service, volume, value FROM filled")
def fill_null(spark, sf_dir):
    return star.filled(spark, sf_dir).df


@query(f"WITH {FILLED0} SELECT {day('date')}, channel, category, service, volume, value FROM filled0")
def fill_zero(spark, sf_dir):
    return star.filled(spark, sf_dir, volume=0, value=0).df


@query(
    f"""WITH {DAILY},
    days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
             FROM (SELECT min(date) AS lo, max(date) AS hi FROM daily)),
    keys AS (SELECT DISTINCT channel, category, service FROM daily)
    SELECT CAST(t.date AS VARCHAR) AS date, k.channel, k.category, k.service, coalesce(d.volume, 0) AS volume, d.value
    FROM keys k CROSS JOIN days t LEFT JOIN daily d
      ON t.date = d.date AND k.channel = d.channel AND k.category = d.category AND k.service = d.service"""
)
def fill_full(spark, sf_dir):
    return star.enquiries(spark, sf_dir).fill_na(full=True, max_ratio=None, volume=0).df


@query(
    f"""WITH {FILLED}
    SELECT (SELECT count(*) FROM daily) AS n_rows, (SELECT count(*) FROM filled) AS n_filled,
           round((SELECT count(*) FROM filled) / (SELECT count(*) FROM daily), 6) AS ratio"""
)
def fill_size(spark, sf_dir):
    return cl.fill_size(star.enquiries(spark, sf_dir))


@query(
    f"""WITH {DAILY},
    seen AS (SELECT DISTINCT channel, category, date FROM daily),
    steps AS (SELECT *, lead(date) OVER (PARTITION BY channel, category ORDER BY seen.date) AS next FROM seen)
    SELECT channel, category, CAST(date + 1 AS VARCHAR) AS "from", CAST(next - 1 AS VARCHAR) AS "to",
           CAST(next - date - 1 AS BIGINT) AS n
    FROM steps WHERE next - date > 1"""
)
def gap_report(spark, sf_dir):
    return star.enquiries(spark, sf_dir).group_by("channel", "category").count_gaps()


@query(
    f"""WITH {DAILY},
    ends AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
    seen AS (SELECT DISTINCT channel, category, date FROM daily),
    steps AS (SELECT channel, category, date + 1 AS f, lead(date) OVER (PARTITION BY channel, category ORDER BY seen.date) - 1 AS t
              FROM seen
              UNION ALL SELECT channel, category, lo, min(date) - 1 FROM seen, ends GROUP BY 1, 2, 3
              UNION ALL SELECT channel, category, max(date) + 1, hi FROM seen, ends GROUP BY 1, 2, hi)
    SELECT channel, category, CAST(f AS VARCHAR) AS "from", CAST(t AS VARCHAR) AS "to", CAST(t - f + 1 AS BIGINT) AS n
    FROM steps WHERE t >= f"""
)
def gap_report_full(spark, sf_dir):
    return star.enquiries(spark, sf_dir).group_by("channel", "category").count_gaps(full=True)


@query(
    f"""WITH {DAILY},
    steps AS (SELECT *, lead(date) OVER (PARTITION BY channel, category, service ORDER BY daily.date) AS next FROM daily)
    SELECT channel, category, service, CAST(date + 1 AS VARCHAR) AS "from", CAST(next - 1 AS VARCHAR) AS "to",
           CAST(next - date - 1 AS BIGINT) AS n
    FROM steps WHERE next - date > 1"""
)
def gap_report_series(spark, sf_dir):
    return star.enquiries(spark, sf_dir).count_gaps()


@query(
    """WITH hourly AS (SELECT DISTINCT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events),
    steps AS (SELECT *, lead(hour) OVER (PARTITION BY event_type ORDER BY hour) AS next FROM hourly)
    SELECT event_type, strftime(hour + INTERVAL 1 HOUR, '%Y-%m-%d %H') AS "from",
           strftime(next - INTERVAL 1 HOUR, '%Y-%m-%d %H') AS "to", CAST(date_diff('hour', hour, next) - 1 AS BIGINT) AS n
    FROM steps WHERE date_diff('hour', hour, next) > 1"""
)
def gap_report_hourly(spark, sf_dir):
    events = star.table(spark, sf_dir, "events")
    # Whole hours as wall-clock time: date_trunc would hand back a time in the session's zone.
    hour = (F.date_format("ts", "yyyy-MM-dd HH:00:00")).cast("timestamp_ntz")
    hourly = events.select("event_type", hour.alias("hour")).distinct()
    tf = cl.as_temporal(hourly, "hour", ["event_type"], interval=cl.Interval(1, "hour"), validate=False)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH").alias(c)
    return tf.count_gaps().select("event_type", text("from"), text("to"), "n")


@query(
    """WITH hourly AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1, 2),
    spine AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour
              FROM (SELECT event_type, min(hour) AS lo, max(hour) AS hi FROM hourly GROUP BY 1))
    SELECT s.event_type, strftime(s.hour, '%Y-%m-%d %H') AS hour, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM spine s LEFT JOIN hourly h ON s.event_type = h.event_type AND s.hour = h.hour"""
)
def fill_hourly(spark, sf_dir):
    events = star.table(spark, sf_dir, "events")
    hour = (F.date_format("ts", "yyyy-MM-dd HH:00:00")).cast("timestamp_ntz")
    hourly = events.groupBy("event_type", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    tf = cl.as_temporal(hourly, "hour", ["event_type"], interval=cl.Interval(1, "hour"), validate=False)
    return tf.fill_na(max_ratio=None, n=0).df.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


# -- index groups and summaries -------------------------------------------------------------------


@query(f"WITH {FILLED0} SELECT {day('date')}, channel, category, service, volume, CAST(year(date) AS INT) AS year FROM filled0")
def index_by_year(spark, sf_dir):
    tf = star.filled(spark, sf_dir, volume=0, value=0).select("volume")
    return tf.group_by("channel", "category").index_by(year=cl.year("date")).df


@query(
    f"""WITH {FILLED0}
    SELECT {day('date')}, channel, category, service, volume, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS yearmth
    FROM filled0"""
)
def index_by_month(spark, sf_dir):
    tf = star.filled(spark, sf_dir, volume=0, value=0).select("volume")
    return tf.group_by("channel", "category").index_by(yearmth=cl.yearmonth("date")).df


@query(
    f"""WITH {FILLED0}
    SELECT category, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS week, CAST(sum(volume) AS BIGINT) AS volume
    FROM filled0 GROUP BY 1, 2"""
)
def weekly(spark, sf_dir):
    tf = star.filled(spark, sf_dir, volume=0, value=0).group_by("category")
    return tf.index_by(week=cl.yearweek("date")).summarise(volume=F.sum("volume")).df


@query(
    f"""WITH {FILLED0}
    SELECT category, CAST(CAST(date_trunc('quarter', date) AS DATE) AS VARCHAR) AS quarter, CAST(sum(volume) AS BIGINT) AS volume
    FROM filled0 GROUP BY 1, 2"""
)
def quarterly(spark, sf_dir):
    tf = star.filled(spark, sf_dir, volume=0, value=0).group_by("category")
    return tf.index_by(quarter=cl.yearquarter("date")).summarise(volume=F.sum("volume")).df


@query(f"WITH {ANNUAL} SELECT channel, category, year, annual_volume FROM annual", name="annual")
def annual_(spark, sf_dir):
    return annual(star.filled(spark, sf_dir, volume=0, value=0)).df


@query(f"WITH {MONTHLY} SELECT channel, category, {day('yearmth')}, monthly_volume FROM monthly", name="monthly")
def monthly_(spark, sf_dir):
    return monthly(star.filled(spark, sf_dir, volume=0, value=0)).df


@query(f"WITH {TOTAL} SELECT {day('date')}, ttl_volume FROM total")
def total_by_day(spark, sf_dir):
    return star.filled(spark, sf_dir, volume=0, value=0).summarise(ttl_volume=F.sum("volume")).df


@query(
    f"""WITH {FILLED}
    SELECT {day('date')}, category, CASE WHEN count(volume) = count(*) THEN CAST(sum(volume) AS BIGINT) END AS strict,
           CAST(sum(volume) AS BIGINT) AS known, round(avg(volume), 6) AS mean,
           CASE WHEN count(value) = count(*) THEN max(value) END AS highest
    FROM filled GROUP BY date, category"""
)
def null_totals(spark, sf_dir):
    tf = star.filled(spark, sf_dir).group_by("category")
    return tf.summarise(
        strict=cl.total("volume"),
        known=cl.total("volume", na_rm=True),
        mean=cl.mean("volume", na_rm=True),
        highest=cl.highest("value"),
    ).df


@query(
    f"""WITH {DAILY}
    SELECT channel, CAST(sum(volume) AS BIGINT) AS volume, round(avg(value), 6) AS mean_value, min(value) AS low, max(value) AS high,
           count(*) AS n, min(date)::VARCHAR AS first_day
    FROM daily GROUP BY channel"""
)
def group_flat(spark, sf_dir):
    return star.daily(spark, sf_dir).groupBy("channel").agg(
        cl.total("volume").alias("volume"),
        cl.mean("value").alias("mean_value"),
        cl.lowest("value").alias("low"),
        cl.highest("value").alias("high"),
        cl.n_rows().alias("n"),
        F.min("date").alias("first_day"),
    )


@query(f"WITH {DAILY} SELECT {day('date')}, channel, CAST(sum(value) AS BIGINT) AS value FROM daily GROUP BY date, channel")
def summarize_alias(spark, sf_dir):
    return star.enquiries(spark, sf_dir).group_by("channel").summarize(value=cl.total("value")).df


@query(
    f"""WITH {DAILY} SELECT {day('date')}, CAST(sum(volume) AS BIGINT) AS volume FROM daily GROUP BY date"""
)
def ungroup(spark, sf_dir):
    tf = star.enquiries(spark, sf_dir).group_by("channel").index_by(year=cl.year("date")).ungroup()
    return tf.summarise(volume=F.sum("volume")).df


@query(f"WITH {DAILY} SELECT DISTINCT category, service FROM daily")
def distinct_pairs(spark, sf_dir):
    return star.daily(spark, sf_dir).select("category", "service").distinct()


@query(
    f"""WITH {DAILY}
    SELECT count(DISTINCT category) AS n_categories, count(DISTINCT service) AS n_services, count(DISTINCT date) AS n_days FROM daily"""
)
def distinct_counts(spark, sf_dir):
    return star.daily(spark, sf_dir).agg(
        cl.n_distinct("category").alias("n_categories"),
        cl.n_distinct("service").alias("n_services"),
        cl.n_distinct("date").alias("n_days"),
    )


@query(
    f"""WITH {ANNUAL}
    SELECT channel, category, year, annual_volume,
           round(annual_volume / sum(annual_volume) OVER (PARTITION BY category, year), 6) AS share FROM annual""",
    name="channel_share",
)
def channel_share_(spark, sf_dir):
    return channel_share(star.filled(spark, sf_dir, volume=0, value=0)).df


# -- joins ----------------------------------------------------------------------------------------

SIDES = f"""{ORDERS},
a AS (SELECT date, CAST(count(*) AS BIGINT) AS n_orders FROM orders_by_customer GROUP BY date),
b AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem GROUP BY 1)"""


def _sides(spark, sf_dir):
    """Orders per day, and lines shipped per day: each has days the other lacks."""
    left = star.orders_by_customer(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n_orders"))
    lines = star.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    return (
        cl.as_temporal(left, "date", interval=star.DAY, validate=False),
        lines.agg(F.count(F.lit(1)).alias("n_lines")),
    )


for _how in ("inner", "left", "right", "full"):

    @query(
        f"""WITH {SIDES} SELECT CAST(coalesce(a.date, b.date) AS VARCHAR) AS date, n_orders, n_lines
        FROM a {_how} JOIN b ON a.date = b.date""",
        name=f"joins_{_how}",
    )
    def _join(spark, sf_dir, how=_how):
        left, right = _sides(spark, sf_dir)
        return getattr(left, f"{how}_join")(right, ["date"]).df


for _how, _not in (("semi", ""), ("anti", "NOT")):

    @query(
        f"""WITH {SIDES} SELECT CAST(date AS VARCHAR) AS date, n_orders FROM a
        WHERE date {_not} IN (SELECT date FROM b)""",
        name=f"joins_{_how}",
    )
    def _keep(spark, sf_dir, how=_how):
        left, right = _sides(spark, sf_dir)
        return getattr(left, f"{how}_join")(right, ["date"]).df


_EVENTS = "e AS (SELECT CASE WHEN event_type <> 'view' THEN user_id END AS user_id, event_id, value FROM events)"


@query(
    f"""WITH {_EVENTS},
    c AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS user_id, CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY 1)
    SELECT coalesce(e.user_id, c.user_id) AS user_id, event_id, value, customers
    FROM e FULL JOIN c ON e.user_id IS NOT DISTINCT FROM c.user_id"""
)
def joins_full_hot(spark, sf_dir):
    """Events without a user are a hot null key, and the other table has a row for them; both have keys of their own."""
    user = F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id")
    events = star.table(spark, sf_dir, "events").select(user, "event_id", "value")
    known = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("user_id")
    customers = star.table(spark, sf_dir, "customer").groupBy(known).agg(F.count(F.lit(1)).alias("customers"))
    return cl.join(events, customers, ["user_id"], "full", part_rows=500, rows_by=(["event_id"], None))


@query(
    f"""WITH {_EVENTS},
    c AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS user_id, c_custkey FROM customer)
    SELECT coalesce(e.user_id, c.user_id) AS user_id, event_id, value, c_custkey FROM e FULL JOIN c ON e.user_id = c.user_id"""
)
def joins_full_never(spark, sf_dir):
    """Null keys of both sides match nothing: they are dealt and not repeated."""
    user = F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id")
    events = star.table(spark, sf_dir, "events").select(user, "event_id", "value")
    known = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("user_id")
    customers = star.table(spark, sf_dir, "customer").select(known, "c_custkey")
    return cl.join(events, customers, ["user_id"], "full", "never", part_rows=100, rows_by=(["event_id"], ["c_custkey"]))


NULLED = f"""{DAILY},
a AS (SELECT date, nullif(channel, 'BUILDING') AS channel, CAST(sum(volume) AS BIGINT) AS volume FROM daily GROUP BY 1, 2),
b AS (SELECT nullif(c_mktsegment, 'BUILDING') AS channel, CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY 1)"""


def _nulled(spark, sf_dir):
    unknown = lambda c: F.when(F.col(c) != "BUILDING", F.col(c))
    left = star.daily(spark, sf_dir).groupBy("date", unknown("channel").alias("channel")).agg(F.sum("volume").alias("volume"))
    right = star.table(spark, sf_dir, "customer").groupBy(unknown("c_mktsegment").alias("channel"))
    return cl.as_temporal(left, "date", ["channel"], interval=star.DAY), right.agg(F.count(F.lit(1)).alias("customers"))


@query(
    f"""WITH {NULLED} SELECT CAST(date AS VARCHAR) AS date, a.channel, volume, customers
    FROM a JOIN b ON a.channel IS NOT DISTINCT FROM b.channel"""
)
def joins_null_matches(spark, sf_dir):
    left, right = _nulled(spark, sf_dir)
    return left.inner_join(right, ["channel"]).df


@query(
    f"""WITH {NULLED} SELECT CAST(date AS VARCHAR) AS date, coalesce(a.channel, b.channel) AS channel, volume, customers
    FROM a FULL JOIN b ON a.channel = b.channel"""
)
def joins_null_never(spark, sf_dir):
    left, right = _nulled(spark, sf_dir)
    return left.full_join(right, ["channel"], na_matches="never", validate=False).df


@query(
    f"""WITH {DAILY} SELECT CAST(date AS VARCHAR) AS date, channel, category, service, volume, CAST(n AS BIGINT) AS suppliers
    FROM daily LEFT JOIN (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
      ON service = n_name"""
)
def joins_keyed(spark, sf_dir):
    nation = star.table(spark, sf_dir, "nation")
    counts = star.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    named = counts.join(nation, counts["s_nationkey"] == nation["n_nationkey"], "inner")
    right = named.select(F.col("n_name").alias("service"), "suppliers")
    return star.enquiries(spark, sf_dir).select("volume").left_join(right, ["service"]).df


# -- composite jobs -------------------------------------------------------------------------------

RULES = TidyRules(
    work_site="BUILDING",
    channel_names={"4-NOT": "Web", "5-LOW": "Phone"},
    category_names={"AFRICA": "Built Structure Control"},
    services_to_other=("CHINA",),
    top_categories=3,
    categories_to_other=("EUROPE",),
    online_channels=("Web", "3-MEDIUM"),
    channels_to_other=("1-URGENT",),
)

ETL = f"""{ORDERS},
raw AS (SELECT date, n_name AS service, r_name AS category, regexp_replace(o_orderpriority, '( | -).*$', '') AS channel
        FROM orders_by_customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE c_mktsegment = 'BUILDING'),
named AS (SELECT date, service, category,
                 CASE channel WHEN '4-NOT' THEN 'Web' WHEN '5-LOW' THEN 'Phone' ELSE channel END AS channel, count(*) AS volume
          FROM raw GROUP BY ALL),
moved AS (SELECT date, channel, volume, CASE WHEN service = 'CHINA' THEN 'Other' ELSE service END AS service,
                 CASE WHEN service = 'CHINA' THEN 'Other' WHEN category = 'AFRICA' THEN 'Built Structure Control'
                      ELSE category END AS category FROM named),
top AS (SELECT category FROM moved GROUP BY category ORDER BY sum(volume) DESC, moved.category LIMIT 3),
keep AS (SELECT DISTINCT service FROM moved WHERE category IN (SELECT category FROM top)),
lumped AS (SELECT date, channel, category, volume,
                  CASE WHEN service IN (SELECT service FROM keep) THEN service ELSE 'Other' END AS service
           FROM moved WHERE service <> category),
tidied AS (SELECT date, CASE WHEN channel IN ('Web', '3-MEDIUM') THEN 'Online' WHEN channel = '1-URGENT' THEN 'Other'
                             ELSE channel END AS channel,
                  CASE WHEN service = 'Other' THEN 'Other' WHEN category = 'EUROPE' THEN 'Other' ELSE category END AS category,
                  service, CAST(sum(volume) AS BIGINT) AS volume
           FROM lumped GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {ETL} SELECT {day('date')}, channel, category, service, volume FROM tidied")
def etl_clean(spark, sf_dir):
    return tidy(raw_records(spark, sf_dir), RULES)


@query(f"WITH {ETL} SELECT {day('date')}, channel, category, service, volume FROM tidied WHERE channel <> 'Other'")
def etl_load(spark, sf_dir):
    path = cl.scratch_path(spark, "tidied")
    cl.write_table(tidy(raw_records(spark, sf_dir), RULES), path)
    return load(cl.read_table(spark, path), RULES)


@query(
    f"""WITH {ETL},
    spine AS (SELECT channel, category, service, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
              FROM (SELECT channel, category, service, min(date) AS lo, max(date) AS hi FROM tidied
                    WHERE channel <> 'Other' GROUP BY 1, 2, 3)),
    whole AS (SELECT s.date, coalesce(t.volume, 0) AS volume FROM spine s LEFT JOIN tidied t
                ON s.date = t.date AND s.channel = t.channel AND s.category = t.category AND s.service = t.service),
    day_total AS (SELECT date, CAST(sum(volume) AS BIGINT) AS ttl_volume FROM whole GROUP BY date)
    SELECT {day('date')}, ttl_volume,
           CASE WHEN row_number() OVER (ORDER BY day_total.date) >= 7
                THEN round(avg(ttl_volume) OVER (ORDER BY day_total.date ROWS 6 PRECEDING), 6) END AS ma
    FROM day_total"""
)
def raw_to_moving_average(spark, sf_dir):
    from chronoloom.plans.analysis import smoothed

    tidied = load(tidy(raw_records(spark, sf_dir), RULES), RULES)
    tf = cl.as_temporal(tidied, "date", [cl.nested("service", "category"), "channel"], interval=star.DAY, validate=False)
    total = tf.fill_na(max_ratio=None, volume=0).summarise(ttl_volume=F.sum("volume")).materialize()
    return smoothed(total).df

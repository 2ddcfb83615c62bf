"""Sources, projections, filters, sorts, unions, reshapes and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

import chronoloom as cl
from chronoloom.operators.relational import global_positions, sort_columns
from chronoloom.plans import star
from chronoloom.plans.analysis import annual
from chronoloom.plans.etl import RAW_SCHEMA, clean

from .base import DAILY, FILLED0, ORDERS, SERIES, TOTAL, day, query

# -- sources and sinks ------------------------------------------------------------------------------


def raw_records(spark, sf_dir):
    """Every order as a raw call record: text date, labels with a suffix, a site and a count."""
    orders = star.orders_by_customer(spark, sf_dir)
    where = star.places(spark, sf_dir)
    joined = orders.join(where, orders["c_nationkey"] == where["n_nationkey"], "inner")
    return joined.select(
        F.date_format("date", "d/M/yyyy").alias("Date"),
        F.col("service").alias("Service"),
        F.col("category").alias("Category"),
        F.col("o_orderpriority").alias("Channel"),
        F.col("c_mktsegment").alias("Work Site"),
        F.lit(1).alias("Volume"),
    )


@query(
    f"""WITH {ORDERS}
    SELECT {day('date')}, o_orderpriority AS channel, c_mktsegment AS work_site, CAST(count(*) AS BIGINT) AS volume
    FROM orders_by_customer GROUP BY date, o_orderpriority, c_mktsegment"""
)
def csv_scan(spark, sf_dir):
    path = cl.scratch_path(spark, "raw-csv")
    raw_records(spark, sf_dir).write.option("header", True).csv(path)
    read = cl.read_csv_files(spark, path, RAW_SCHEMA, pattern="*csv*")
    return clean(read).groupBy("date", "channel", "work_site").agg(F.sum("volume").alias("volume"))


@query(
    f"""WITH {ORDERS}
    SELECT r_name AS category, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE n_name END AS service,
           CAST(count(*) AS BIGINT) AS volume
    FROM orders_by_customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2"""
)
def csv_bind_by_name(spark, sf_dir):
    orders = star.orders_by_customer(spark, sf_dir)
    where = star.places(spark, sf_dir)
    joined = orders.join(where, orders["c_nationkey"] == where["n_nationkey"], "inner").withColumn("VOLUME", F.lit(1))
    done = F.col("o_orderstatus") == "F"
    first, second = cl.scratch_path(spark, "csv-a"), cl.scratch_path(spark, "csv-b")
    # Two exports of one table: other column order, other capitals, and one lacks a column.
    joined.where(done).select(F.col("category").alias("Category"), "VOLUME").write.option("header", True).csv(first)
    joined.where(~done).select("VOLUME", "service", "category").write.option("header", True).csv(second)
    schema = T.StructType(
        [T.StructField("Category", T.StringType()), T.StructField("Service", T.StringType()), T.StructField("Volume", T.IntegerType())]
    )
    bound = cl.read_csv_files(spark, [first, second], schema, same_layout=False)
    bound = bound.withColumn("service", F.coalesce("service", F.lit("none")))
    return bound.groupBy("category", "service").agg(F.sum("volume").alias("volume"))


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume, CAST(year(date) AS INT) AS year FROM daily"""
)
def table_round_trip(spark, sf_dir):
    path = cl.scratch_path(spark, "tidy")
    tidy = star.daily(spark, sf_dir).drop("value").withColumn("year", F.year("date"))
    cl.write_table(tidy, path, partition_by=["year"])
    return cl.read_table(spark, path)


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume, value FROM daily
    ORDER BY daily.service, daily.category, daily.channel, daily.date LIMIT 6"""
)
def preview(spark, sf_dir):
    return star.enquiries(spark, sf_dir).preview(6)


# -- projections ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def lower_names(spark, sf_dir):
    shouted = star.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("O_ORDERKEY"), F.col("o_custkey").alias("O_CustKey"), F.col("o_orderstatus").alias("O_ORDERSTATUS")
    )
    return cl.lower_names(shouted)


@query(f"WITH {DAILY} SELECT {day('date', 'day')}, channel, category AS region, service AS nation, volume AS n, value FROM daily")
def rename(spark, sf_dir):
    tf = star.enquiries(spark, sf_dir).rename(day="date", nation="service", region="category", n="volume")
    return tf.arrange().df


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume * 2 AS volume, value, volume * 2 + 1 AS more,
           volume * 4 + 1 AS most FROM daily"""
)
def mutate_sequential(spark, sf_dir):
    v = F.col("volume")
    return star.enquiries(spark, sf_dir).mutate(volume=v * 2, more=v + 1, most=v + F.col("more")).df


@query(f"WITH {DAILY} SELECT {day('date')}, channel, category, service, round(value / 100.0 / volume, 6) AS price FROM daily")
def transmute(spark, sf_dir):
    return star.enquiries(spark, sf_dir).transmute(price=F.col("value") / F.lit(100.0) / F.col("volume")).df


@query(f"WITH {DAILY} SELECT {day('date')}, channel, category, service, volume FROM daily")
def select(spark, sf_dir):
    return star.enquiries(spark, sf_dir).select("volume").df


@query(f"WITH {DAILY} SELECT DISTINCT category FROM daily")
def pull(spark, sf_dir):
    return star.enquiries(spark, sf_dir).pull("category").distinct()


@query(f"WITH {TOTAL} SELECT {day('date')}, ttl_volume, '-Infinity'::DOUBLE AS ymin, 'Infinity'::DOUBLE AS ymax FROM total")
def constant_columns(spark, sf_dir):
    tf = star.total(spark, sf_dir).select("ttl_volume")
    return tf.mutate(ymin=cl.constant(float("-inf")), ymax=cl.constant(float("inf"))).df


# -- filters --------------------------------------------------------------------------------------


@query(f"WITH {DAILY} SELECT {day('date')}, channel, category, service, volume, value FROM daily WHERE channel = 'BUILDING'")
def filter_equal(spark, sf_dir):
    return star.enquiries(spark, sf_dir).filter(F.col("channel") == "BUILDING").df


@query(f"WITH {DAILY} SELECT {day('date')}, channel, category, service, volume, value FROM daily WHERE channel <> 'BUILDING'")
def filter_not_equal(spark, sf_dir):
    return star.enquiries(spark, sf_dir).filter(F.col("channel") != "BUILDING").df


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> l_linestatus")
def filter_columns(spark, sf_dir):
    lines = star.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return lines.where(F.col("l_returnflag") != F.col("l_linestatus"))


@query(
    f"""WITH {DAILY},
    top AS (SELECT service FROM daily GROUP BY service ORDER BY sum(volume) DESC, daily.service LIMIT 11)
    SELECT {day('date')}, channel, category, service, volume, value FROM daily WHERE service IN (SELECT service FROM top)"""
)
def filter_derived_set(spark, sf_dir):
    tf = star.enquiries(spark, sf_dir)
    volumes = tf.df.groupBy("service").agg(F.sum("volume").alias("n"))
    kept = cl.top_k(volumes, "n", 11, ["service"])
    return tf.semi_join(kept, ["service"]).df


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' THEN 'fast'
                               ELSE 'slow' END AS lane FROM orders"""
)
def membership_with_null(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    # A null is in no set: the unknown priorities of open orders must come out as slow, not as null.
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    lane = cl.if_else(cl.is_in(known, ["1-URGENT", "2-HIGH"]), "fast", "slow")
    return orders.select("o_orderkey", lane.alias("lane"))


@query(
    f"""WITH {FILLED0} SELECT {day('date')}, channel, category, service, volume, value FROM filled0
    WHERE date >= DATE '1998-01-01' AND volume > 0"""
)
def filter_temporal(spark, sf_dir):
    tf = star.filled(spark, sf_dir, volume=0, value=0)
    return tf.filter(F.col("date") >= F.lit("1998-01-01").cast("date"), F.col("volume") > 0).df


# -- sorts, slices, top-k -------------------------------------------------------------------------


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume,
           row_number() OVER (ORDER BY service, category, channel, daily.date) - 1 AS position FROM daily"""
)
def arrange_many(spark, sf_dir):
    df = star.daily(spark, sf_dir).drop("value")
    return global_positions(df, sort_columns(["service", "category", "channel", "date"]), "position")


@query(
    f"""WITH {DAILY}, pairs AS (SELECT DISTINCT category, service FROM daily)
    SELECT category, service, row_number() OVER (ORDER BY (category = 'ASIA')::INT, category, service) - 1 AS position
    FROM pairs"""
)
def arrange_by_level(spark, sf_dir):
    pairs = star.daily(spark, sf_dir).select("category", "service").distinct()
    order = cl.LevelOrder().relevel("ASIA", after=float("inf"))
    return global_positions(pairs, [*order.sort_columns("category"), *sort_columns(["service"])], "position")


@query(
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position
    FROM orders"""
)
def arrange_descending(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return global_positions(orders, [cl.desc("o_totalprice"), F.col("o_orderkey").asc()], "position")


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume, value FROM daily
    QUALIFY row_number() OVER (ORDER BY service, category, channel, daily.date) BETWEEN 5 AND 15"""
)
def slice_rows(spark, sf_dir):
    return star.enquiries(spark, sf_dir).slice(5, 15).df


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume, value FROM daily
    QUALIFY row_number() OVER ({SERIES}) BETWEEN 2 AND 4"""
)
def slice_series(spark, sf_dir):
    return star.enquiries(spark, sf_dir).group_by("service", "category", "channel").slice(2, 4).df


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume, value FROM daily
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY service, channel, daily.date) BETWEEN 1 AND 11"""
)
def slice_groups(spark, sf_dir):
    return star.enquiries(spark, sf_dir).group_by("category").slice(1, 11).df


@query(
    f"""WITH {DAILY} SELECT service, CAST(sum(volume) AS BIGINT) AS volume FROM daily
    GROUP BY service ORDER BY sum(daily.volume) DESC, service LIMIT 11"""
)
def top_k(spark, sf_dir):
    volumes = star.daily(spark, sf_dir).groupBy("service").agg(F.sum("volume").alias("volume"))
    return cl.top_k(volumes, "volume", 11, ["service"])


# -- set operations -------------------------------------------------------------------------------


@query(
    f"""WITH {ORDERS}
    SELECT {day('date')}, CAST(count(*) AS BIGINT) AS n_orders, CAST(NULL AS BIGINT) AS n_lines, 'orders' AS source
    FROM orders_by_customer GROUP BY date
    UNION ALL
    SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR), NULL, CAST(count(*) AS BIGINT), 'lines'
    FROM lineitem GROUP BY CAST(l_shipdate AS DATE)"""
)
def bind_rows(spark, sf_dir):
    orders = star.orders_by_customer(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n_orders"))
    lines = star.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    return cl.bind_rows(
        orders.withColumn("source", F.lit("orders")),
        lines.agg(F.count(F.lit(1)).alias("n_lines")).withColumn("source", F.lit("lines")),
    )


# -- reshapes -------------------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, 'volume' AS measure, volume AS amount FROM daily
    UNION ALL SELECT CAST(date AS VARCHAR), channel, category, service, 'value', value FROM daily"""
)
def gather(spark, sf_dir):
    return star.enquiries(spark, sf_dir).gather(["volume", "value"], "measure", "amount").df


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, category, service,
           {', '.join(f"max(CASE WHEN channel = '{s}' THEN volume END) AS {s}" for s in SEGMENTS)}
    FROM daily GROUP BY date, category, service"""
)
def spread(spark, sf_dir):
    tf = star.enquiries(spark, sf_dir).select("volume")
    return tf.with_(tf.df.select("date", "channel", "category", "service", "volume")).spread("channel", "volume", SEGMENTS).df


@query(
    f"""WITH {FILLED0}
    SELECT category, service, CAST(year(date) AS INT) AS year,
           {', '.join(f"CAST(coalesce(sum(CASE WHEN channel = '{s}' THEN volume END), 0) AS BIGINT) AS {s}" for s in SEGMENTS)}
    FROM filled0 GROUP BY 1, 2, 3"""
)
def spread_fill(spark, sf_dir):
    per_year = annual(star.filled(spark, sf_dir, volume=0, value=0), ("service", "category", "channel"))
    return per_year.spread("channel", "annual_volume", SEGMENTS, fill=0).df


@query(
    """WITH levels AS (SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 64 AS page FROM (SELECT DISTINCT o_custkey FROM orders)),
    cells AS (SELECT o_orderpriority AS priority, page, o_custkey, max(o_orderkey) AS last FROM orders JOIN levels USING (o_custkey) GROUP BY 1, 2, 3)
    SELECT priority, CAST(page AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS n_cells,
           string_agg(o_custkey::VARCHAR || '=' || last::VARCHAR, ' ' ORDER BY o_custkey::VARCHAR) AS cells FROM cells GROUP BY 1, 2"""
)
def spread_pages(spark, sf_dir):
    """A column for every customer would be too many: pages of 64 of them."""
    orders = star.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    wide = cl.spread_pages(orders, ["priority"], "o_custkey", "o_orderkey", page_levels=64)
    shown = F.transform(F.map_entries("cells"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return wide.select("priority", "page", F.size("cells").alias("n_cells"), F.array_join(shown, " ").alias("cells"))


@query(
    f"""WITH {DAILY}
    SELECT channel, category, service, CAST(date_trunc('month', date) AS DATE)::VARCHAR AS yrmth,
           string_agg(date::VARCHAR || '=' || volume::VARCHAR, ' ' ORDER BY daily.date) AS data, count(*)::INT AS n
    FROM daily GROUP BY 1, 2, 3, 4"""
)
def nest_months(spark, sf_dir):
    tf = star.enquiries(spark, sf_dir).select("volume").mutate(yrmth=F.trunc("date", "month"))
    nested = tf.nest(["service", "category", "channel", "yrmth"])
    shown = F.transform("data", lambda r: F.concat(r["date"].cast("string"), F.lit("="), r["volume"].cast("string")))
    return nested.select("channel", "category", "service", "yrmth", F.array_join(shown, " ").alias("data"), F.size("data").alias("n"))


@query(
    f"""WITH {DAILY},
    numbered AS (SELECT *, (row_number() OVER ({SERIES}) - 1) // 50 AS part FROM daily)
    SELECT channel, category, service, part, string_agg(date::VARCHAR, ' ' ORDER BY numbered.date) AS days
    FROM numbered GROUP BY 1, 2, 3, 4"""
)
def nest_parts(spark, sf_dir):
    nested = star.enquiries(spark, sf_dir).nest(["service", "category", "channel"], part_rows=50)
    days = F.array_join(F.transform("data", lambda r: r["date"].cast("string")), " ")
    return nested.select("channel", "category", "service", "part", days.alias("days"))


@query(f"WITH {DAILY} SELECT {day('date')}, channel, category, service, volume, value FROM daily")
def nest_unnest(spark, sf_dir):
    nested = star.enquiries(spark, sf_dir).nest(["service", "category", "channel"], part_rows=1000)
    return cl.unnest(nested).select("date", "channel", "category", "service", "volume", "value")


@query(f"WITH {DAILY} SELECT {day('date')}, channel, category, service, volume, value FROM daily")
def nest_groups(spark, sf_dir):
    nested = star.enquiries(spark, sf_dir).nest(["category"], part_rows=500)
    return cl.unnest(nested).select("date", "channel", "category", "service", "volume", "value")


TREE = """'{"name":"World","children":[' || string_agg(
             '{"name":"' || category || '","children":[' || leaves || ']}', ',' ORDER BY (category = 'ASIA')::INT, category)
           || ']}'"""


@query(
    f"""WITH {DAILY}, pairs AS (SELECT DISTINCT category, service FROM daily),
    nodes AS (SELECT category, string_agg('{{"name":"' || service || '"}}', ',' ORDER BY service) AS leaves
              FROM pairs GROUP BY category)
    SELECT {TREE} AS document FROM nodes"""
)
def hierarchy_json(spark, sf_dir):
    order = cl.LevelOrder(last=("ASIA",))
    return cl.hierarchy(star.daily(spark, sf_dir), "category", "service", "World", order)


@query(
    f"""WITH {DAILY}, paths AS (SELECT DISTINCT category, service, channel FROM daily),
    low AS (SELECT category, service, string_agg('{{"name":"' || channel || '"}}', ',' ORDER BY channel) AS leaves FROM paths GROUP BY 1, 2),
    nodes AS (SELECT category, string_agg('{{"name":"' || service || '","children":[' || leaves || ']}}', ',' ORDER BY service) AS leaves
              FROM low GROUP BY category)
    SELECT {TREE} AS document FROM nodes"""
)
def hierarchy_deep(spark, sf_dir):
    order = cl.LevelOrder(last=("ASIA",))
    return cl.hierarchy_of(star.daily(spark, sf_dir), ["category", "service", "channel"], "World", order)


@query(
    """WITH t AS (SELECT r_name, n_name, c_mktsegment, c_custkey::VARCHAR AS c
                  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    nodes AS (
      SELECT 1 AS depth, r_name AS path, count(DISTINCT n_name) AS n_children, count(DISTINCT c) AS n_leaves FROM t GROUP BY r_name
      UNION ALL SELECT 2, r_name || '/' || n_name, count(DISTINCT c_mktsegment), count(DISTINCT c) FROM t GROUP BY r_name, n_name
      UNION ALL SELECT 3, r_name || '/' || n_name || '/' || c_mktsegment, count(DISTINCT c), count(DISTINCT c) FROM t GROUP BY r_name, n_name, c_mktsegment
      UNION ALL SELECT 4, r_name || '/' || n_name || '/' || c_mktsegment || '/' || c, 0, 1 FROM t)
    SELECT depth, path, n_children, n_leaves FROM nodes"""
)
def hierarchy_branches(spark, sf_dir):
    """Four levels, the last with a node for every customer."""
    customers = star.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    where = star.places(spark, sf_dir)
    rows = customers.join(where, customers["c_nationkey"] == where["n_nationkey"], "inner")
    found = cl.branches(rows, ["category", "service", "c_mktsegment", "c_custkey"])
    return found.select("depth", F.array_join("path", "/").alias("path"), "n_children", "n_leaves")


# -- scalar functions -----------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
           CAST(year(o_orderdate) AS INT) AS year, strftime(o_orderdate, '%Y %b') AS month
    FROM orders"""
)
def parse_dates(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    # Text in two layouts, and text that is no date at all.
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "d/M/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd-MM-yyyy"))
        .otherwise(F.lit("31/02/not a year"))
    )
    day_ = F.col("o_orderdate").cast("date")
    return orders.select(
        "o_orderkey", cl.parse_dmy(text).alias("date"), F.year(day_).alias("year"), cl.yearmonth_label(day_).alias("month")
    )


@query(
    r"""SELECT o_orderkey, regexp_replace(o_orderpriority, '( | -).*$', '') AS channel,
               regexp_replace(o_orderpriority, '[0-9]-', 'P ') AS label FROM orders"""
)
def replace_pattern(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        cl.cut_at_blank("o_orderpriority").alias("channel"),
        cl.regex_replace("o_orderpriority", "[0-9]-", "P ").alias("label"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size
    FROM orders"""
)
def conditional_null(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders")
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return orders.select("o_orderkey", cl.if_else(known > 200000, "large", "small").alias("size"))


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Phone' WHEN '5-LOW' THEN 'Web' ELSE o_orderpriority END
              AS channel, 'order/' || o_orderkey::VARCHAR || '/' || o_orderstatus AS path FROM orders"""
)
def recode_and_paste(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        cl.recode("o_orderpriority", {"1-URGENT": "Phone", "5-LOW": "Web"}).alias("channel"),
        cl.paste("order/", F.col("o_orderkey"), "/", F.col("o_orderstatus")).alias("path"),
    )


# -- levels ---------------------------------------------------------------------------------------


@query(
    f"""WITH {DAILY},
    top AS (SELECT service FROM daily GROUP BY service ORDER BY sum(volume) DESC, daily.service LIMIT 11)
    SELECT {day('date')}, channel, CASE WHEN service IN (SELECT service FROM top) THEN service ELSE 'Other' END AS service,
           CAST(sum(volume) AS BIGINT) AS volume FROM daily GROUP BY 1, 2, 3"""
)
def topk_lump(spark, sf_dir):
    df = star.daily(spark, sf_dir)
    volumes = df.groupBy("service").agg(F.sum("volume").alias("n"))
    keep = cl.top_k(volumes, "n", 11, ["service"]).select("service")
    return cl.lump_keep(df, "service", keep).groupBy("date", "channel", "service").agg(F.sum("volume").alias("volume"))


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, CASE WHEN channel IN ('FURNITURE', 'MACHINERY') THEN 'Other' ELSE channel END AS channel,
           CAST(sum(volume) AS BIGINT) AS volume FROM daily GROUP BY 1, 2"""
)
def lump_drop(spark, sf_dir):
    df = cl.lump_drop(star.daily(spark, sf_dir), "channel", ["FURNITURE", "MACHINERY"])
    return df.groupBy("date", "channel").agg(F.sum("volume").alias("volume"))


@query(
    f"""WITH {DAILY},
    used AS (SELECT DISTINCT CASE WHEN channel IN ('FURNITURE', 'MACHINERY') THEN 'Another' ELSE channel END AS level FROM daily)
    SELECT level, row_number() OVER (ORDER BY (level = 'Another')::INT, level) AS ordinal FROM used"""
)
def relevel(spark, sf_dir):
    df = cl.lump_drop(star.daily(spark, sf_dir), "channel", ["FURNITURE", "MACHINERY"], other="Another")
    return cl.present_levels(df, "channel", cl.LevelOrder().relevel("Another", after=float("inf")))


@query(
    f"""WITH {DAILY}, used AS (SELECT DISTINCT channel AS level FROM daily WHERE channel <> 'BUILDING')
    SELECT level, row_number() OVER (ORDER BY level) AS ordinal FROM used"""
)
def drop_unused_levels(spark, sf_dir):
    return cl.present_levels(star.daily(spark, sf_dir).where(F.col("channel") != "BUILDING"), "channel")

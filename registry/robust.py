"""Moments on several levels, defaults without options, lambdas of several aggregates, open intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

import chronoloom as cl
from chronoloom.plans import star

from .base import DAILY, FILLED, SERIES, day, query
from .tables import SEGMENTS
from .windows import ALL, TYPE

fam = cl.FAMILY
LEVEL = 1_000_000.0


def _levelled(spark, sf_dir):
    """Daily volumes, those of one channel a million higher: deviations stay as they are."""
    high = F.when(F.col("channel") == SEGMENTS[0], LEVEL).otherwise(0.0)
    return star.enquiries(spark, sf_dir).mutate(x=F.col("volume") + high)


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service,
           CASE WHEN row_number() OVER k >= 64 THEN round(stddev_samp(volume) OVER a, 4) END AS sd64,
           CASE WHEN row_number() OVER k >= 90 THEN round(stddev_samp(volume) OVER b, 4) END AS sd90
    FROM daily WINDOW k AS ({SERIES}), a AS ({SERIES} ROWS 63 PRECEDING), b AS ({SERIES} ROWS 89 PRECEDING)"""
)
def slide_sd90(spark, sf_dir):
    slide = fam["slide_dbl"]
    out = _levelled(spark, sf_dir).transmute(sd64=slide("x", "sd", size=64), sd90=slide("x", "sd", size=90))
    return out.mutate(sd64=F.round("sd64", 4), sd90=F.round("sd90", 4)).df


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service,
           CASE WHEN row_number() OVER k >= 90 AND stddev_samp(volume) OVER f > 0 THEN round(corr(volume, value) OVER f, 4) END AS cor
    FROM daily WINDOW k AS ({SERIES}), f AS ({SERIES} ROWS 89 PRECEDING)"""
)
def slide2_cor90(spark, sf_dir):
    out = _levelled(spark, sf_dir).transmute(cor=fam["slide2_dbl"]("x", "value", "cor", size=90))
    return out.mutate(cor=F.round("cor", 4)).df


@query(
    f"""SELECT event_id, event_type, round(stddev_samp(value) OVER f, 4) AS sd,
      round(var_samp(value) OVER f, 2) AS v FROM events WINDOW f AS ({TYPE} ROWS UNBOUNDED PRECEDING)"""
)
def stretch_sd_levels(spark, sf_dir):
    """Large series in blocks, each type on a level of its own."""
    events = star.table(spark, sf_dir, "events").select("ts", "event_type", "event_id", "value")
    events = events.withColumn("x", F.col("value") + LEVEL * F.length("event_type"))
    layout = cl.Layout(hot_rows=1000, block=256)
    tf = cl.as_temporal(events, "ts", ["event_type"], interval=None, validate=False, layout=layout)
    out = tf.mutate(sd=fam["stretch_dbl"]("x", "sd"), v=fam["stretch_dbl"]("x", "var")).df
    return out.select("event_id", "event_type", F.round("sd", 4).alias("sd"), F.round("v", 2).alias("v"))


@query(
    f"""WITH {DAILY},
    q AS (SELECT channel, category, service, date_trunc('quarter', date)::DATE AS quarter, sum(volume) AS s, sum(volume * volume) AS q,
                 count(*) AS n FROM daily GROUP BY ALL),
    three AS (SELECT channel, category, service, quarter, row_number() OVER k AS i, sum(s) OVER f AS s, sum(q) OVER f AS q, sum(n) OVER f AS n
              FROM q WINDOW k AS (PARTITION BY channel, category, service ORDER BY quarter),
                            f AS (PARTITION BY channel, category, service ORDER BY quarter ROWS 2 PRECEDING))
    SELECT CAST(d.date AS VARCHAR) AS date, d.channel, d.category, d.service, CAST(quarter AS VARCHAR) AS quarter,
           CASE WHEN i >= 3 AND n > 1 THEN round(sqrt((q - s * s / n) / (n - 1)), 4) END AS sd
    FROM daily d JOIN three t ON d.channel = t.channel AND d.category = t.category AND d.service = t.service
      AND quarter = date_trunc('quarter', d.date)::DATE"""
)
def slide_period_sd(spark, sf_dir):
    tf = _levelled(spark, sf_dir).slide_period(cl.yearquarter("date"), "quarter", 3, sd=fam["slide_dbl"]("x", "sd"))
    return tf.df.select("date", "channel", "category", "service", "quarter", F.round("sd", 4).alias("sd"))


@query(f"WITH {FILLED} SELECT {day('date')}, channel, category, service, coalesce(volume, 0) AS volume, value FROM filled")
def fill_default(spark, sf_dir):
    return star.enquiries(spark, sf_dir).fill_na(volume=0).df


@query(
    f"""SELECT event_id, CASE WHEN row_number() OVER ({ALL}) >= 20 THEN round(avg(value) OVER ({ALL} ROWS 19 PRECEDING), 6) END AS m,
      count(*) OVER ({ALL} ROWS UNBOUNDED PRECEDING) AS n FROM events"""
)
def events_auto_interval(spark, sf_dir):
    """One irregular series, checked and its interval found; several events may share an instant."""
    events = star.table(spark, sf_dir, "events").select("ts", "event_id", "value")
    tf = cl.as_temporal(events, "ts", ties=["event_id"]).mutate(m=fam["slide_dbl"]("value", "mean", size=20))
    return tf.mutate(n=fam["stretch"]("value", "length")).df.select("event_id", "m", "n")


@query(
    f"""WITH RECURSIVE {DAILY},
    quarters AS (SELECT DISTINCT channel, date_trunc('quarter', date)::DATE AS q FROM daily),
    steps AS (SELECT DISTINCT date_diff('month', lag(q) OVER (PARTITION BY channel ORDER BY q), q) AS d FROM quarters),
    ranked AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM steps WHERE d > 0),
    folded AS (SELECT i, d AS g FROM ranked WHERE i = 1
               UNION ALL SELECT r.i, gcd(f.g, r.d) FROM folded f JOIN ranked r ON r.i = f.i + 1)
    SELECT min(g) || 'MONTH' AS interval, CAST((SELECT count(*) FROM quarters) AS BIGINT) AS n_rows FROM folded"""
)
def interval_quarterly(spark, sf_dir):
    """Quarterly data grouped by month are three months apart."""
    quarterly = star.enquiries(spark, sf_dir).group_by("channel").index_by(q=cl.yearquarter("date"))
    quarterly = quarterly.summarise(volume=F.sum("volume"))
    monthly = quarterly.group_by("channel").index_by(m=cl.yearmonth("q")).summarise(volume=F.sum("volume"))
    return monthly.describe().select("interval", "n_rows")


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service,
           CASE WHEN row_number() OVER k >= 7 THEN CAST(max(value) OVER f - min(value) OVER f AS BIGINT) END AS r,
           CASE WHEN row_number() OVER k >= 7 THEN min(volume) OVER f END AS lo,
           CASE WHEN row_number() OVER k >= 7 THEN max(volume) OVER f END AS hi
    FROM daily WINDOW k AS ({SERIES}), f AS ({SERIES} ROWS 6 PRECEDING)"""
)
def slide_range_lambda(spark, sf_dir):
    span = lambda c, over: over(F.max(c)) - over(F.min(c))
    ends = lambda c, over: F.struct(over(F.min(c)).alias("lo"), over(F.max(c)).alias("hi"))
    out = star.enquiries(spark, sf_dir).transmute(r=fam["slide"]("value", span, size=7), e=fam["slide"]("volume", ends, size=7))
    return out.df.select("date", "channel", "category", "service", "r", "e.lo", "e.hi")


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, CAST(max(value) OVER f - min(value) OVER f AS BIGINT) AS r
    FROM daily WINDOW f AS ({SERIES} ROWS UNBOUNDED PRECEDING)"""
)
def stretch_range_lambda(spark, sf_dir):
    span = lambda c, over: over(F.max(c)) - over(F.min(c))
    return star.enquiries(spark, sf_dir).transmute(r=fam["stretch"]("value", span)).df


@query(
    f"""WITH {DAILY}, t AS (SELECT *, (row_number() OVER ({SERIES}) - 1) // 30 + 1 AS tile FROM daily)
    SELECT channel, category, service, tile, CAST(min(date) AS VARCHAR) AS date, min(volume) AS lo, max(volume) AS hi
    FROM t GROUP BY channel, category, service, tile"""
)
def tile_row_lambda(spark, sf_dir):
    ends = lambda c, over: F.struct(over(F.min(c)).alias("lo"), over(F.max(c)).alias("hi"))
    tiles = star.enquiries(spark, sf_dir).tiles(e=fam["tile"]("volume", ends, size=30)).df
    return tiles.select("channel", "category", "service", "tile", "date", "e.lo", "e.hi")


def _volumes(spark, sf_dir):
    tf = star.enquiries(spark, sf_dir)
    return tf.with_(tf.df.drop("value"))


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, category, service, {', '.join(f"max(CASE WHEN channel = '{s}' THEN volume END) AS {s}" for s in SEGMENTS)}
    FROM daily GROUP BY daily.date, category, service"""
)
def spread_found_levels(spark, sf_dir):
    return _volumes(spark, sf_dir).spread("channel", "volume").df


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, category, service,
           {', '.join(f"max(CASE WHEN channel = '{s}' THEN volume END) AS {s}" for s in SEGMENTS[1:])},
           max(CASE WHEN channel = '{SEGMENTS[0]}' THEN volume END) AS "<NA>"
    FROM daily GROUP BY daily.date, category, service"""
)
def spread_null_level(spark, sf_dir):
    tf = _volumes(spark, sf_dir)
    known = F.when(F.col("channel") != SEGMENTS[0], F.col("channel"))
    return tf.with_(tf.df.withColumn("channel", known)).spread("channel", "volume").df

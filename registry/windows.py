"""Slide, tile and stretch: the whole family over the keyed table, the long total series and the
irregular events."""

from __future__ import annotations

from pyspark.sql import functions as F

import chronoloom as cl
from chronoloom.plans import star
from chronoloom.plans.analysis import smoothed, smoothed_by_month

from .base import DAILY, EVENT, FILLED, FILLED0, SERIES, TOTAL, day, query, register

# -- the family: 3 kinds x 3 arities x 5 result types ------------------------------------------------

SIZE, INIT = 7, 3
MONTHS = f"""{FILLED0},
months AS (SELECT channel, category, CAST(date_trunc('month', date) AS DATE) AS date, CAST(sum(volume) AS BIGINT) AS volume,
                  CAST(sum(value) AS BIGINT) AS value FROM filled0 GROUP BY 1, 2, 3)"""


def _keyed(spark, sf_dir):
    """Observed days of every series, with a third numeric column and a flag."""
    return star.enquiries(spark, sf_dir).mutate(dom=F.dayofmonth("date"), busy=F.col("volume") > 1)


def _months(spark, sf_dir):
    """25 monthly series: lists of a stretch grow with every row, so they are shown on these."""
    tf = star.filled(spark, sf_dir, volume=0, value=0).group_by("channel", "category")
    tf = tf.index_by(month=cl.yearmonth("date")).summarise(volume=F.sum("volume"), value=F.sum("value"))
    return tf.rename(date="month").mutate(dom=F.month("date"), busy=F.col("volume") > 20)


def _text(r) -> object:
    return F.concat_ws(":", *[r[n].cast("string") for n in ("volume", "value")])


def _join(a, sep=" "):
    return F.array_join(F.transform(a, _text), sep)


def _dear(cols, _o):
    return cols[1] > cols[0] * 15_000_000


COUNT_DEAR = cl.Accumulator(
    {"n": cl.Part(lambda cols, o: _dear(cols, o).cast("bigint"), "sum")}, lambda p: p["n"].cast("int"), strict=False
)
ALL_DEAR = cl.Accumulator({"t": cl.Part(_dear, "min")}, lambda p: p["t"], strict=False)
WEIGHTED = cl.Accumulator(
    {"s": cl.Part(lambda cols, o: (cols[0] * cols[2]).cast("bigint"), "sum")}, lambda p: p["s"].cast("int"), strict=False
)

# (arity, type) -> columns, body, SQL. In the SQL {f(...)} stands for an aggregate over the window.
ONE, TWO, MANY = ["volume"], ["volume", "value"], ["volume", "value", "dom"]
BODIES = {
    ("", None): (ONE, "list", lambda f: f"array_to_string({f('list(volume{})')}, ' ')"),
    ("", "dbl"): (ONE, "mean", lambda f: f"round({f('avg(volume)')}, 6)"),
    ("", "int"): (ONE, cl.aggregate(F.max), lambda f: f"CAST({f('max(volume)')} AS INT)"),
    ("", "lgl"): (["busy"], "any", lambda f: f("bool_or(busy)")),
    ("", "chr"): (
        ONE,
        cl.on_list(lambda a: F.array_join(a.cast("array<string>"), "+")),
        lambda f: f"array_to_string({f('list(volume{})')}, '+')",
    ),
    ("2", None): (TWO, "list", lambda f: f"array_to_string({f('list(pair{})')}, ' ')"),
    ("2", "dbl"): (
        TWO,
        "cor",
        lambda f: f"round(CASE WHEN {f('var_pop(volume)')} > 0 AND {f('var_pop(value)')} > 0 THEN {f('corr(volume, value)')} END, 6)",
    ),
    ("2", "int"): (TWO, COUNT_DEAR, lambda f: f"CAST({f('sum(CASE WHEN value > volume * 15000000 THEN 1 ELSE 0 END)')} AS INT)"),
    ("2", "lgl"): (TWO, ALL_DEAR, lambda f: f("bool_and(value > volume * 15000000)")),
    ("2", "chr"): (TWO, cl.on_list(lambda a: _join(a, "+")), lambda f: f"array_to_string({f('list(pair{})')}, '+')"),
    ("p", None): (MANY, "list", lambda f: f"array_to_string({f('list(pair{})')}, ' ')"),
    ("p", "dbl"): (
        MANY,
        cl.opaque(lambda volume, value, dom: float((volume * dom).sum()) / float(dom.sum())),
        lambda f: f"round(CAST({f('sum(volume * dom)')} AS DOUBLE) / {f('sum(dom)')}, 6)",
    ),
    ("p", "int"): (MANY, WEIGHTED, lambda f: f"CAST({f('sum(volume * dom)')} AS INT)"),
    ("p", "lgl"): (
        MANY,
        cl.on_list(lambda a: F.exists(a, lambda r: (r["dom"] > 6) & (r["volume"] > 1))),
        lambda f: f("bool_or(dom > 6 AND volume > 1)"),
    ),
    ("p", "chr"): (MANY, cl.on_list(lambda a: _join(a, "+")), lambda f: f"array_to_string({f('list(pair{})')}, '+')"),
}
EXTRA = "volume::VARCHAR || ':' || value::VARCHAR AS pair"


def _family(kind: str, many: str, out_type: str | None) -> None:
    columns, body, sql = BODIES[many, out_type]
    name = f"{'p' if many == 'p' else ''}{kind}{'2' if many == '2' else ''}{'_' + out_type if out_type else ''}"
    build = cl.FAMILY[name]
    inputs = [columns] if many == "p" else columns
    width = {"init": INIT} if kind == "stretch" else {"size": SIZE}

    def run(spark, sf_dir):
        tf = _months(spark, sf_dir) if kind == "stretch" else _keyed(spark, sf_dir)
        call = build(*inputs, body, **width)
        tf = tf.tiles(out=call) if kind == "tile" else tf.mutate(out=call)
        kept = [*tf.meta.key, tf.meta.index, *(["tile"] if kind == "tile" else [])]
        out = F.col("out")
        if out_type is None:
            out = F.array_join(out.cast("array<string>"), " ") if many == "" else _join(out)
        return tf.df.select(*kept, out.alias("out"))

    if kind == "tile":
        value = sql(lambda e: e.replace("{}", " ORDER BY numbered.date"))
        text = f"""WITH {DAILY},
        numbered AS (SELECT *, day(date) AS dom, volume > 1 AS busy, {EXTRA},
                            (row_number() OVER ({SERIES}) - 1) // {SIZE} + 1 AS tile FROM daily)
        SELECT channel, category, service, min(date)::VARCHAR AS date, tile, {value} AS out
        FROM numbered GROUP BY channel, category, service, tile"""
    elif kind == "slide":
        series = SERIES.replace("date", "data.date")
        over = f" OVER ({series} ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW)"
        value = sql(lambda e: e.replace("{}", "") + over)
        text = f"""WITH {DAILY}, data AS (SELECT *, day(date) AS dom, volume > 1 AS busy, {EXTRA} FROM daily)
        SELECT channel, category, service, {day('date')},
               CASE WHEN row_number() OVER ({series}) >= {SIZE} THEN {value} END AS out FROM data"""
    else:
        series = "PARTITION BY channel, category ORDER BY data.date"
        over = f" OVER ({series} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        value = sql(lambda e: e.replace("{}", "") + over)
        text = f"""WITH {MONTHS}, data AS (SELECT *, month(date) AS dom, volume > 20 AS busy, {EXTRA} FROM months)
        SELECT channel, category, {day('date')},
               CASE WHEN row_number() OVER ({series}) >= {INIT} THEN {value} END AS out FROM data"""
    register(name, run, text)


for _kind in ("slide", "tile", "stretch"):
    for _many, _type in BODIES:
        _family(_kind, _many, _type)

# -- the long series ----------------------------------------------------------------------------------

ORDER = "ORDER BY total.date"


def _total_sql(select: str) -> str:
    return f"WITH {TOTAL} {select}"


@query(
    _total_sql(
        f"""SELECT {day('date')}, ttl_volume, CASE WHEN row_number() OVER ({ORDER}) >= 7
        THEN round(avg(ttl_volume) OVER ({ORDER} ROWS 6 PRECEDING), 6) END AS ma FROM total"""
    )
)
def slide_mean7(spark, sf_dir):
    return smoothed(star.total(spark, sf_dir).select("ttl_volume")).df


@query(
    _total_sql(
        f"""SELECT {day('date')},
        CASE WHEN row_number() OVER ({ORDER}) >= 365 THEN CAST(sum(ttl_volume) OVER ({ORDER} ROWS 364 PRECEDING) AS BIGINT) END AS s,
        CASE WHEN row_number() OVER ({ORDER}) >= 90 THEN round(avg(ttl_value) OVER ({ORDER} ROWS 89 PRECEDING), 6) END AS m,
        min(ttl_volume) OVER ({ORDER} ROWS 59 PRECEDING) AS low FROM total"""
    )
)
def slide_wide(spark, sf_dir):
    return star.total(spark, sf_dir).transmute(
        s=cl.FAMILY["slide"]("ttl_volume", "sum", size=365),
        m=cl.FAMILY["slide_dbl"]("ttl_value", "mean", size=90),
        low=cl.FAMILY["slide"]("ttl_volume", "min", size=60, partial=True),
    ).df


@query(
    _total_sql(
        """SELECT row_number() OVER (ORDER BY min(total.date)) AS tile, min(date)::VARCHAR AS date, CAST(sum(ttl_volume) AS BIGINT) AS s
        FROM (SELECT *, (row_number() OVER (ORDER BY date) - 1) // 60 AS t FROM total) AS total GROUP BY t"""
    )
)
def tile_sum60(spark, sf_dir):
    return star.total(spark, sf_dir).tiles(s=cl.FAMILY["tile"]("ttl_volume", "sum", size=60)).df


@query(
    _total_sql(
        f"""SELECT {day('date')}, CASE WHEN row_number() OVER ({ORDER}) >= 60
        THEN round(avg(ttl_volume) OVER ({ORDER} ROWS UNBOUNDED PRECEDING), 6) END AS m,
        round(stddev_samp(ttl_volume) OVER ({ORDER} ROWS UNBOUNDED PRECEDING), 6) AS sd,
        max(ttl_value) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS high,
        first_value(ttl_volume) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS one,
        count(*) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS n FROM total"""
    )
)
def stretch_mean(spark, sf_dir):
    stretch = cl.FAMILY["stretch"]
    return star.total(spark, sf_dir).transmute(
        m=cl.FAMILY["stretch_dbl"]("ttl_volume", "mean", init=60),
        sd=stretch("ttl_volume", "sd"),
        high=stretch("ttl_value", "max"),
        one=stretch("ttl_volume", "first"),
        n=stretch("ttl_volume", "length"),
    ).df


@query(
    _total_sql(
        f"""SELECT row_number() OVER ({ORDER}) - 59 AS window_id, CAST(lag(date, 59) OVER ({ORDER}) AS VARCHAR) AS xmin,
        CAST(date AS VARCHAR) AS xmax, '-Infinity'::DOUBLE AS ymin, 'Infinity'::DOUBLE AS ymax
        FROM total QUALIFY row_number() OVER ({ORDER}) >= 60"""
    )
)
def slide_extents(spark, sf_dir):
    boxes = cl.slider(star.total(spark, sf_dir), 60)
    return boxes.withColumns({"ymin": cl.constant(float("-inf")), "ymax": cl.constant(float("inf"))})


@query(
    _total_sql(
        """SELECT t + 1 AS window_id, min(date)::VARCHAR AS xmin, max(date)::VARCHAR AS xmax, count(*) AS n
        FROM (SELECT *, (row_number() OVER (ORDER BY date) - 1) // 60 AS t FROM total) AS total GROUP BY t"""
    )
)
def tile_extents(spark, sf_dir):
    return cl.tiler(star.total(spark, sf_dir), 60)


@query(
    _total_sql(
        f"""SELECT row_number() OVER ({ORDER}) - 59 AS window_id, CAST(min(date) OVER () AS VARCHAR) AS xmin,
        CAST(date AS VARCHAR) AS xmax FROM total QUALIFY row_number() OVER ({ORDER}) >= 60"""
    )
)
def stretch_extents(spark, sf_dir):
    return cl.stretcher(star.total(spark, sf_dir), 60)


@query(_total_sql(f"SELECT {day('date')}, ttl_volume, ttl_value, row_number() OVER ({ORDER}) AS row FROM total"))
def row_number(spark, sf_dir):
    return star.total(spark, sf_dir).row_number().df


@query(
    f"""WITH {TOTAL},
    months AS (SELECT date_trunc('month', date)::DATE AS yrmth, sum(ttl_volume) AS s, count(*) AS n FROM total GROUP BY 1),
    two AS (SELECT yrmth, CASE WHEN row_number() OVER (ORDER BY yrmth) >= 2
              THEN sum(s) OVER (ORDER BY yrmth ROWS 1 PRECEDING) / sum(n) OVER (ORDER BY yrmth ROWS 1 PRECEDING) END AS ma FROM months)
    SELECT CAST(yrmth AS VARCHAR) AS yrmth, round(ma, 6) AS ma, {day('date')}, ttl_volume
    FROM total JOIN two ON yrmth = date_trunc('month', date)::DATE"""
)
def slide_month2(spark, sf_dir):
    return smoothed_by_month(star.total(spark, sf_dir).select("ttl_volume")).df


@query(
    f"""WITH {DAILY},
    q AS (SELECT channel, category, service, date_trunc('quarter', date)::DATE AS quarter, sum(volume) AS s, count(*) AS n,
                 max(value) AS high FROM daily GROUP BY ALL),
    three AS (SELECT channel, category, service, quarter,
                CASE WHEN row_number() OVER k >= 3 THEN sum(s) OVER f / sum(n) OVER f END AS mean,
                CASE WHEN row_number() OVER k >= 3 THEN max(high) OVER f END AS high
              FROM q WINDOW k AS (PARTITION BY channel, category, service ORDER BY quarter),
                            f AS (PARTITION BY channel, category, service ORDER BY quarter ROWS 2 PRECEDING))
    SELECT CAST(d.date AS VARCHAR) AS date, d.channel, d.category, d.service, volume, value, CAST(quarter AS VARCHAR) AS quarter,
           round(mean, 6) AS mean, high
    FROM daily d JOIN three t ON d.channel = t.channel AND d.category = t.category AND d.service = t.service
      AND quarter = date_trunc('quarter', d.date)::DATE"""
)
def slide_quarter3_keyed(spark, sf_dir):
    return star.enquiries(spark, sf_dir).slide_period(
        cl.yearquarter("date"), "quarter", 3,
        mean=cl.FAMILY["slide_dbl"]("volume", "mean"), high=cl.FAMILY["slide"]("value", "max"),
    ).df


@query(
    f"""WITH {FILLED0}
    SELECT {day('date')}, channel, category, service,
           CASE WHEN row_number() OVER k >= 7 THEN CAST(sum(volume) OVER f AS BIGINT) END AS s,
           CASE WHEN row_number() OVER k >= 28 THEN round(avg(volume) OVER g, 6) END AS m
    FROM filled0 WINDOW k AS (PARTITION BY channel, category, service ORDER BY filled0.date),
      f AS (PARTITION BY channel, category, service ORDER BY filled0.date ROWS 6 PRECEDING),
      g AS (PARTITION BY channel, category, service ORDER BY filled0.date ROWS 27 PRECEDING)"""
)
def slide_sum_keyed(spark, sf_dir):
    return star.filled(spark, sf_dir, volume=0, value=0).transmute(
        s=cl.FAMILY["slide"]("volume", "sum", size=7), m=cl.FAMILY["slide_dbl"]("volume", "mean", size=28)
    ).df


@query(
    f"""WITH {FILLED}
    SELECT {day('date')}, channel, category, service,
           CASE WHEN row_number() OVER k >= 3 AND count(volume) OVER f = 3 THEN CAST(sum(volume) OVER f AS BIGINT) END AS strict,
           CASE WHEN row_number() OVER k >= 3 THEN CAST(sum(volume) OVER f AS BIGINT) END AS known
    FROM filled WINDOW k AS (PARTITION BY channel, category, service ORDER BY filled.date),
      f AS (PARTITION BY channel, category, service ORDER BY filled.date ROWS 2 PRECEDING)"""
)
def slide_nulls(spark, sf_dir):
    slide = cl.FAMILY["slide"]
    return star.filled(spark, sf_dir).transmute(
        strict=slide("volume", "sum", size=3), known=slide("volume", "sum", size=3, na_rm=True)
    ).df


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service,
           CAST(sum(volume) OVER f AS BIGINT) AS s, round(avg(value) OVER f, 6) AS m, max(value) OVER f AS high
    FROM daily WINDOW f AS (PARTITION BY channel, category, service ORDER BY daily.date ROWS UNBOUNDED PRECEDING)"""
)
def stretch_keyed(spark, sf_dir):
    stretch = cl.FAMILY["stretch"]
    return star.enquiries(spark, sf_dir).transmute(
        s=stretch("volume", "sum"), m=stretch("value", "mean"), high=stretch("value", "max")
    ).df


# -- opaque functions ---------------------------------------------------------------------------------

RANGE = cl.opaque(lambda v: float(v.max() - v.min()))


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service,
           CASE WHEN row_number() OVER k >= 5 THEN CAST(max(value) OVER f - min(value) OVER f AS DOUBLE) END AS spread
    FROM daily WINDOW k AS (PARTITION BY channel, category, service ORDER BY daily.date),
      f AS (PARTITION BY channel, category, service ORDER BY daily.date ROWS 4 PRECEDING)"""
)
def opaque_slide(spark, sf_dir):
    return star.enquiries(spark, sf_dir).transmute(spread=cl.FAMILY["slide_dbl"]("value", RANGE, size=5)).df


@query(
    f"""WITH {DAILY}, t AS (SELECT *, (row_number() OVER ({SERIES}) - 1) // 9 + 1 AS tile FROM daily)
    SELECT channel, category, service, tile, min(date)::VARCHAR AS date, CAST(max(value) - min(value) AS DOUBLE) AS spread
    FROM t GROUP BY 1, 2, 3, 4"""
)
def opaque_tile(spark, sf_dir):
    return star.enquiries(spark, sf_dir).tiles(spread=cl.FAMILY["tile_dbl"]("value", RANGE, size=9)).df


@query(
    f"""WITH {MONTHS}
    SELECT channel, category, {day('date')},
           CASE WHEN row_number() OVER k >= 2 THEN CAST(max(value) OVER k - min(value) OVER k AS DOUBLE) END AS spread
    FROM months WINDOW k AS (PARTITION BY channel, category ORDER BY months.date ROWS UNBOUNDED PRECEDING)"""
)
def opaque_stretch(spark, sf_dir):
    return _months(spark, sf_dir).transmute(spread=cl.FAMILY["stretch_dbl"]("value", RANGE, init=2)).df


# -- irregular series ---------------------------------------------------------------------------------


@query(
    f"""SELECT event_id, user_id, event_type,
      CASE WHEN row_number() OVER ({EVENT}) >= 4 THEN round(avg(value) OVER ({EVENT} ROWS 3 PRECEDING), 6) END AS m,
      CASE WHEN row_number() OVER ({EVENT}) >= 4 THEN round(max(value) OVER ({EVENT} ROWS 3 PRECEDING), 6) END AS high
    FROM events"""
)
def events_slide(spark, sf_dir):
    tf = star.event_series(spark, sf_dir).mutate(
        m=cl.FAMILY["slide_dbl"]("value", "mean", size=4), high=cl.FAMILY["slide_dbl"]("value", "max", size=4)
    )
    return tf.df.select("event_id", "user_id", "event_type", "m", "high")


@query(
    f"""SELECT event_id, user_id, event_type, round(sum(value) OVER ({EVENT} ROWS UNBOUNDED PRECEDING), 6) AS s,
      count(*) OVER ({EVENT} ROWS UNBOUNDED PRECEDING) AS n FROM events"""
)
def events_stretch(spark, sf_dir):
    stretch = cl.FAMILY["stretch"]
    tf = star.event_series(spark, sf_dir).mutate(s=stretch("value", "sum"), n=stretch("value", "length"))
    return tf.df.select("event_id", "user_id", "event_type", "s", "n")


@query(
    f"""WITH t AS (SELECT *, (row_number() OVER ({EVENT}) - 1) // 6 + 1 AS tile FROM events)
    SELECT user_id, event_type, tile, round(sum(value), 6) AS s, round(min(value), 6) AS low FROM t GROUP BY 1, 2, 3"""
)
def events_tile(spark, sf_dir):
    tile = cl.FAMILY["tile"]
    tf = star.event_series(spark, sf_dir).tiles(s=tile("value", "sum", size=6), low=tile("value", "min", size=6))
    return tf.df.drop("ts")


@query(f"SELECT event_id, user_id, event_type, row_number() OVER ({EVENT}) AS row FROM events")
def events_row_number(spark, sf_dir):
    return star.event_series(spark, sf_dir).row_number().df.select("event_id", "user_id", "event_type", "row")


ALL = "ORDER BY ts"


@query(
    f"""SELECT event_id, row_number() OVER ({ALL}) AS row,
      CASE WHEN row_number() OVER ({ALL}) >= 50 THEN round(avg(value) OVER ({ALL} ROWS 49 PRECEDING), 6) END AS m,
      round(max(value) OVER ({ALL} ROWS UNBOUNDED PRECEDING), 6) AS high FROM events"""
)
def events_one_series(spark, sf_dir):
    events = star.table(spark, sf_dir, "events").select("ts", "event_id", "value")
    tf = cl.as_temporal(events, "ts", interval=None, validate=False).row_number()
    tf = tf.mutate(m=cl.FAMILY["slide_dbl"]("value", "mean", size=50)).mutate(high=cl.FAMILY["stretch"]("value", "max"))
    return tf.df.select("event_id", "row", "m", "high")


TYPE = "PARTITION BY event_type ORDER BY ts"


@query(
    f"""SELECT event_id, event_type,
      CASE WHEN row_number() OVER ({TYPE}) >= 20 THEN round(avg(value) OVER ({TYPE} ROWS 19 PRECEDING), 6) END AS m,
      count(*) OVER ({TYPE} ROWS UNBOUNDED PRECEDING) AS n, round(sum(value) OVER ({TYPE} ROWS UNBOUNDED PRECEDING), 4) AS s
    FROM events"""
)
def events_hot_series(spark, sf_dir):
    """Few, large series, cut into blocks of an hour as soon as a series passes a thousand rows."""
    events = star.table(spark, sf_dir, "events").select("ts", "event_type", "event_id", "value")
    layout = cl.Layout(hot_rows=1000, block=256)
    tf = cl.as_temporal(events, "ts", ["event_type"], interval=None, validate=False, layout=layout)
    tf = tf.mutate(m=cl.FAMILY["slide_dbl"]("value", "mean", size=20))
    stretch = cl.FAMILY["stretch"]
    tf = tf.mutate(n=stretch("value", "length"), s=stretch("value", "sum"))
    return tf.df.select("event_id", "event_type", "m", "n", F.round("s", 4).alias("s"))


def _stored(tf, spark):
    path = cl.scratch_path(spark, "series")
    cl.write_series(tf, path, buckets=8)
    return cl.read_series(spark, path)


@query(
    f"""SELECT event_id, event_type,
      CASE WHEN row_number() OVER ({TYPE}) >= 20 THEN round(avg(value) OVER ({TYPE} ROWS 19 PRECEDING), 6) END AS m,
      count(*) OVER ({TYPE} ROWS UNBOUNDED PRECEDING) AS n
    FROM events"""
)
def stored_hot_series(spark, sf_dir):
    """Series above a thousand rows are left out of the buckets; both parts get the same windows."""
    events = star.table(spark, sf_dir, "events").select("ts", "event_type", "event_id", "value")
    layout = cl.Layout(hot_rows=1000, block=256)
    stored = _stored(cl.as_temporal(events, "ts", ["event_type"], interval=None, validate=False, layout=layout), spark)
    fam = cl.FAMILY
    tf = stored.each(lambda part: part.mutate(m=fam["slide_dbl"]("value", "mean", size=20)).mutate(n=fam["stretch"]("value", "length")))
    return tf.df.select("event_id", "event_type", "m", "n")


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service, volume,
           CASE WHEN row_number() OVER k >= 7 THEN CAST(sum(volume) OVER f AS BIGINT) END AS s,
           CAST(max(value) OVER k AS BIGINT) AS high
    FROM daily WINDOW k AS (PARTITION BY channel, category, service ORDER BY daily.date),
      f AS (PARTITION BY channel, category, service ORDER BY daily.date ROWS 6 PRECEDING)"""
)
def stored_series(spark, sf_dir):
    """A keyed table by date, written in buckets and read again: windows without a shuffle."""
    fam = cl.FAMILY
    tf = _stored(star.enquiries(spark, sf_dir), spark).frame
    tf = tf.mutate(s=fam["slide"]("volume", "sum", size=7)).mutate(high=fam["stretch"]("value", "max"))
    return tf.df.select("date", "channel", "category", "service", "volume", "s", "high")


# -- windows of months with any body, and folds --------------------------------------------------------


def _drop_merge(a, b):
    return (max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2], a[0] - b[1]))


def _drop_update(state, v):
    for x in v.tolist():
        state = _drop_merge(state, (x, x, 0.0))
    return state


INF = float("inf")
#: The largest fall from an earlier value to a later one; the order of rows counts.
DROP = cl.fold(lambda: (-INF, INF, 0.0), _drop_update, _drop_merge, lambda s: float(s[2]))
#: Highest less lowest value.
WIDTH = cl.fold(
    lambda: (-INF, INF), lambda s, v: (max(s[0], v.max()), min(s[1], v.min())),
    lambda a, b: (max(a[0], b[0]), min(a[1], b[1])), lambda s: float(s[0] - s[1]),
)

TWO_MONTHS = f"""WITH {DAILY},
    m AS (SELECT *, date_trunc('month', date)::DATE AS yrmth,
                 dense_rank() OVER (PARTITION BY channel, category, service ORDER BY date_trunc('month', date)) AS nr FROM daily),
    two AS (SELECT a.channel, a.category, a.service, a.yrmth, a.nr,
                   CAST(max(b.value) - min(b.value) AS {{type}}) AS width, CAST(count(DISTINCT b.volume) AS BIGINT) AS kinds
            FROM (SELECT DISTINCT channel, category, service, yrmth, nr FROM m) a
            JOIN m b ON a.channel = b.channel AND a.category = b.category AND a.service = b.service AND b.nr IN (a.nr, a.nr - 1)
            WHERE a.nr >= 2 GROUP BY 1, 2, 3, 4, 5)
    SELECT {day('m.date', 'date')}, channel, category, service, value, CAST(m.yrmth AS VARCHAR) AS yrmth, {{columns}}
    FROM m LEFT JOIN two USING (channel, category, service, nr)"""


def _two_months(spark, sf_dir, **calls):
    tf = star.enquiries(spark, sf_dir).slide_period(cl.yearmonth("date"), "yrmth", size=2, **calls)
    return tf.df.select("date", "channel", "category", "service", "value", "yrmth", *calls)


@query(TWO_MONTHS.format(type="BIGINT", columns="two.width, two.kinds"))
def slide_month2_lambda(spark, sf_dir):
    slide = cl.FAMILY["slide"]
    width = slide("value", lambda v, over: over(F.max(v)) - over(F.min(v)))
    return _two_months(spark, sf_dir, width=width, kinds=slide("volume", lambda v: F.count_distinct(v)))


@query(TWO_MONTHS.format(type="DOUBLE", columns="two.width"))
def slide_month2_opaque(spark, sf_dir):
    return _two_months(spark, sf_dir, width=cl.FAMILY["slide_dbl"]("value", RANGE))


@query(TWO_MONTHS.format(type="DOUBLE", columns="two.width"))
def slide_month2_fold(spark, sf_dir):
    return _two_months(spark, sf_dir, width=cl.FAMILY["slide_dbl"]("value", WIDTH))


@query(
    f"""WITH t AS (SELECT event_id, event_type, ts, value, max(value) OVER ({TYPE} ROWS UNBOUNDED PRECEDING) - value AS below FROM events)
    SELECT event_id, event_type, round(max(below) OVER ({TYPE} ROWS UNBOUNDED PRECEDING), 6) AS fall,
      CASE WHEN row_number() OVER ({TYPE}) >= 300
        THEN round(max(value) OVER ({TYPE} ROWS 299 PRECEDING) - min(value) OVER ({TYPE} ROWS 299 PRECEDING), 6) END AS width FROM t"""
)
def events_folds(spark, sf_dir):
    """Few, large series in blocks: the state before each block is carried into it."""
    events = star.table(spark, sf_dir, "events").select("ts", "event_type", "event_id", "value")
    layout = cl.Layout(hot_rows=1000, block=256)
    tf = cl.as_temporal(events, "ts", ["event_type"], interval=None, validate=False, layout=layout)
    tf = tf.mutate(width=cl.FAMILY["slide_dbl"]("value", WIDTH, size=300))
    tf = tf.mutate(fall=cl.FAMILY["stretch_dbl"]("value", DROP))
    return tf.df.select("event_id", "event_type", F.round("fall", 6).alias("fall"), F.round("width", 6).alias("width"))


@query(
    f"""WITH {DAILY}, t AS (SELECT *, (row_number() OVER ({SERIES}) - 1) // 9 + 1 AS tile FROM daily),
    u AS (SELECT *, max(value) OVER (PARTITION BY channel, category, service, tile ORDER BY date) - value AS below FROM t)
    SELECT channel, category, service, tile, min(date)::VARCHAR AS date, CAST(max(below) AS DOUBLE) AS fall FROM u GROUP BY 1, 2, 3, 4"""
)
def tile_fold(spark, sf_dir):
    return star.enquiries(spark, sf_dir).tiles(fall=cl.FAMILY["tile_dbl"]("value", DROP, size=9)).df


# -- distinct counts ------------------------------------------------------------------------------


@query(
    f"""WITH {DAILY}
    SELECT {day('date')}, channel, category, service,
           CASE WHEN row_number() OVER k >= 30 THEN CAST(count(DISTINCT volume) OVER w AS INTEGER) END AS kinds,
           CAST(count(DISTINCT volume) OVER a AS BIGINT) AS so_far
    FROM daily WINDOW k AS ({SERIES}), w AS ({SERIES} ROWS 29 PRECEDING), a AS ({SERIES} ROWS UNBOUNDED PRECEDING)"""
)
def slide_distinct(spark, sf_dir):
    out = star.enquiries(spark, sf_dir).transmute(
        kinds=cl.FAMILY["slide_int"]("volume", "n_distinct", size=30), so_far=cl.FAMILY["stretch"]("volume", "n_distinct")
    )
    return out.df.select("date", "channel", "category", "service", "kinds", "so_far")


@query(
    f"""SELECT event_id, event_type, CAST(count(DISTINCT user_id) OVER ({TYPE} ROWS 299 PRECEDING) AS BIGINT) AS users,
      CAST(count(DISTINCT user_id) OVER ({TYPE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS users_so_far FROM events"""
)
def events_distinct(spark, sf_dir):
    """Few, large series in blocks; a value in a series is a series of its own."""
    events = star.table(spark, sf_dir, "events").select("ts", "event_type", "event_id", "user_id")
    layout = cl.Layout(hot_rows=1000, block=256)
    tf = cl.as_temporal(events, "ts", ["event_type"], interval=None, validate=False, layout=layout)
    tf = tf.mutate(users=cl.FAMILY["slide"]("user_id", "n_distinct", size=300, partial=True))
    tf = tf.mutate(users_so_far=cl.FAMILY["stretch"]("user_id", "n_distinct"))
    return tf.df.select("event_id", "event_type", "users", "users_so_far")


@query(
    f"""WITH {DAILY}, t AS (SELECT *, (row_number() OVER ({SERIES}) - 1) // 9 + 1 AS tile FROM daily)
    SELECT channel, category, service, tile, min(date)::VARCHAR AS date, CAST(count(DISTINCT volume) AS INTEGER) AS kinds
    FROM t GROUP BY 1, 2, 3, 4"""
)
def tile_distinct(spark, sf_dir):
    return star.enquiries(spark, sf_dir).tiles(kinds=cl.FAMILY["tile_int"]("volume", "n_distinct", size=9)).df


@query(TWO_MONTHS.format(type="BIGINT", columns="two.kinds"))
def slide_month2_distinct(spark, sf_dir):
    return _two_months(spark, sf_dir, kinds=cl.FAMILY["slide"]("volume", "n_distinct"))

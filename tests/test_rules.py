"""One small table per rule: nulls, membership, gaps, edges, ties, level order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import chronoloom as cl
from chronoloom.operators.relational import global_positions, join, sort_columns

D = dt.date
DAY = cl.Interval(1, "day")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def gaps(spark):
    data = [
        ("a", D(2020, 1, 1), 1),
        ("a", D(2020, 1, 2), None),
        ("a", D(2020, 1, 4), 4),
        ("a", D(2020, 1, 8), 8),
        ("b", D(2020, 1, 5), 5),
        (None, D(2020, 1, 3), 3),
        (None, D(2020, 1, 5), 5),
    ]
    df = spark.createDataFrame(data, "k string, day date, x int")
    return cl.as_temporal(df, "day", ["k"])


def test_declare_detects_and_checks(spark, gaps):
    assert gaps.meta.interval == DAY
    d = gaps.describe().first()
    assert (d.n_rows, d.n_cols, d.interval, d.key, d.n_keys) == (7, 3, "1DAY", "k", 3)
    twice = gaps.df.unionByName(gaps.df.limit(1))
    with pytest.raises(ValueError, match="identify"):
        cl.as_temporal(twice, "day", ["k"])
    pairs = spark.createDataFrame([("c1", "p1", 1), ("c1", "p2", 2)], "child string, parent string, t int")
    with pytest.raises(ValueError, match="parent"):
        cl.as_temporal(pairs, "t", [cl.nested("child", "parent")])
    assert cl.as_temporal(pairs, "t", ["child", "parent"]).meta.interval is None  # single rows: no distance


def test_interval_units(spark):
    def detect(values, kind):
        return cl.detect_interval(cl.as_temporal(spark.createDataFrame([(v,) for v in values], f"t {kind}"), "t", interval=None))

    assert detect([1, 5, 11], "int") == cl.Interval(2, "unit")
    assert detect([D(2020, 1, 1), D(2020, 1, 15)], "date") == cl.Interval(14, "day")
    clock = dt.datetime
    # Across a change to summer time, as wall-clock time.
    assert detect([clock(2020, 3, 8, 1, 0), clock(2020, 3, 8, 1, 30), clock(2020, 3, 8, 4, 0)], "timestamp_ntz") == cl.Interval(30, "minute")
    assert detect([clock(1969, 12, 31, 23, 59, 59, 5), clock(1970, 1, 1)], "timestamp_ntz") == cl.Interval(999995, "microsecond")
    months = spark.createDataFrame([(D(2020, m, 1),) for m in (1, 3, 7)], "t date")
    monthly = cl.as_temporal(months, "t", interval=cl.Interval(1, "month"))
    assert cl.detect_interval(monthly) == cl.Interval(2, "month")


def test_fill_own_span_keeps_nulls(gaps):
    filled = gaps.fill_na(x=0)
    got = rows(filled.df.where("k = 'a'").select("day", "x"), "day")
    assert got == [
        (D(2020, 1, 1), 1),
        (D(2020, 1, 2), None),  # was null before: stays
        (D(2020, 1, 3), 0),
        (D(2020, 1, 4), 4),
        (D(2020, 1, 5), 0),
        (D(2020, 1, 6), 0),
        (D(2020, 1, 7), 0),
        (D(2020, 1, 8), 8),
    ]
    assert filled.df.where("k = 'b'").count() == 1
    assert rows(filled.df.where("k is null").select("day", "x"), "day") == [(D(2020, 1, 3), 3), (D(2020, 1, 4), 0), (D(2020, 1, 5), 5)]
    assert gaps.fill_na().df.where("x is null").count() == 6
    assert filled.meta.dense and not filled.meta.shared_span


def test_fill_full_span_and_limit(gaps):
    full = gaps.fill_na(full=True, x=0)
    assert rows(full.df.groupBy("k").count(), "k") == [(None, 8), ("a", 8), ("b", 8)]
    with pytest.raises(ValueError, match="multiply"):
        gaps.fill_na(max_ratio=1.5)
    assert cl.fill_size(gaps, full=True).first().n_filled == 24
    with pytest.raises(ValueError, match="cannot fill"):
        gaps.fill_na(y=1)


def test_fill_months_from_month_ends(spark):
    df = spark.createDataFrame([(D(2019, 11, 30), 1), (D(2019, 12, 31), 0), (D(2020, 3, 31), 2)], "day date, x int")
    tf = cl.as_temporal(df, "day").index_by(month=cl.yearmonth("day")).summarise(x=F.sum("x"))
    got = rows(tf.fill_na(x=0).df, "month")
    assert got == [(D(2019, 11, 1), 1), (D(2019, 12, 1), 0), (D(2020, 1, 1), 0), (D(2020, 2, 1), 0), (D(2020, 3, 1), 2)]


def test_fill_recomputes_the_index_group(gaps):
    df = gaps.index_by(month=cl.yearmonth("day")).fill_na().df
    assert df.where("month is null").count() == 0


def test_gap_report(gaps):
    got = rows(gaps.count_gaps().select("k", "from", "to", "n"), "k", "from")
    assert got == [
        (None, D(2020, 1, 4), D(2020, 1, 4), 1),
        ("a", D(2020, 1, 3), D(2020, 1, 3), 1),
        ("a", D(2020, 1, 5), D(2020, 1, 7), 3),
    ]
    full = rows(gaps.count_gaps(full=True).where("k = 'b'").select("from", "to", "n"), "from")
    assert full == [(D(2020, 1, 1), D(2020, 1, 4), 4), (D(2020, 1, 6), D(2020, 1, 8), 3)]


def test_null_rules_in_summaries(gaps):
    by_key = gaps.df.groupBy("k").agg(
        cl.total("x").alias("strict"), cl.total("x", na_rm=True).alias("known"), cl.mean("x").alias("mean"), cl.n_distinct("x").alias("n")
    )
    assert rows(by_key, "k") == [(None, 8, 8, 4.0, 2), ("a", None, 13, None, 4), ("b", 5, 5, 5.0, 1)]


def test_summarise_rewrites_the_description(gaps):
    tf = gaps.mutate(c=F.lit("z")).group_by("c", "k").index_by(year=cl.year("day")).summarise(n=cl.n_rows())
    m = tf.meta
    assert (m.index, m.key, m.groups, tf.require_interval()) == ("year", ("k", "c"), ("c",), cl.Interval(1, "year"))
    assert rows(tf.df, "k") == [("z", None, 2020, 2), ("z", "a", 2020, 4), ("z", "b", 2020, 1)]
    assert gaps.summarise(n=cl.n_rows()).meta.key == ()


def test_conditions_with_null(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    got = df.select(
        "x",
        cl.if_else(F.col("x") > 2, "big", "small").alias("size"),
        cl.is_in("x", [1]).alias("one"),
        cl.is_in("x", [1, None]).alias("one_or_null"),
        cl.recode(F.col("x").cast("string"), {"3": "three"}).alias("r"),
    )
    assert [tuple(r) for r in got.collect()] == [
        (1, "small", True, True, "1"),
        (None, None, False, True, None),
        (3, "big", False, False, "three"),
    ]


def test_text_functions(spark):
    df = spark.createDataFrame([("Phone - inbound call",), ("e-mail",), ("Fax x",)], "c string")
    assert [r[0] for r in df.select(cl.cut_at_blank("c")).collect()] == ["Phone", "e-mail", "Fax"]
    days = spark.createDataFrame([("1/2/2014",), ("31-12-2015",), ("3 Mar 2016",), ("no date",), (None,)], "c string")
    assert [r[0] for r in days.select(cl.parse_dmy("c")).collect()] == [D(2014, 2, 1), D(2015, 12, 31), D(2016, 3, 3), None, None]


def test_joins_match_nulls(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("w", 40)], "k string, a int")
    assert rows(join(a, b, ["k"], "inner"), "k") == [(None, 2, 20), ("x", 1, 10)]
    assert rows(join(a, b, ["k"], "inner", "never"), "k") == [("x", 1, 10)]
    assert sorted(map(str, rows(join(a, b, ["k"], "full")))) == sorted(
        map(str, [("x", 1, 10), (None, 2, 20), ("z", 3, None), ("w", None, 40)])
    )
    assert rows(join(a, b, ["k"], "right"), "a_y") == [("x", 1, 10), (None, 2, 20), ("w", None, 40)]
    assert rows(join(a, b, ["k"], "anti")) == [("z", 3)]
    assert rows(join(a, a, ["k"], "semi"), "a") == [("x", 1), (None, 2), ("z", 3)]


def skewed(spark, name, seed, n, only):
    """A third of the rows under the hot key, a third without a key, the rest over small keys."""
    rng = random.Random(seed)
    keys = [rng.choice(["hot", None, f"{only if rng.random() < 0.3 else 'k'}{rng.randrange(9)}"]) for _ in range(n)]
    return spark.createDataFrame([(k, i % 2, i) for i, k in enumerate(keys)], f"k string, j int, {name} int")


@pytest.mark.parametrize(
    "how, na_matches",
    [("inner", "na"), ("left", "never"), ("right", "na"), ("full", "na"), ("full", "never"), ("semi", "na"), ("anti", "never")],
)
def test_dealt_joins_equal_plain_ones(spark, how, na_matches):
    a, b, none = skewed(spark, "a", 1, 120, "l"), skewed(spark, "b", 2, 90, "r"), skewed(spark, "b", 3, 0, "r")
    few = b.where(F.coalesce(F.col("k"), F.lit("k")) != "hot")  # the hot key is on one side only
    for left, right, on in ((a, b, ["k", "j"]), (a, few, ["k"]), (few, a, ["k"]), (a, none, ["k"])):
        expected = join(left, right, on, how, na_matches, deal=False)
        dealt = join(left, right, on, how, na_matches, deal=True, part_rows=7)
        assert dealt.columns == expected.columns
        assert sorted(map(str, dealt.collect())) == sorted(map(str, expected.collect()))


def test_dealt_full_join_has_no_large_task(spark, tmp_path):
    """A key of a third of all rows, and a null key of another third, in the tasks of the join."""
    spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 > 1, F.lit(-1)).otherwise(F.col("id"))).alias("k"), "id").write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    b = spark.range(-1, 3_000).select(F.col("id").alias("k"), F.lit("b").alias("y"))
    kept = {s: spark.conf.get(s) for s in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for s, v in zip(kept, ("-1", "false")):
            spark.conf.set(s, v)
        for na_matches in ("na", "never"):
            joined = join(a, b, ["k"], "full", na_matches, part_rows=500)
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            plain = join(a, b, ["k"], "full", na_matches, deal=False)
            assert sum(sizes) == plain.count() and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    finally:
        for s, v in kept.items():
            spark.conf.set(s, v)


def test_join_refuses_repeated_keys(gaps, spark):
    two = spark.createDataFrame([("a", 1), ("a", 2)], "k string, y int")
    with pytest.raises(ValueError, match="no longer"):
        gaps.left_join(two, ["k"])


def test_verbs_keep_the_description(gaps):
    assert gaps.select("x").columns == ["x", "day", "k"]
    renamed = gaps.group_by("k").index_by(m=cl.yearmonth("day")).rename(series="k", at="day")
    assert renamed.meta.index == "at" and renamed.meta.key == ("series",) and renamed.meta.groups == ("series",)
    assert renamed.summarise(n=cl.n_rows()).columns == ["series", "m", "n"]
    assert gaps.transmute(y=F.col("x") * 2).columns == ["y", "day", "k"]
    with pytest.raises(ValueError, match="cannot replace"):
        gaps.mutate(day=F.lit(None))
    assert not gaps.fill_na().filter(F.col("x") > 1).meta.dense


def test_mutate_is_sequential(gaps):
    got = gaps.filter(F.col("k") == "b").mutate(x=F.col("x") + 1, y=F.col("x") * 10).df.first()
    assert (got.x, got.y) == (6, 60)


def test_slices(gaps):
    assert rows(gaps.slice(2, 3).df, "day") == [("a", D(2020, 1, 2), None), ("a", D(2020, 1, 4), 4)]
    assert rows(gaps.group_by("k").slice(2, 2).df.select("k"), "k") == [(None,), ("a",)]
    with pytest.raises(ValueError):
        gaps.slice(0, 2)


def test_deep_slice_by_position(gaps, monkeypatch):
    from chronoloom.operators import relational

    want = rows(gaps.slice(3, 6).df, "k", "day")
    monkeypatch.setattr(relational, "LIMIT_ROWS", 1)
    assert rows(gaps.slice(3, 6).df, "k", "day") == want


def test_top_k_ties_by_name(spark, monkeypatch):
    from chronoloom.operators import relational

    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 2), ("d", 5), ("e", None)], "k string, n int")
    assert rows(cl.top_k(df, "n", 3, ["k"])) == [("d", 5), ("a", 2), ("b", 2)]
    monkeypatch.setattr(relational, "LIMIT_ROWS", 1)
    assert set(rows(cl.top_k(df, "n", 3, ["k"]))) == {("d", 5), ("a", 2), ("b", 2)}


def test_positions_survive_one_repeated_value(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("third"), F.lit("same").alias("v"))
    got = global_positions(df.repartition(8), sort_columns(["v"]), "p")
    assert got.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first() == (5000, 0, 4999)


def test_levels(spark):
    df = spark.createDataFrame([("Zoo",), ("Other",), ("Ant",), ("Fax",), (None,)], "c string")
    order = cl.LevelOrder().relevel("Other", after=float("inf"))
    assert [r[0] for r in df.orderBy(*order.sort_columns("c")).collect()] == ["Ant", "Fax", "Zoo", "Other", None]
    assert [r[0] for r in df.orderBy(*order.relevel("Zoo").sort_columns("c")).collect()] == ["Zoo", "Ant", "Fax", "Other", None]
    assert rows(cl.present_levels(df, "c", order), "ordinal") == [("Ant", 1), ("Fax", 2), ("Zoo", 3), ("Other", 4)]
    kept = spark.createDataFrame([("Ant",)], "k string")
    want = [(None,), ("Ant",), ("Other",), ("Other",), ("Other",)]
    assert rows(cl.lump_keep(df, "c", kept), "c") == want == rows(cl.lump_keep(df, "c", ["Ant"]), "c")
    assert rows(cl.lump_drop(df, "c", ["Fax", "Zoo"]), "c") == [(None,), ("Ant",), ("Other",), ("Other",), ("Other",)]


def test_reshapes_invert(gaps, spark):
    wide = gaps.mutate(y=F.col("x") * 2)
    long = wide.gather(["x", "y"], "m", "v")
    assert long.meta.key == ("k", "m")
    back = long.spread("m", "v", ["x", "y"])
    assert back.meta.key == ("k",)
    assert rows(back.df.select("k", "day", "x", "y"), "k", "day") == rows(wide.df, "k", "day")
    assert rows(long.spread("m", "v").df.select("k", "day", "x", "y"), "k", "day") == rows(wide.df, "k", "day")
    for by, parts in ((["k"], None), (["k"], 2), (["x"], 1)):
        nested = gaps.nest(by, part_rows=parts)
        assert rows(cl.unnest(nested).select("k", "day", "x"), "k", "day") == rows(gaps.df, "k", "day")
    assert gaps.nest(["k"], part_rows=2).agg(F.max(F.size("data"))).first()[0] == 2


def test_hierarchy_repeats_a_name_at_two_levels(spark):
    pairs = spark.createDataFrame([("Other", "Calls"), ("Calls", "Desk"), ("Calls", "Arm"), ("Zoo", "Ape")], "p string, c string")
    doc = cl.hierarchy(pairs, "p", "c", "City", cl.LevelOrder(last=("Other",))).first()[0]
    assert doc == (
        '{"name":"City","children":[{"name":"Calls","children":[{"name":"Arm"},{"name":"Desk"}]},'
        '{"name":"Zoo","children":[{"name":"Ape"}]},{"name":"Other","children":[{"name":"Calls"}]}]}'
    )


def test_csv_by_name_and_checked_header(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text("Date,Work Site,Volume\n1/2/2014,Call Centre,3\n")
    (tmp_path / "b.csv").write_text("VOLUME,DATE\n4,2/2/2014\nmany,3/2/2014\n")
    (tmp_path / "notes.txt").write_text("not a table\n")
    schema = T.StructType.fromDDL("Date string, `Work Site` string, Volume int")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    got = rows(cl.read_csv_files(spark, paths, schema, same_layout=False), "date")
    assert got == [("1/2/2014", "Call Centre", 3), ("2/2/2014", None, 4), ("3/2/2014", None, None)]
    one = cl.read_csv_files(spark, str(tmp_path), schema, pattern="a*csv")
    assert one.columns == ["date", "work site", "volume"] and one.count() == 1
    with pytest.raises(Exception):
        cl.read_csv_files(spark, paths[1], schema).collect()
    cl.write_table(one.withColumnRenamed("work site", "site"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.gz.parquet"))
    assert cl.read_table(spark, str(tmp_path / "out")).count() == 1


class Session:
    """As much of a session as the choice of a shared folder looks at."""

    def __init__(self, master, named=None):
        self.master, self.named, self.set_to = master, named, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.named or default

    def getCheckpointDir(self):
        return self.set_to

    def setCheckpointDir(self, path):
        self.set_to = path


def test_scratch_needs_a_shared_folder(spark):
    from chronoloom.sources.storage import shared_dir

    assert cl.scratch_path(spark, "x") != cl.scratch_path(spark, "x")
    assert shared_dir(Session("yarn", "hdfs://shared/dir")) == "hdfs://shared/dir"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"))
    local = Session("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.set_to


def test_the_list_of_hot_keys_is_bounded(spark, monkeypatch):
    from chronoloom.operators import layout

    df = spark.range(100).select(F.when(F.col("id") < 40, 0).otherwise(F.col("id") % 6).alias("k"), F.col("id").alias(layout.O))
    hot = lambda: {r.k for r in layout.mark_hot(df, ("k",), 5, 4).where(layout.HOT).select("k").distinct().collect()}
    assert hot() == {0, 1, 2, 3, 4, 5}
    monkeypatch.setattr(layout, "HOT_KEYS", 3)  # more than a third of the rows
    assert hot() == {0}


WEEK = cl.Interval(7, "day")


@pytest.mark.parametrize("options", [{}, {"layout": cl.Layout(hot_rows=1, block=2)}])
def test_fill_off_the_lattice_invents_nothing(spark, options):
    """Distances that aren't multiples of the interval, on whole series and on blocks."""
    from collections import Counter

    for days, inserted in (([0, 3, 14, 21], 0), ([0, 7, 10, 17], 0), ([0, 2, 23], 2)):
        rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(d), "k", 1) for d in days]
        df = spark.createDataFrame(rows, "t timestamp_ntz, k string, x int")
        if not options:
            df = df.withColumn("t", F.col("t").cast("date"))
        for key in (["k"], []):
            tf = cl.as_temporal(df, "t", key, interval=WEEK, validate=False, **options)
            filled = tf.fill_na(x=0)
            found = Counter(r.t for r in filled.df.collect())
            assert max(found.values()) == 1 and len(found) == len(days) + inserted
            assert not filled.meta.dense
            assert min(found) == min(r.t for r in df.collect())
            with pytest.raises(ValueError, match="multiples"):
                cl.as_temporal(df, "t", key, interval=WEEK, **options)


def test_a_stored_monthly_table_is_declared_by_its_period(spark):
    months = [(dt.date(2020, m, 1), m) for m in (1, 2, 4, 7)]
    df = spark.createDataFrame(months, "month date, x int")
    tf = cl.as_temporal(df, cl.yearmonth("month"))
    assert tf.meta.interval == cl.Interval(1, "month")
    assert [r.month.month for r in tf.fill_na(x=0).df.orderBy("month").collect()] == list(range(1, 8))
    quarters = cl.as_temporal(df.where("x in (1, 4, 7)"), cl.yearmonth("month"))
    assert quarters.meta.interval == cl.Interval(3, "month")


def test_interval_after_index_by_is_found_not_assumed(spark):
    rows = [(dt.date(2020, m, d), 1) for m in (1, 4, 7, 10) for d in (1, 9)]
    tf = cl.as_temporal(spark.createDataFrame(rows, "d date, x int"), "d").index_by(m=cl.yearmonth("d"))
    monthly = tf.summarise(x=F.sum("x"))
    assert monthly.require_interval() == cl.Interval(3, "month")
    assert monthly.fill_na(x=0).df.count() == 4


def test_spread_refuses_to_lose_a_measure(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1, 2), (dt.date(2020, 1, 1), None, 3, 4)], "d date, k string, x int, y int")
    tf = cl.as_temporal(df, "d", ["k"])
    with pytest.raises(ValueError, match="lose y"):
        tf.spread("k", "x")
    out = tf.with_(df.drop("y")).spread("k", "x").df
    assert out.columns == ["d", "a", "<NA>"] and tuple(out.first())[1:] == (1, 3)


def test_open_ties_are_settled_alike(spark, monkeypatch):
    from chronoloom.operators import relational

    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("x"))
    few = sorted(relational.top_k(df, "x", 20, []).collect())
    monkeypatch.setattr(relational, "LIMIT_ROWS", 5)
    assert sorted(relational.top_k(df, "x", 20, []).collect()) == few


def test_many_levels_stay_distributed(spark, monkeypatch):
    from chronoloom.operators import reshape

    rows = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", None, 4), ("b", "z", None), ("b", "x", 5), (None, "w", 6)], "i string, k string, v int"
    )
    got = {(r.i, r.page): r.cells for r in reshape.spread_pages(rows, ["i"], "k", "v", page_levels=2).collect()}
    assert got == {("a", 0): {"x": 3}, ("a", 1): {"y": 2}, ("b", 0): {"x": 5}, ("b", 2): {"<NA>": 4}, (None, 0): {"w": 6}}
    assert reshape.spread_pages(rows.where("false"), ["i"], "k", "v").count() == 0
    monkeypatch.setattr(reshape, "LEVELS", 4)
    with pytest.raises(ValueError, match="more than 4 levels"):
        reshape.spread(rows, ["i"], "k", "v")
    monkeypatch.setattr(reshape, "LEVELS", 5)
    assert set(reshape.spread(rows, ["i"], "k", "v").columns) == {"i", "w", "x", "y", "z", "<NA>"}


def test_keys_of_three_levels(spark):
    data = [("b1", "s1", "c1", 1), ("b2", "s1", "c1", 1), ("b3", "s2", "c2", 1), (None, None, None, 2)]
    df = spark.createDataFrame(data, "block string, street string, city string, t int")
    tf = cl.as_temporal(df, "t", [cl.nested("block", "street", "city")], interval=None)
    assert tf.meta.key == ("block", "street", "city") and tf.meta.key_label == "block | street | city"
    assert tf.rename(town="city").meta.key_label == "block | street | town"
    torn = df.unionByName(spark.createDataFrame([("b4", "s1", "c2", 1)], df.schema))
    found = cl.as_temporal(torn, "t", [cl.nested("block", "street", "city")], interval=None, validate=False)
    assert rows(cl.broken_nesting(found)) == [("street", "s1", 2)]
    with pytest.raises(ValueError, match="parent"):
        cl.as_temporal(torn, "t", [cl.nested("block", "street", "city")], interval=None)
    with pytest.raises(ValueError, match="itself"):
        cl.as_temporal(df, "t", [cl.nested("block", "street"), cl.nested("street", "block")], interval=None)


def test_trees_of_any_depth(spark):
    df = spark.createDataFrame([("x", "x", "x"), ("x", "x", "y"), ("x", "y", "x"), ("x", "x", "x"), ("a", None, "z")], "a string, b string, c string")
    doc = cl.hierarchy_of(df, ["a", "b", "c"], "all").first()[0]
    assert doc == (
        '{"name":"all","children":[{"name":"a","children":[{"children":[{"name":"z"}]}]},'
        '{"name":"x","children":[{"name":"x","children":[{"name":"x"},{"name":"y"}]},{"name":"y","children":[{"name":"x"}]}]}]}'
    )
    table = {(r.depth, tuple(r.path)): (r.n_children, r.n_leaves) for r in cl.branches(df, ["a", "b", "c"]).collect()}
    assert table == {
        (1, ("x",)): (2, 3), (1, ("a",)): (1, 1), (2, ("x", "x")): (2, 2), (2, ("x", "y")): (1, 1), (2, ("a", None)): (1, 1),
        (3, ("x", "x", "x")): (0, 1), (3, ("x", "x", "y")): (0, 1), (3, ("x", "y", "x")): (0, 1), (3, ("a", None, "z")): (0, 1),
    }
    assert cl.hierarchy_of(df, ["a"], "all").first()[0] == '{"name":"all","children":[{"name":"a"},{"name":"x"}]}'
    assert cl.branches(df.where("a = 'none'"), ["a", "b"]).count() == 0

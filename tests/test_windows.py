"""Windows: edges, nulls, typed results, and block placement against plain windows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import chronoloom as cl

fam = cl.FAMILY


def series(spark, seed, n_series, n, step=60, spread=(1, 1, 2, 10, 300), null_key=True):
    rnd = random.Random(seed)
    out = []
    for s in range(n_series):
        at = dt.datetime(1969, 12, 31, 22, 0) + dt.timedelta(seconds=step * rnd.randrange(50))
        for _ in range(rnd.randrange(1, n + 1) if s else n):
            out.append((None if null_key and s == 1 else f"s{s}", at, rnd.choice([None, *range(9)]), rnd.random()))
            at += dt.timedelta(seconds=step * rnd.choice(spread))
    return spark.createDataFrame(out, "k string, t timestamp_ntz, x int, y double")


def collected(df, *order):
    def show(v):
        return f"{v:.9f}" if isinstance(v, float) else str(v)

    return sorted(tuple(show(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def merge_falls(a, b):
    return (max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2], a[0] - b[1]))


def update_falls(state, v):
    for x in v.tolist():
        state = merge_falls(state, (x, x, 0.0))
    return state


INF = float("inf")
FALL = cl.fold(lambda: (-INF, INF, 0.0), update_falls, merge_falls, lambda s: s[2])


def fall(values):
    """The largest fall from an earlier value to a later one, by all pairs."""
    return max([0.0, *[a - b for i, a in enumerate(values) for b in values[i:]]])


def everything(df, key, **options):
    """All ordered operations over one table, under one placement."""
    tf = cl.as_temporal(df, "t", key, interval=options.pop("interval", None), validate=False, **options)
    minute = tf.with_(interval=cl.Interval(1, "minute"), lattice=True)
    slid = tf.mutate(
        s=fam["slide"]("x", "sum", size=5, na_rm=True),
        m=fam["slide_dbl"]("x", "mean", size=3),
        w=fam["slide"]("x", "sum", size=70, partial=True, na_rm=True),
        l=fam["slide"]("x", size=3),
        v=fam["slide_dbl"]("y", "sd", size=6),
        c=fam["slide2_dbl"]("x", "y", "cor", size=8, na_rm=True),
        o=fam["slide2_dbl"]("y", "x", cl.opaque(lambda a, b: float(a[-1] - a[0])), size=4),
        f=fam["slide_dbl"]("y", FALL, size=5),
    )
    stretched = tf.mutate(
        s=fam["stretch"]("x", "sum", na_rm=True),
        m=fam["stretch_dbl"]("y", "mean", init=4),
        n=fam["stretch_int"]("x", "length"),
        hi=fam["stretch_dbl"]("y", "max"),
        f=fam["stretch"]("x", "first"),
        z=fam["stretch"]("x", "last"),
        l=fam["stretch"]("x", init=3),
        v=fam["stretch_dbl"]("y", "sd"),
        c=fam["stretch2_dbl"]("x", "y", "cor", na_rm=True),
        g=fam["stretch2_dbl"]("x", "y", "cov", na_rm=True),
        o=fam["stretch_dbl"]("y", cl.opaque(lambda a: float(a.max() - a.min())), init=2),
        d=fam["stretch_dbl"]("y", FALL, init=3),
    )
    tiled = tf.tiles(
        a=fam["tile_int"]("x", "sum", size=7, na_rm=True),
        b=fam["tile"]("x", size=7),
        c=fam["tile2_dbl"]("x", "y", "cor", size=7),
        d=fam["ptile_dbl"](["x", "y"], cl.opaque(lambda a, b: float(b.sum())), size=7),
        f=fam["tile_dbl"]("y", FALL, size=7),
    )
    dense = minute.fill_na(x=0, max_ratio=None)
    return [
        slid.df,
        stretched.df,
        tiled.df,
        tf.row_number().df,
        dense.df,
        dense.mutate(s=fam["slide"]("x", "sum", size=100, na_rm=True)).df,
        minute.fill_na(full=True, x=0, max_ratio=None).df,
        minute.count_gaps().select(*key, "from", "to", "n"),
        minute.count_gaps(full=True).select(*key, "from", "to", "n"),
        tf.slide_period(cl.day("t"), "d", 2, z=fam["slide_dbl"]("y", "mean"), q=fam["slide"]("x", "sum", na_rm=True)).df,
        tf.slide_period(
            cl.day("t"), "d", 2, z=fam["slide_dbl"]("y", FALL), g=fam["slide"]("y", lambda v, over: over(F.max(v)) - over(F.min(v))),
            o=fam["slide_dbl"]("y", cl.opaque(lambda v: float(v[0] - v[-1]))), l=fam["slide"]("x"), n=fam["slide"]("y", "length"),
        ).df,
        cl.slider(tf, 6),
        cl.tiler(tf, 6),
        cl.stretcher(tf, 6),
        cl.interval_of(tf),
    ]


TINY = cl.Layout(hot_rows=20, block=4)


@pytest.mark.parametrize("seed", [1])
def test_blocks_equal_plain_windows(spark, seed):
    df = series(spark, seed, 4, 60).cache()
    plain = everything(df, ["k"], max_rows=1000)
    assert plain[0].count() > 60
    for options in ({"layout": TINY}, {"layout": TINY, "interval": cl.Interval(1, "minute")}):
        for i, (want, got) in enumerate(zip(plain, everything(df, ["k"], **options))):
            assert collected(got) == collected(want), i


def test_one_long_series(spark):
    df = series(spark, 3, 1, 70).drop("k").cache()
    constant = everything(df.withColumn("k", F.lit("s")), ["k"], max_rows=1000)
    for i, (want, got) in enumerate(zip(constant, everything(df, [], layout=TINY))):
        assert collected(got) == collected(want.drop("k")), i


@pytest.fixture
def small(spark):
    data = [("a", i, v, float(i)) for i, v in enumerate([3, None, 5, 7, 1])] + [("b", 0, 9, 1.0)]
    df = spark.createDataFrame(data, "k string, t int, x int, y double")
    return cl.as_temporal(df, "t", ["k"], max_rows=10)


def column(tf, call, key="a"):
    return [r.out for r in tf.mutate(out=call).df.where(F.col("k") == key).orderBy("t").collect()]


def test_slide_edges_and_nulls(small):
    assert column(small, fam["slide"]("x", "sum", size=2)) == [None, None, None, 12, 8]
    assert column(small, fam["slide"]("x", "sum", size=2, na_rm=True)) == [None, 3, 5, 12, 8]
    assert column(small, fam["slide"]("x", "max", size=3, partial=True, na_rm=True)) == [3, 3, 5, 7, 7]
    assert column(small, fam["slide"]("x", "sum", size=1)) == [3, None, 5, 7, 1]  # size 1: identity
    assert column(small, fam["slide"]("x", "sum", size=9)) == [None] * 5  # shorter than the window
    assert column(small, fam["slide"]("x", size=2)) == [None, [3, None], [None, 5], [5, 7], [7, 1]]
    assert column(small, fam["slide_dbl"]("y", cl.aggregate(F.product), size=3)) == [None, None, 0.0, 6.0, 24.0]


def test_opaque_is_called_on_full_windows_only(small):
    def strict(a):
        assert len(a) == 3
        return float(a.sum())

    assert column(small, fam["slide_dbl"]("y", cl.opaque(strict), size=3)) == [None, None, 3.0, 6.0, 9.0]


def test_wide_windows_equal_frames(spark, monkeypatch):
    from chronoloom.operators import windows

    df = series(spark, 5, 3, 90).cache()
    tf = cl.as_temporal(df, "t", ["k"], interval=None, validate=False, max_rows=1000)

    def wide(partial):
        return tf.transmute(
            s=fam["slide"]("x", "sum", size=7, partial=partial),
            r=fam["slide"]("x", "sum", size=7, partial=partial, na_rm=True),
            m=fam["slide"]("y", "mean", size=10, partial=partial),
            lo=fam["slide"]("y", "min", size=13, partial=partial),
            hi=fam["slide"]("x", "max", size=4, partial=partial, na_rm=True),
            sd=fam["slide"]("y", "sd", size=9, partial=partial),
            c=fam["slide2"]("x", "y", "cor", size=11, partial=partial, na_rm=True),
            f=fam["slide"]("x", "first", size=6, partial=partial),
        ).df

    plain = [collected(wide(False)), collected(wide(True))]
    monkeypatch.setattr(windows, "WIDE", 2)
    assert [collected(wide(False)), collected(wide(True))] == plain


def test_any_and_all_with_unknown(small):
    tf = small.mutate(p=F.col("x") > 4)
    assert column(tf, fam["slide_lgl"]("p", "any", size=2)) == [None, None, True, True, True]
    assert column(tf, fam["slide_lgl"]("p", "all", size=2)) == [None, False, None, True, False]
    assert column(tf, fam["stretch_lgl"]("p", "all")) == [False] * 5


def test_result_types_are_held(small):
    with pytest.raises(TypeError, match="promises int"):
        small.mutate(out=fam["slide_int"]("y", "mean", size=2))
    with pytest.raises(TypeError, match="promises boolean"):
        small.tiles(out=fam["tile_lgl"]("x", "sum", size=2))
    types = {
        "slide_dbl": "double",
        "stretch_int": "int",
        "slide_chr": "string",
    }
    for name, want in types.items():
        width = {"init": 1} if "stretch" in name else {"size": 2}
        assert dict(small.mutate(out=fam[name]("x", "max", **width)).df.dtypes)["out"] == want


def test_the_family_is_complete():
    assert len(fam) == 45
    for name in ("slide", "slide2", "pslide", "tile_dbl", "ptile_lgl", "stretch2_dbl", "pstretch_chr"):
        assert callable(getattr(cl, name))
    with pytest.raises(TypeError):
        fam["slide2"]("x", size=2)
    with pytest.raises(ValueError):
        fam["slide"]("x", "sum", size=0)
    with pytest.raises(TypeError):
        fam["stretch"]("x", "sum", size=3)


def test_stretch_edges(small):
    assert column(small, fam["stretch"]("y", "sum", init=3)) == [None, None, 3.0, 6.0, 10.0]
    assert column(small, fam["stretch"]("x", "sum")) == [3, None, None, None, None]
    assert column(small, fam["stretch"]("x", "max", na_rm=True)) == [3, 3, 5, 7, 7]
    whole = small.df.where("k = 'a'").agg(F.var_samp("y")).first()[0]
    assert column(small, fam["stretch"]("y", "var"))[-1] == pytest.approx(whole)


def test_constant_windows_have_no_correlation(spark):
    df = spark.createDataFrame([(i, 0.1, float(i)) for i in range(6)], "t int, x double, y double")
    for tf in (cl.as_temporal(df, "t", layout=TINY), cl.as_temporal(df.withColumn("k", F.lit(1)), "t", ["k"], max_rows=9)):
        got = tf.mutate(a=fam["slide2"]("x", "y", "cor", size=3), b=fam["stretch2"]("x", "y", "cor")).df
        assert got.where("a is not null or b is not null").count() == 0


def test_stretch_of_an_arbitrary_aggregate_on_every_placement(small):
    assert column(small, fam["stretch"]("y", cl.aggregate(F.product))) == [0.0] * 5
    one = small.df.where("k = 'a'").drop("k")
    span = lambda c, over: over(F.max(c)) - over(F.min(c))
    whole, blocks = cl.as_temporal(one, "t", max_rows=9), cl.as_temporal(one, "t", layout=TINY)
    for tf in (whole, blocks):
        out = tf.mutate(p=fam["stretch"]("y", cl.aggregate(F.product)), r=fam["stretch_dbl"]("y", span)).df.orderBy("t")
        assert [(r.p, r.r) for r in out.collect()] == [(0.0, float(k)) for k in range(5)]


def test_lambdas_of_several_aggregates_and_of_rows(small):
    span = lambda c, over: over(F.max(c)) - over(F.min(c))
    ends = lambda c, over: F.struct(over(F.min(c)).alias("lo"), over(F.max(c)).alias("hi"))
    assert column(small, fam["slide_dbl"]("y", span, size=2)) == [None, 1.0, 1.0, 1.0, 1.0]
    assert [tuple(r) for r in column(small, fam["slide"]("y", ends, size=2))[1:]] == [(k, k + 1.0) for k in range(4)]
    tiles = small.tiles(r=fam["tile"]("y", ends, size=4)).df.where("k = 'a'").orderBy("tile").collect()
    assert [tuple(t.r) for t in tiles] == [(0.0, 3.0), (4.0, 4.0)]


def levels(spark, rows=400):
    """Two series of noise on very different levels, the first drifting."""
    rnd = random.Random(4)
    out = []
    for k, level in (("high", 1e9), ("low", 0.0)):
        for i in range(rows):
            x = rnd.gauss(0, 1)
            out.append((k, dt.date(2000, 1, 1) + dt.timedelta(i), level + x, -level + 2 * x + rnd.gauss(0, 0.1)))
    return spark.createDataFrame(out, "k string, t date, x double, y double")


def test_moments_do_not_cancel_at_any_size_or_placement(spark):
    df = levels(spark)
    rows = {k: [(r.x, r.y) for r in df.where(F.col("k") == k).orderBy("t").collect()] for k in ("high", "low")}
    stamps = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    frames = {
        "short": cl.as_temporal(df, "t", ["k"], interval=cl.Interval(1, "day")),
        "mixed": cl.as_temporal(stamps, "t", ["k"], interval=None, layout=cl.Layout(hot_rows=20, block=16)),
    }
    calls = {f"sd{n}": fam["slide_dbl"]("x", "sd", size=n) for n in (64, 65, 90)}
    calls |= {f"cor{n}": fam["slide2_dbl"]("x", "y", "cor", size=n) for n in (64, 65)}
    for tf in frames.values():
        slid = tf.mutate(**calls).df
        grown = tf.mutate(sd=fam["stretch_dbl"]("x", "sd"), cov=fam["stretch2_dbl"]("x", "y", "cov")).df
        for k, values in rows.items():
            a = np.array(values)
            a = a - a.mean(0)  # numpy cancels too
            got = slid.where(F.col("k") == k).orderBy("t").collect()
            for i in range(89, len(a), 37):
                for n in (64, 65, 90):
                    assert got[i][f"sd{n}"] == pytest.approx(a[i - n + 1 : i + 1, 0].std(ddof=1), rel=1e-5)
                for n in (64, 65):
                    want = np.corrcoef(a[i - n + 1 : i + 1].T)[0, 1]
                    assert got[i][f"cor{n}"] == pytest.approx(want, rel=1e-4)
            got = grown.where(F.col("k") == k).orderBy("t").collect()
            for i in range(5, len(a), 41):
                assert got[i].sd == pytest.approx(a[: i + 1, 0].std(ddof=1), rel=1e-5)
                assert got[i].cov == pytest.approx(np.cov(a[: i + 1].T)[0, 1], rel=1e-4)


def test_one_type_at_every_size(spark):
    df = levels(spark, 80).withColumn("x", F.col("x").cast("decimal(18,2)"))
    tf = cl.as_temporal(df, "t", ["k"], interval=cl.Interval(1, "day"))
    out = tf.mutate(
        a=fam["slide"]("x", "mean", size=64), b=fam["slide"]("x", "mean", size=65), c=fam["stretch"]("x", "mean"),
        d=fam["slide"]("x", "sd", size=64), e=fam["slide"]("x", "sd", size=65),
    ).df
    assert {t for c, t in out.dtypes if c in "abcde"} == {"double"}


def test_blocks_follow_rows_not_ordinals(spark):
    from chronoloom.operators import layout

    df = spark.range(2000).select((F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id * 977)")).alias("t"))
    whole = df.select(F.unix_micros(F.col("t").cast("timestamp")).alias("t"))
    for table, interval in ((df, "auto"), (df, None), (whole, "auto")):
        tf = cl.as_temporal(table, "t", interval=interval, layout=cl.Layout(block=50))
        blocks = layout.place(tf).df.select(layout.C).distinct().count()
        assert 20 <= blocks <= 80


@pytest.mark.parametrize("key", [[], ["k"]])
def test_a_burst_is_cut_into_blocks(spark, key):
    """A third of all rows within one second of two years, another tenth within a minute: no block is long."""
    from chronoloom.operators import layout as L

    at = "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, {})"
    rows = spark.range(6000).selectExpr(
        "'a' AS k", f"CASE WHEN id % 3 = 0 THEN {at.format('31000000 + id / 6000.0')} WHEN id % 10 = 1 THEN "
        f"{at.format('2000000 + id / 100.0')} ELSE {at.format('id * 10000.0')} END AS t", "cast(id % 97 AS double) AS x",
    )
    if key:
        few = spark.range(90).selectExpr("concat('b', id % 3) AS k", f"{at.format('id * 3.0')} AS t", "1.0D AS x")
        rows = rows.union(few)
    plain = cl.as_temporal(rows, "t", ["k"], interval=None, validate=False, max_rows=10_000)
    tf = cl.as_temporal(rows, "t", key, interval=None, validate=False, layout=cl.Layout(hot_rows=1000, block=100))
    placed = L.place(tf)
    sizes = sorted(r["count"] for r in placed.df.where(L.HOT).groupBy(L.C).count().collect())
    assert 50 <= len(sizes) <= 70 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    window = dict(s=fam["stretch"]("x", "sum"), m=fam["slide_dbl"]("x", "mean", size=30))
    assert collected(tf.mutate(**window).df) == collected(plain.mutate(**window).df)
    one = cl.as_temporal(rows.where("k = 'a'"), "t", key, interval=None, validate=False, layout=cl.Layout(hot_rows=1000, block=1))
    sizes = sorted(r["count"] for r in L.place(one).df.groupBy(L.C).count().collect())
    assert sizes[-1] <= 6000 / L.CUTS * 2


def test_custom_accumulator(small):
    span = cl.Accumulator(
        {"hi": cl.Part(lambda c, o: c[0], "max"), "lo": cl.Part(lambda c, o: c[0], "min")}, lambda p: p["hi"] - p["lo"]
    )
    assert column(small, fam["stretch"]("y", span)) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert column(small, fam["slide"]("y", span, size=2)) == [None, 1.0, 1.0, 1.0, 1.0]
    assert [r.out for r in small.tiles(out=fam["tile"]("y", span, size=4)).df.orderBy("k", "tile").collect()] == [3.0, 0.0, 0.0]


def test_period_slide_is_weighted_by_rows(spark):
    days = [(dt.date(2020, 1, 31), 1.0), (dt.date(2020, 2, 1), 2.0), (dt.date(2020, 2, 29), 6.0), (dt.date(2020, 4, 1), 9.0)]
    tf = cl.as_temporal(spark.createDataFrame(days, "d date, x double"), "d")
    out = tf.slide_period(cl.yearmonth("d"), "m", 2, ma=fam["slide_dbl"]("x", "mean")).df.orderBy("d")
    # March has no rows: the two periods before April are February and April.
    assert [r.ma for r in out.collect()] == [None, 3.0, 3.0, pytest.approx(17 / 3)]


def test_mutate_reads_an_earlier_window(small):
    tf = small.mutate(a=fam["slide"]("y", "sum", size=2), b=fam["slide"]("a", "sum", size=2, na_rm=True), c=F.col("b") * 2)
    assert [r.c for r in tf.df.where("k = 'a'").orderBy("t").collect()] == [None, 2.0, 8.0, 16.0, 24.0]


def test_folds_against_every_pair(spark):
    """Slide, stretch, tile and two days, blocks or not, an input that is replaced, null keys and null results."""
    df = series(spark, 5, 3, 50)
    rows = {}
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        rows.setdefault(r["k"], []).append((r["t"], r["y"]))
    want = {"slide": {}, "stretch": {}, "two": {}}
    for k, held in rows.items():
        ys = [y for _, y in held]
        days = sorted({t.date() for t, _ in held})
        for i, (t, _) in enumerate(held):
            want["slide"][k, t] = fall(ys[max(0, i - 3) : i + 1])
            want["stretch"][k, t] = fall(ys[: i + 1]) if i >= 1 else None
            at = days.index(t.date())
            want["two"][k, t] = fall([y for u, y in held if u.date() in days[at - 1 : at + 1]]) if at else None
    for options in ({"max_rows": 1000}, {"layout": TINY}):
        tf = cl.as_temporal(df, "t", ["k"], interval=None, validate=False, **options)
        slid = tf.mutate(y=fam["slide_dbl"]("y", FALL, size=4, partial=True)).df.collect()
        assert {(r.k, r.t): round(r.y, 9) for r in slid} == {at: round(v, 9) for at, v in want["slide"].items()}
        full = tf.mutate(z=fam["stretch_dbl"]("y", FALL, init=2)).slide_period(cl.day("t"), "d", 2, w=fam["slide_dbl"]("y", FALL)).df
        for r in full.collect():
            for got, name in ((r.z, "stretch"), (r.w, "two")):
                assert got == want[name][r.k, r.t] or abs(got - want[name][r.k, r.t]) < 1e-9
    none = tf.filter(F.lit(False)).mutate(z=fam["stretch_dbl"]("y", FALL)).df
    assert none.count() == 0
    with pytest.raises(TypeError, match="promises int"):
        tf.mutate(z=fam["stretch_int"]("y", FALL))


def test_a_wide_fold_costs_as_many_merges_as_a_narrow_one():
    from chronoloom.operators.folds import _Queue

    def merges(size):
        seen = []
        body = cl.fold(int, lambda s, v: s + v, lambda a, b: seen.append(1) or a + b)
        queue, out = _Queue(body, size), []
        for x in range(20_000):
            queue.push(x)
            out.append(queue.answer())
        assert out[:3] == [0, 1, 3] and out[-1] == sum(range(20_000 - size, 20_000))
        return len(seen)

    assert merges(5_000) <= 1.1 * merges(50)


def test_a_fold_of_a_hot_series_has_no_window_over_it(spark):
    rows = spark.range(400).selectExpr("'a' AS k", "timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,0,id) AS t", "id * 1.0D AS y")
    tf = cl.as_temporal(rows, "t", ["k"], interval=None, validate=False, layout=TINY)
    plan = tf.mutate(z=fam["stretch_dbl"]("y", FALL)).df._jdf.queryExecution().executedPlan().toString()
    assert "Window " not in plan and plan.count("MapInArrow") >= 3
    opaque = tf.mutate(z=fam["stretch_dbl"]("y", cl.opaque(lambda v: float(v.sum())))).df
    assert "collect_list" not in opaque._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.z for r in opaque.collect()) == [k * (k + 1) / 2 for k in range(400)]


def counted(values, size):
    """Distinct values of each window, by looking at it."""
    return [len(set(values[max(0, i - size + 1) : i + 1])) for i in range(len(values))]


@pytest.mark.parametrize("layout", [cl.Layout(), cl.Layout(hot_rows=20, block=7)])
@pytest.mark.parametrize("keyed", [True, False])
def test_distinct_counts_equal_sets(spark, layout, keyed):
    rng = random.Random(4)
    start = dt.datetime(2020, 1, 1)
    rows = [
        (start + dt.timedelta(seconds=t * 3), k, rng.choice([None, "a", "a", "a", *"bcdefg"]), rng.randrange(2))
        for k, n in (("p", 150), (None, 60), ("q", 1)) for t in range(n)
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k string, x string, y int")
    if not keyed:
        df, rows = df.where("k = 'p'"), [r for r in rows if r[1] == "p"]
    tf = cl.as_temporal(df, "ts", ["k"] if keyed else [], interval=None, validate=False, layout=layout)
    slide, slide2, stretch = (cl.FAMILY[n] for n in ("slide", "slide2_int", "stretch"))
    out = tf.mutate(
        five=slide("x", "n_distinct", size=5, partial=True), wide=slide("x", "n_distinct", size=40),
        pair=slide2("x", "y", "n_distinct", size=5, partial=True), y=slide("y", "sum", size=5, partial=True),
    )
    out = out.mutate(all=stretch("x", "n_distinct", init=3))
    found = {}
    for r in out.df.orderBy("ts").collect():
        found.setdefault(r["k"], []).append(r)
    for k, got in found.items():
        own = [r for r in rows if r[1] == k]
        x, pairs = [r[2] for r in own], [r[2:] for r in own]
        assert [r["five"] for r in got] == counted(x, 5)
        assert [r["wide"] for r in got] == [n if i >= 39 else None for i, n in enumerate(counted(x, 40))]
        assert [r["pair"] for r in got] == counted(pairs, 5)
        assert [r["all"] for r in got] == [n if i >= 2 else None for i, n in enumerate(counted(x, len(x)))]
        assert [r["y"] for r in got] == [sum(p[1] for p in pairs[max(0, i - 4) : i + 1]) for i in range(len(got))]
    assert sum(map(len, found.values())) == len(rows)


def test_distinct_count_in_place_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, d), d % 2) for d in range(1, 8)], "day date, x int")
    slide = cl.FAMILY["slide"]
    for rows, expected in ((df, [(1, 0), (2, 1), (2, 2), (2, 1), (2, 2), (2, 1), (2, 2)]), (df.where("x > 5"), [])):
        tf = cl.as_temporal(rows, "day", interval=cl.Interval(1, "day"), validate=False)
        out = tf.mutate(s=slide("x", "sum", size=3, partial=True), x=slide("x", "n_distinct", size=3, partial=True)).df
        assert [r["x"] for r in out.orderBy("day").collect()] == [a for a, _ in expected]
    assert out.columns == ["day", "s", "x"]


LISTED = cl.fold(list, lambda s, v: s + v.tolist(), lambda a, b: a + b, str, "string")


@pytest.mark.parametrize("key, options", [(None, {"layout": cl.Layout(block=4)}), (["k"], {"layout": cl.Layout(hot_rows=8, block=4)}), (["k"], {})])
def test_ties_order_observations_of_one_instant(spark, key, options):
    rnd = random.Random(5)
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in (0, 1, 1, 1, 1, 1, 1, 7, 7, 60) * 3]
    rows = [(f"k{i % 2}" if key else "k", t, i, rnd.randrange(50)) for i, t in enumerate(at)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id int, x int").repartition(5)
    with pytest.raises(ValueError, match="identify a row"):
        cl.as_temporal(df, "t", key, **options)
    with pytest.raises(ValueError, match="ties not in the table"):
        cl.as_temporal(df, "t", key, ties=["none"], **options)
    tf = cl.as_temporal(df, "t", key, ties=["id"], **options)
    assert tf.meta.interval == cl.Interval(1, "second")
    with pytest.raises(ValueError, match="identify a row"):
        cl.as_temporal(df.union(df.limit(1)), "t", key, ties=["id"], **options)
    tf = tf.mutate(s=fam["slide"]("x", "sum", size=3), l=fam["slide"]("x", size=2), f=fam["slide"]("x", LISTED, size=4))
    tf = tf.mutate(n=fam["stretch"]("x", "length"), a=fam["stretch"]("x"), g=fam["stretch"]("x", LISTED))
    want = []
    for k in sorted({r[0] for r in rows}):
        xs = sorted((t, i, x) for j, t, i, x in rows if j == k)
        for p, (_, i, x) in enumerate(xs):
            past = [v for _, _, v in xs[: p + 1]]
            last = lambda n: past[-n:] if len(past) >= n else None  # noqa: B023, E731
            want.append((i, last(3) and sum(last(3)), last(2), last(4) and str(last(4)), p + 1, past, str(past)))
    got = tf.df.select("id", "s", "l", "f", "n", "a", "g").collect()
    assert sorted(map(tuple, got)) == sorted(want)

"""Every registered query against its SQL, and the published facts about the test tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# A query without SQL is held against plain Python by a test of its own.
@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert ok, note


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["channel", "category", "year", "annual_volume", "share"] and df.count() > 0


def test_known_counts(spark):
    from pyspark.sql import functions as F

    from chronoloom.operators.gaps import count_gaps, fill_size
    from chronoloom.plans import star
    from chronoloom.plans.analysis import annual, channel_share

    sf = "/root/testdata/sf0.01"
    tf = star.enquiries(spark, sf)
    size = fill_size(tf).first()
    assert (size.n_rows, size.n_filled, fill_size(tf, full=True).first().n_filled) == (14_589, 295_403, 300_625)
    gaps = count_gaps(tf).agg(F.count("n"), F.sum("n")).first()
    assert tuple(gaps) == (13_714, 280_814)
    by = tf.group_by("channel", "category")
    assert tuple(by.count_gaps().agg(F.count("n"), F.sum("n")).first()) == (10_251, 46_665)
    assert tuple(by.count_gaps(full=True).agg(F.count("n"), F.sum("n")).first()) == (10_297, 46_864)
    yearly = annual(star.filled(spark, sf, volume=0, value=0)).df.where("channel = 'AUTOMOBILE' and category = 'AFRICA'")
    assert [r.annual_volume for r in yearly.orderBy("year").collect()] == [101, 114, 94, 85, 115, 116, 52]
    share = channel_share(star.filled(spark, sf, volume=0, value=0)).df
    first = share.where("channel = 'AUTOMOBILE' and category = 'AFRICA' and year = 1995").first().share
    assert first == pytest.approx(101 / 441)

"""The cleaning job, on hand-written records with every rule exercised."""

import datetime as dt

import chronoloom as cl
from chronoloom.plans.etl import RAW_SCHEMA, TidyRules, load, tidy

HEADER = "Date,Service,Category,Channel,Work Site,Volume\n"
CALLS = [
    "1/2/2014,Signs,Building Control Services,Phone - inbound call,Call Centre,3",
    "1/2/2014,Signs,Building Control Services,Phone,Call Centre,2",
    "2/2/2014,Signs,Building Control Services,e-mail,Call Centre,1",
    "2/2/2014,Dogs,Animal Control,WEB,Call Centre,4",
    "2/2/2014,Dogs,Animal Control,Online form,Call Centre,5",
    "2/2/2014,Dogs,Animal Control,SMS,Call Centre,6",
    "2/2/2014,Native Species Programs,Trees,Phone,Call Centre,7",
    "2/2/2014,Animal Control,Animal Control,Phone,Call Centre,50",  # a category equal to its service
    "3/2/2014,Shops,Commercial Services,Phone,Call Centre,60",
    "3/2/2014,Rare,Small Matters,Phone,Call Centre,1",  # outside the largest categories
    "4/2/2014,Dogs,Animal Control,Phone,Front Desk,99",  # another site
    "not a date,Dogs,Animal Control,Phone,Call Centre,1",
]


def tidied(spark, tmp_path, **options):
    (tmp_path / "one.csv").write_text(HEADER + "\n".join(CALLS[:6]) + "\n")
    (tmp_path / "two.csv").write_text(HEADER + "\n".join(CALLS[6:]) + "\n")
    raw = cl.read_csv_files(spark, str(tmp_path), RAW_SCHEMA, pattern="*csv*")
    return tidy(raw, TidyRules(top_categories=4), **options)


def test_every_rule(spark, tmp_path):
    day = lambda d: dt.date(2014, 2, d)
    want = {
        (day(1), "Phone", "Built Structure Control", "Signs", 5),
        (day(2), "Email", "Built Structure Control", "Signs", 1),
        (day(2), "Online", "Animal Control", "Dogs", 9),
        (day(2), "Other", "Animal Control", "Dogs", 6),
        (day(3), "Phone", "Other", "Shops", 60),
        (day(3), "Phone", "Other", "Other", 1),
        (None, "Phone", "Animal Control", "Dogs", 1),
    }
    # "Native Species Programs" becomes Other within Other, and leaves with the rows whose names agree.
    assert {tuple(r) for r in tidied(spark, tmp_path).collect()} == want
    assert {tuple(r) for r in tidied(spark, tmp_path, stage=False).collect()} == want


def test_load_drops_and_sorts_levels(spark, tmp_path):
    got = [(r.service, r.category, r.channel) for r in load(tidied(spark, tmp_path)).collect()]
    assert got == [
        ("Dogs", "Animal Control", "Online"),
        ("Dogs", "Animal Control", "Phone"),
        ("Shops", "Other", "Phone"),
        ("Signs", "Built Structure Control", "Email"),
        ("Signs", "Built Structure Control", "Phone"),
        ("Other", "Other", "Phone"),
    ]

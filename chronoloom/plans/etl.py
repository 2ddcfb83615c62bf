"""From raw call records in CSV files to the tidy table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cut_at_blank, if_else, is_in, parse_dmy, recode
from ..operators.levels import LevelOrder, lump_drop, lump_keep
from ..operators.relational import sort_columns, top_k
from ..sources.storage import lower_names, staged

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Service", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Channel", T.StringType()),
        T.StructField("Work Site", T.StringType()),
        T.StructField("Volume", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class TidyRules:
    """Fixed values of the cleaning rules; a table with other labels passes its own."""

    work_site: str = "Call Centre"
    channel_names: Mapping[str, str] = field(default_factory=lambda: {"e-mail": "Email", "WEB": "Web"})
    category_names: Mapping[str, str] = field(
        default_factory=lambda: {"Building Control Services": "Built Structure Control"}
    )
    services_to_other: tuple[str, ...] = ("Native Species Programs",)
    top_categories: int = 11
    categories_to_other: tuple[str, ...] = ("Commercial Services",)
    online_channels: tuple[str, ...] = ("Online", "Web")
    online: str = "Online"
    channels_to_other: tuple[str, ...] = ("SMS", "Fax", "Face2Face")
    other: str = "Other"


def clean(raw: DataFrame) -> DataFrame:
    """Lower-case names, one word for the site, and a real date."""
    df = lower_names(raw).withColumnRenamed("work site", "work_site")
    return df.withColumn("date", parse_dmy("date"))


def counted(cleaned: DataFrame, rules: TidyRules) -> DataFrame:
    """One site, unified channel names, summed per day and label, with the first recodes."""
    df = cleaned.where(F.col("work_site") == rules.work_site)
    df = df.withColumn("channel", recode(cut_at_blank("channel"), rules.channel_names))
    df = df.groupBy("date", "service", "category", "channel").agg(F.sum("volume").alias("volume"))
    moved = is_in("service", rules.services_to_other)
    # Both columns follow the old service, so the category is set before the service is overwritten.
    df = df.withColumn("category", recode("category", rules.category_names))
    df = df.withColumn("category", if_else(moved, rules.other, F.col("category")))
    return df.withColumn("service", if_else(moved, rules.other, F.col("service")))


def kept_services(df: DataFrame, rules: TidyRules) -> DataFrame:
    """Services of the categories with the largest volume."""
    volumes = df.groupBy("category").agg(F.sum("volume").alias("volume"))
    # Exactly `top_categories` rows at most: safe to broadcast whatever the table's size.
    top = F.broadcast(top_k(volumes, "volume", rules.top_categories, ["category"]).select(F.col("category").alias("top")))
    return df.join(top, df["category"].eqNullSafe(top["top"]), "left_semi").select("service").distinct()


def tidy(raw: DataFrame, rules: TidyRules | None = None, stage: bool = True) -> DataFrame:
    """The whole cleaning: date, channel, category, service, volume.

    The counted table is read three times (ranking, kept services, result). ``stage`` writes it once to
    the shared folder, so the raw files are scanned a single time.
    """
    rules = rules or TidyRules()
    df = counted(clean(raw), rules)
    df = staged(df) if stage else df
    keep = kept_services(df, rules)
    other = rules.other
    # The kept set was taken before this filter.
    df = df.where(F.col("service") != F.col("category"))
    df = lump_keep(df, "service", keep, other)
    df = df.withColumn("category", if_else(F.col("service") == other, other, F.col("category")))
    df = df.withColumn("category", if_else(is_in("category", rules.categories_to_other), other, F.col("category")))
    df = df.withColumn("channel", if_else(is_in("channel", rules.online_channels), rules.online, F.col("channel")))
    df = lump_drop(df, "channel", rules.channels_to_other, other)
    return df.groupBy("date", "channel", "category", "service").agg(F.sum("volume").alias("volume"))


def load(tidied: DataFrame, rules: TidyRules | None = None) -> DataFrame:
    """The analysis input: no lumped channel, sorted by service, category, channel and date, with the
    lumped level after all others."""
    other = (rules or TidyRules()).other
    order = LevelOrder(last=(other,))
    df = tidied.where(F.col("channel") != other)
    columns = [c for name in ("service", "category", "channel") for c in order.sort_columns(name)]
    return df.orderBy(*columns, *sort_columns(["date"]))

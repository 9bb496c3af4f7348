"""Queries of a dashboard over compared units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filters, badges and colours by level and difference.
FILTERS = {"critical": ("CRITICAL",), "significant": ("SIGNIFICANT", "CRITICAL"), "any": ("MINOR", "SIGNIFICANT", "CRITICAL"), "pending": ("PENDING",)}
BADGES = {"IDENTICAL": "matching", "MINOR": "minor", "SIGNIFICANT": "significant", "CRITICAL": "critical"}


def level_filter(units: DataFrame, name: str, province: str | None = None) -> DataFrame:
    """Units of a filter's levels (a filter includes all that is worse), of one province if named."""
    rows = units.where(F.col("level").isin(*FILTERS[name]))
    return rows if province is None else rows.where(F.col("province") == province)


def difference_band(difference: Column) -> Column:
    return F.when(difference == 0, "none").when(difference < 100, "low").when(difference < 1000, "medium").otherwise("high")


def badge(level: Column) -> Column:
    pairs = [F.lit(x) for pair in BADGES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit("pending"))


def timeline(df: DataFrame, time: str, critical: Column) -> DataFrame:
    """(day, compared, critical_found), by day."""
    days = df.groupBy(F.to_date(time).alias("day"))
    return days.agg(F.count("*").alias("compared"), F.count_if(critical).alias("critical_found")).orderBy("day")


def collated(df: DataFrame, name: str, collation: str = "th") -> DataFrame:
    """Distinct names in a language's order."""
    return df.select(name).distinct().orderBy(F.expr(f"`{name}` collate {collation}"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 0) of a listing; the order should be total."""
    return df.orderBy(*order).offset(number * size).limit(size)

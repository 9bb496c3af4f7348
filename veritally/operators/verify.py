"""Ad-hoc checks of a results table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import stats


def turnout_over(df: DataFrame, cast: str, eligible: str, threshold: float = 0.95) -> DataFrame | None:
    """Rows whose turnout_rate (percent) is over the threshold; None if a column is missing.

    Votes without eligible voters are an infinite rate, 0 of 0 is none.
    """
    if not {cast, eligible} <= set(df.columns):
        return None
    a, b = F.col(cast).cast("double"), F.col(eligible).cast("double")
    rate = F.when(b != 0, a / b * 100).when(a > 0, float("inf"))
    return df.withColumn("turnout_rate", rate).where(F.col("turnout_rate") > threshold * 100)


def value_outliers(df: DataFrame, value: str) -> DataFrame:
    """Rows outside the quartile fences of a raw measure, with side (low or high)."""
    q1, q3 = stats.exact_quantiles(df, value, (0.25, 0.75))
    if q1 is None:
        return df.withColumn("side", F.lit(None).cast("string")).limit(0)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    x = F.col(value)
    side = F.when(stats.outside(x, low, None), "low").when(stats.outside(x, None, high), "high")
    return df.withColumn("side", side).where("side is not null")


def consistency_diff(first: DataFrame, second: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, value_1, value_2, difference) where two versions of a record disagree.

    Values are compared as text, so any type will do; difference is their
    absolute distance where both are numbers.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(list(keys), list(fields), "field", name)

    both = long(first, "value_1").join(long(second, "value_2"), [*keys, "field"])
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return both.where(~F.col("value_1").eqNullSafe(F.col("value_2"))).withColumn("difference", F.abs(number("value_1") - number("value_2")))


def timing_correlation(df: DataFrame, distance: Column, time: Column) -> DataFrame:
    """One row: rows, correlation of distance and time, warning if it is negative."""
    pairs = df.select(stats.clean(distance.cast("double")).alias("x"), stats.clean(time.cast("double")).alias("y"))
    one = pairs.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("rows"), stats.safe_correlation("x", "y").alias("correlation"))
    return one.withColumn("warning", F.coalesce(F.col("correlation") < 0, F.lit(False)))


def structure(df: DataFrame, group: str) -> DataFrame:
    """One row: rows and distinct groups (exact)."""
    return df.agg(F.count("*").alias("total"), F.count_distinct(group).alias("groups"))


def largest_groups(df: DataFrame, group: str, limit: int = 10) -> DataFrame:
    """The ``limit`` groups with the most rows, ties by name."""
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(limit)

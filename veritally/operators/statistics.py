"""Statistical tests of a column of votes, and swings between two counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.operators.anomalies import benford_test

# Limits beyond which a pattern is suspicious, and rows that tests need.
ROUND_SHARE = 20
LEAST_VARIATION = 10
LINEAR = 0.95
LINEAR_ROWS = 10
BENFORD_ROWS = 30


def round_numbers(df: DataFrame, votes: str) -> DataFrame:
    """One row: total, round_count (multiples of 50, 0 included), round_pct, round_suspicious."""
    one = df.agg(F.count(votes).alias("total"), F.count_if(F.col(votes) % 50 == 0).alias("round_count"))
    pct = F.coalesce(F.try_divide(F.col("round_count"), F.col("total")) * 100, F.lit(0.0))
    return one.withColumn("round_pct", pct).withColumn("round_suspicious", F.col("round_pct") > ROUND_SHARE)


def variation(df: DataFrame, votes: str) -> DataFrame:
    """One row: mean, variance, stdev (of the population), cv in percent (null if the mean is 0), cv_suspicious."""
    x = stats.clean(F.col(votes).cast("double"))
    one = df.select(x.alias("x")).agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.stddev_pop("x").alias("stdev"))
    return one.withColumn("cv", F.try_divide(F.col("stdev"), F.col("mean")) * 100).withColumn("cv_suspicious", F.coalesce(F.col("cv") < LEAST_VARIATION, F.lit(False)))


def linear_pattern(df: DataFrame, votes: str, order: str) -> DataFrame:
    """One row: rows, correlation of the votes with their place in ``order``, linear_suspicious.

    Null under ten rows or where the votes are constant, and then not suspicious.
    """
    numbered = stats.with_ordinal(df.select(order, F.col(votes).cast("double").alias("x")), order, "x")
    one = numbered.withColumn("ordinal", F.col("ordinal").cast("double")).agg(F.count("*").alias("rows"), stats.safe_correlation("ordinal", "x").alias("r"))
    r = F.when(F.col("rows") >= LINEAR_ROWS, F.col("r"))
    return one.select("rows", r.alias("correlation"), F.coalesce(F.abs(r) > LINEAR, F.lit(False)).alias("linear_suspicious"))


def stuffing_patterns(df: DataFrame, votes: str, order: str) -> DataFrame:
    """One row that joins the three patterns above."""
    return round_numbers(df, votes).crossJoin(variation(df, votes)).crossJoin(linear_pattern(df, votes, order))


def risk_report(df: DataFrame, votes: str, order: str) -> DataFrame:
    """One row: the first-digit test (30 rows at least), the patterns, risk_flags and risk_level.

    Flags are a violated first-digit law, round numbers and too little
    variation; the linear pattern is reported but not counted.
    """
    whole = df.select(order, F.col(votes), stats.clean(F.col(votes).cast("double")).cast("bigint").alias("_votes")).where("_votes is not null")
    test = benford_test(whole, "_votes", least=1, least_rows=BENFORD_ROWS).select("chi_square", "p_value", "conforms", "valid")
    rows = test.crossJoin(stuffing_patterns(df, votes, order))
    on = lambda c: F.when(c, 1).otherwise(0)
    n = on(~F.coalesce("conforms", F.lit(True))) + on(F.col("round_suspicious")) + on(F.col("cv_suspicious"))
    level = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.col("risk_flags") + 1)
    return rows.withColumn("risk_flags", n).withColumn("risk_level", level)


def swings(now: DataFrame, before: DataFrame, key: str, votes: str = "votes") -> DataFrame:
    """(key, votes_current, votes_historical, swing_pct) of the keys both have.

    From 0 votes the swing is infinite, from 0 to 0 it is null.
    """
    a, b = now.select(key, F.col(votes).alias("votes_current")), before.select(key, F.col(votes).alias("votes_historical"))
    x, y = F.col("votes_current").cast("double"), F.col("votes_historical").cast("double")
    swing = F.when(y != 0, (x - y) / y * 100).when(x > 0, float("inf")).when(x < 0, float("-inf"))
    return a.join(b, key).withColumn("swing_pct", swing)


def swing_summary(swings: DataFrame) -> DataFrame:
    """One row: count, mean, median, lower_fence, upper_fence and outliers of the swings.

    Infinite swings count: they may make the mean or a fence infinite; a fence
    that is no number (between two infinities) makes no outliers.
    """
    q1, q2, q3 = stats.exact_quantiles(swings, "swing_pct", (0.25, 0.5, 0.75))
    if q1 is None:
        q1 = q2 = q3 = float("nan")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    s = F.col("swing_pct")
    return swings.agg(F.count(s).alias("count"), F.avg(s).alias("mean"), F.lit(q2).alias("median"), F.lit(low).alias("lower_fence"), F.lit(high).alias("upper_fence"), F.count_if(stats.outside(s, low, high)).alias("outliers"))


def swing_outliers(swings: DataFrame) -> DataFrame:
    """The rows outside the fences of all swings."""
    q1, q3 = stats.exact_quantiles(swings, "swing_pct", (0.25, 0.75))
    if q1 is None:
        return swings.limit(0)
    return swings.where(stats.outside(F.col("swing_pct"), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))

"""Anomaly analyses over a table of counting units.

A unit table has a row for each unit.  Analyses name the columns they read, so
any table with such measures will do; candidates come as a table of their own
(unit, name, votes, rank) and not as arrays, so that Spark prunes and shuffles
only what an analysis needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.functions.shared import checkpoint

# Limits of the analyses and of the flags' severities, in percent (z: deviations).
EXTREME_SHARE = 60
CLOSE_MARGIN = 3
VARIATION = 10
SEVERE = {"turnout": 3, "invalid": 8, "blank": 10, "wasted": 20, "dominance": 70}


def rated(df: DataFrame, part: str, whole: str, name: str = "rate") -> DataFrame:
    """Rows with a positive ``whole`` and the rounded rate of ``part``."""
    return df.where(F.col(whole) > 0).withColumn(name, stats.rate(F.coalesce(part, F.lit(0)), F.col(whole)))


def fenced(df: DataFrame, value: str, two_sided: bool = False, wide: bool = False) -> DataFrame:
    """Adds z, is_outlier and flag (low, high or normal) from the column's own fences.

    ``wide``: the column is no share of a whole and may have any number of distinct
    values, of two places.  Its rows are then kept by a checkpoint, so that what they
    are made of is worked out once.
    """
    x = F.col(value)
    if wide:
        df = checkpoint(df)
        found = stats.unit_fences(stats.unit_counts(df, value))
        low, high, mean, deviation = (F.lit(found[k]).cast("double") for k in ("lower_fence", "upper_fence", "mean", "stdev"))
        out = df
    else:
        out = df.crossJoin(F.broadcast(stats.fence_summary(df, value).select("mean", "stdev", "lower_fence", "upper_fence")))
        low, high, mean, deviation = (F.col(k) for k in ("lower_fence", "upper_fence", "mean", "stdev"))
    label = F.when(x > high, "high")
    label = (label.when(x < low, "low") if two_sided else label).otherwise("normal")
    out = out.withColumn("flag", label).withColumn("z", stats.z_score(x, mean, deviation)).withColumn("is_outlier", F.col("flag") != "normal")
    return out if wide else out.drop("mean", "stdev", "lower_fence", "upper_fence")


def rate_outliers(df: DataFrame, part: str, whole: str) -> DataFrame:
    """The units whose rate lies over the upper fence of all units' rates."""
    return fenced(rated(df, part, whole), "rate").where("is_outlier")


def rate_flags(df: DataFrame, parts: Mapping[str, str], whole: str, unit: str) -> DataFrame:
    """Flags (see :func:`flags`) of several rates of one unit table over their upper fences.

    ``parts``: category -> column.  All fences come from one aggregate, all flags from one pass.
    """
    rows = df.where(F.col(whole) > 0).select(unit, *[stats.rate(F.coalesce(part, F.lit(0)), F.col(whole)).alias(category) for category, part in parts.items()])
    summary = stats.fence_summary(rows, *parts)
    limits = summary.select(*[F.col("upper_fence" if len(parts) == 1 else f"{c}.upper_fence").alias(f"_{c}") for c in parts])
    over = [F.when(F.col(c) > F.col(f"_{c}"), F.struct(F.lit(c).alias("category"), F.col(c).alias("rate"), F.lit(float(SEVERE[c])).alias("severe"))) for c in parts]
    found = rows.crossJoin(F.broadcast(limits)).select(unit, F.explode(F.array_compact(F.array(*over))).alias("x")).select(unit, "x.*")
    detail = F.concat("category", F.lit(" "), F.format_number("rate", 2), F.lit("%"))
    severity = F.when(F.col("rate") > F.col("severe"), "high").otherwise("medium")
    return found.select(F.col(unit).cast("string").alias("unit_id"), "category", F.lit("high").alias("flag"), F.col("rate").alias("value"), detail.alias("detail"), severity.alias("severity"))


def fence_report(df: DataFrame, value: str, two_sided: bool = False, wide: bool = False) -> DataFrame:
    """One row: the summary of a rounded column, to two places, and how many rows are outliers.

    ``wide`` (see :func:`fenced`): all of it from the counts of the column's values.
    """
    if wide:
        counts = stats.unit_counts(df, value)
        found = stats.unit_fences(counts)
        summary = df.sparkSession.createDataFrame([tuple(found[k] for k in stats.FENCES)], ", ".join(f"{k} {'long' if k == 'total' else 'double'}" for k in stats.FENCES))
        rows = counts.select((F.col("unit") / 100.0).alias(value), "n")
    else:
        summary, rows = stats.fence_summary(df, value), df.select(value, F.lit(1).alias("n"))
    outside = F.col(value) > F.col("upper_fence")
    outside = outside | (F.col(value) < F.col("lower_fence")) if two_sided else outside
    count = rows.crossJoin(F.broadcast(summary)).agg(F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count"))
    rounded = [stats.round_half_up(c, 2).alias(c) for c in ("mean", "median", "stdev", "q1", "q3", "iqr", "lower_fence", "upper_fence")]
    return summary.select(*rounded, "total").crossJoin(F.broadcast(count))


def first_two(candidates: DataFrame, unit: str, order: Sequence[Column], votes: str, name: str) -> DataFrame:
    """(unit, winner, winner_votes, second, second_votes): the first half of :func:`leaders`, for units whose totals are known."""
    rank = Window.partitionBy(unit).orderBy(*order)
    first = candidates.withColumn("_r", F.row_number().over(rank)).where("_r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    return first.groupBy(unit).agg(pick(1, name).alias("winner"), pick(1, votes).alias("winner_votes"), pick(2, name).alias("second"), pick(2, votes).alias("second_votes"))


def leaders(candidates: DataFrame, unit: str, order: Sequence[Column], votes: str, name: str) -> DataFrame:
    """(unit, winner, winner_votes, second, second_votes, n_candidates, total_votes).

    The two first of each unit in the given order.  Spark limits each unit to two
    rows before the shuffle of the window, and sums partially before that of the
    totals, so that a unit with most of the rows is no hot group.
    """
    top = first_two(candidates, unit, order, votes, name)
    totals = candidates.groupBy(unit).agg(F.count("*").alias("n_candidates"), F.sum(votes).alias("total_votes"))
    return top.join(totals, unit)


def winner_dominance(units: DataFrame, valid: str = "total_votes") -> DataFrame:
    """Adds winner_pct, margin_pct (0 without a second) and is_extreme to units with a winner."""
    won = units.where((F.col(valid) > 0) & (F.col("winner_votes") > 0))
    lead = F.when(F.col("second_votes").isNull(), 0.0).otherwise(stats.rate(F.col("winner_votes") - F.col("second_votes"), F.col(valid)))
    share = stats.rate(F.col("winner_votes"), F.col(valid))
    return won.withColumn("winner_pct", share).withColumn("margin_pct", lead).withColumn("is_extreme", F.col("winner_pct") > EXTREME_SHARE)


def close_races(units: DataFrame, valid: str = "total_votes", limit: float = CLOSE_MARGIN) -> DataFrame:
    """Units with two candidates or more whose margin is below ``limit`` percent (it may be negative)."""
    fought = units.where((F.col("n_candidates") >= 2) & (F.col(valid) > 0))
    margin = fought.withColumn("margin_votes", F.col("winner_votes") - F.col("second_votes"))
    return margin.withColumn("margin_pct", stats.rate(F.col("margin_votes"), F.col(valid))).where(F.col("margin_pct") < limit)


def counting_progress(units: DataFrame, counted: str, total: str) -> DataFrame:
    """Adds remaining and percent_count; missing counts are 0."""
    c, t = F.coalesce(counted, F.lit(0)), F.coalesce(total, F.lit(0))
    return units.withColumn("remaining", t - c).withColumn("percent_count", F.coalesce(stats.rate(c, t), F.lit(0.0)))


def progress_summary(progress: DataFrame, paused: Column) -> DataFrame:
    """One row: total, complete, incomplete and paused units."""
    pct = F.col("percent_count")
    return progress.agg(F.count("*").alias("total"), F.count_if(pct >= 100).alias("complete"), F.count_if(pct < 100).alias("incomplete"), F.count_if(F.coalesce(paused, F.lit(False))).alias("paused"))


def sum_errors(units: DataFrame, parts: Column, whole: Column, whole_positive: bool = True, tolerance: float = 0.0) -> DataFrame:
    """Rows whose parts don't add up: difference (over ``tolerance``) and its percentage of the whole."""
    rows = units.where(whole > 0) if whole_positive else units
    rows = rows.withColumn("difference", F.abs(parts - whole))
    return rows.where(F.col("difference") > tolerance).withColumn("pct_diff", stats.rate(F.col("difference"), whole))


def benford_digits(df: DataFrame, value: str, least: float = 10) -> DataFrame:
    """Nine rows (digit, observed_count, observed_pct, expected_pct, deviation), rounded, and unrounded shares."""
    digits = df.where(F.col(value) >= least).select(stats.first_digit(F.col(value)).alias("digit"))
    counts = digits.groupBy("digit").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    nine = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    rows = nine.join(counts, "digit", "left").crossJoin(F.broadcast(total))
    observed = F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")), F.lit(0.0))
    expected = stats.benford_share(F.col("digit"))
    return rows.select(
        "digit",
        F.coalesce("n", F.lit(0)).alias("observed_count"),
        stats.round_half_even(observed * 100).alias("observed_pct"),
        stats.round_half_even(expected * 100).alias("expected_pct"),
        stats.round_half_even((observed - expected) * 100).alias("deviation"),
        "total",
        expected.alias("expected_share"),
    )


def benford_test(df: DataFrame, value: str, least: float = 10, least_rows: int = 0) -> DataFrame:
    """One row: total, chi_square, critical_value, passes, p_value, conforms, interpretation, valid.

    passes compares the unrounded statistic with the 5 % point; conforms asks
    for a p-value over 0.05.  With fewer than ``least_rows`` numbers the test is
    not valid and its results are null; without numbers the statistic is 0.
    """
    rows = benford_digits(df, value, least)
    wanted = F.col("total") * F.col("expected_share")
    term = F.coalesce(F.try_divide((F.col("observed_count") - wanted) * (F.col("observed_count") - wanted), wanted), F.lit(0.0))
    one = rows.agg(F.max("total").alias("total"), F.sum(term).alias("x")).withColumn("valid", F.col("total") >= least_rows)
    one = one.withColumn("x", F.when(F.col("valid"), F.col("x"))).withColumn("p", stats.chi_square_tail_8(F.col("x")))
    meaning = F.when(F.col("p") > 0.05, "conforms").when(F.col("p") > 0.01, "suspicious").when(F.col("p").isNotNull(), "violates")
    return one.select("total", F.col("x").alias("chi_square"), F.lit(stats.CHI_SQUARE_5_PERCENT).alias("critical_value"), (F.col("x") < stats.CHI_SQUARE_5_PERCENT).alias("passes"), F.col("p").alias("p_value"), (F.col("p") > 0.05).alias("conforms"), meaning.alias("interpretation"), "valid")


def province_patterns(units: DataFrame, province: str, winner: str, turnout_pct: str, invalid: str, turn_out: str, order: str, ordered: bool = True) -> DataFrame:
    """Provinces that one party holds (three units or more) or, else, whose turnout varies widely.

    Provinces that one party holds come first, those with the most units first.
    The dominant party is the most frequent winner; ties go to the one seen first
    in ``order``.  Units without a winner don't count there, but all units with
    a turnout do in the averages: invalid rates unrounded, of units with a
    positive ``turn_out``, and positive turnout percentages.  Provinces without a
    winner are left out.  Averages are exact, whatever the order of the rows.
    ``ordered`` False: in any order, for what counts them or orders them itself.
    """
    won = units.where(F.col(winner).isNotNull() & (F.col(winner) != ""))
    by_party = won.groupBy(province, winner).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.max_by(F.struct(F.col(winner).alias("party"), F.col("n").alias("count")), F.struct(F.col("n"), -F.col("seen")))
    parties = by_party.groupBy(province).agg(F.sum("n").alias("total_cons"), F.count("*").alias("unique_winners"), best.alias("best"))
    came = F.when(F.col(turnout_pct) > 0, F.col(turnout_pct))
    share = F.when(F.col(turn_out) > 0, F.col(invalid) / F.col(turn_out) * 100)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    rates = units.groupBy(province).agg(zero(stats.exact_mean(came, 1), "avg_turnout"), zero(stats.exact_deviation(came, 1), "turnout_stdev"), zero(stats.exact_mean(share, 2), "avg_invalid_rate"))
    pattern = F.when((F.col("unique_winners") == 1) & (F.col("total_cons") >= 3), "monopoly").when(F.col("turnout_stdev") > VARIATION, "high_variation")
    rows = parties.join(rates, province).withColumn("pattern", pattern).where("pattern is not null")
    rows = rows.select(province, "pattern", "total_cons", "unique_winners", F.col("best.party").alias("dominant_party"), F.col("best.count").alias("dominant_count"), stats.round_half_up(F.col("best.count") / F.col("total_cons") * 100, 1).alias("dominant_pct"), "avg_turnout", "turnout_stdev", "avg_invalid_rate")
    return rows.orderBy(F.desc(F.col("pattern") == "monopoly"), F.desc("total_cons"), province) if ordered else rows


def flags(outliers: DataFrame, category: str, unit: str, value: str, severity_on: str | None = None) -> DataFrame:
    """(unit_id, category, flag, value, detail, severity) of one analysis' outliers."""
    severe = F.abs(F.col(severity_on or value)) > SEVERE[category]
    label = F.col("flag") if "flag" in outliers.columns else F.lit("extreme")
    detail = F.concat(F.lit(category), F.lit(" "), F.format_number(F.col(value), 2), F.lit("%"))
    return outliers.select(F.col(unit).cast("string").alias("unit_id"), F.lit(category).alias("category"), label.alias("flag"), F.col(value).cast("double").alias("value"), detail.alias("detail"), F.when(severe, "high").otherwise("medium").alias("severity"))


def all_flags(parts: Sequence[DataFrame]) -> DataFrame:
    """The union of the analyses' flags; a unit keeps every flag it has."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flag_lists(flags: DataFrame) -> DataFrame:
    """(unit_id, flags): each unit's flags as structs in order; a unit has at most one of each analysis."""
    own = F.struct("category", "flag", "value", "detail", "severity")
    return flags.groupBy("unit_id").agg(F.array_sort(F.collect_list(own)).alias("flags"))


def flags_by_unit(flags: DataFrame) -> DataFrame:
    """(unit_id, n_flags, categories, worst): categories in order, joined by commas.

    The number of flags of a unit is bounded by that of the analyses.
    """
    worst = F.when(F.max(F.when(F.col("severity") == "high", 1).otherwise(0)) == 1, "high").otherwise("medium")
    return flags.groupBy("unit_id").agg(F.count("*").alias("n_flags"), F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"), worst.alias("worst"))

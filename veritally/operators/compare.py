"""Reconciliation of two sources, candidate by candidate.

Both sources are tables (unit, name, votes).  A unit that either side lacks is
left out; within a unit a candidate that one side lacks counts 0 there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions import stats
from veritally.functions.stats import with_ordinal

# The names of the levels, from best to worst.
LEVELS = ("IDENTICAL", "MINOR", "SIGNIFICANT", "CRITICAL")
PROBLEMS = ("SIGNIFICANT", "CRITICAL")
# Fixed value: votes over which a candidate's difference is suspicious.
SUSPICIOUS = 10


@dataclass(frozen=True)
class Policy:
    """Limits of a difference of totals: over ``votes`` or over ``percent`` (of the
    official total) makes it SIGNIFICANT and CRITICAL; None: no such limit."""

    significant_votes: float | None = 10
    significant_percent: float | None = 0.5
    critical_votes: float | None = 50
    critical_percent: float | None = 2
    missing_is_critical: bool = True


# The policies in use; "code" decides unless another is named.
POLICIES = {
    "code": Policy(),
    "votes": Policy(10, None, 50, None, False),
    "percent": Policy(None, 1, None, 5, False),
    "guide": Policy(5, None, 20, None, False),
}


def candidate_diff(official: DataFrame, citizen: DataFrame, unit: str = "unit_id", name: str = "name", votes: str = "votes", position: str | None = None) -> DataFrame:
    """(unit, name, official_votes, citizen_votes, official_all, citizen_all, difference, status) of the units both sides have.

    A name that repeats within a unit counts with its last entry by ``position``
    (without that column: with the sum), while official_all and citizen_all sum all
    its entries for the unit's totals.  status: matching (equal, above 0),
    discrepant, missing_in_official, missing_in_citizen or empty (0 on both sides).
    """
    at = F.col(position) if position else F.lit(0)
    side = lambda df, is_official: df.select(unit, name, F.coalesce(votes, F.lit(0)).alias("_votes"), at.alias("_at"), F.lit(is_official).alias("_official"))
    both = side(official, True).unionByName(side(citizen, False))
    mine = lambda o, c: F.when(F.col("_official") == o, c)

    def counted(o: bool) -> tuple[Column, Column, Column]:
        total = F.coalesce(F.sum(mine(o, F.col("_votes"))), F.lit(0))
        last = F.coalesce(F.max_by(mine(o, F.col("_votes")), mine(o, F.col("_at"))), F.lit(0)) if position else total
        return last, total, F.count_if(F.col("_official") == o) > 0

    (x, all_x, has_x), (y, all_y, has_y) = counted(True), counted(False)
    rows = both.groupBy(unit, name).agg(x.alias("official_votes"), y.alias("citizen_votes"), all_x.alias("official_all"), all_y.alias("citizen_all"), has_x.alias("_x"), has_y.alias("_y"))
    whole = Window.partitionBy(unit)
    rows = rows.withColumn("_both", F.bool_or("_x").over(whole) & F.bool_or("_y").over(whole)).where("_both").drop("_x", "_y", "_both")
    x, y = F.col("official_votes"), F.col("citizen_votes")
    status = F.when((x == y) & (x > 0), "matching").when((x == 0) & (y > 0), "missing_in_official").when((y == 0) & (x > 0), "missing_in_citizen").when(x != y, "discrepant").otherwise("empty")
    return rows.withColumn("difference", F.abs(x - y)).withColumn("status", status)


def discrepant_parties(diff: DataFrame, unit: str = "unit_id", name: str = "name") -> DataFrame:
    """(unit, parties): each unit's differing candidates as structs by name, suspicious from SUSPICIOUS votes on; a ballot bounds them."""
    own = F.struct(F.col(name).alias("name"), F.col("official_votes").alias("official"), F.col("citizen_votes").alias("citizen"), "difference", (F.col("difference") > SUSPICIOUS).alias("suspicious"))
    return diff.where("official_votes <> citizen_votes").groupBy(unit).agg(F.array_sort(F.collect_list(own)).alias("parties"))


def details(diff: DataFrame, unit: str = "unit_id", name: str = "name") -> DataFrame:
    """(unit, matching, discrepant, missing_in_official, missing_in_citizen): names of each unit's candidates by outcome, in order."""
    x, y = F.col("official_votes"), F.col("citizen_votes")
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(name))))
    return diff.groupBy(unit).agg(
        names(F.col("status") == "matching").alias("matching"),
        names(x != y).alias("discrepant"),
        names(F.col("status") == "missing_in_official").alias("missing_in_official"),
        names(F.col("status") == "missing_in_citizen").alias("missing_in_citizen"),
    )


def level(difference: Column, total: Column, missing: Column, policy: Policy = POLICIES["code"]) -> Column:
    """Severity of a difference of totals; equal totals are IDENTICAL whatever the candidates say."""
    percent = F.coalesce(F.try_divide(difference, total) * 100, F.lit(0.0))

    def over(votes: float | None, share: float | None) -> Column:
        by_votes = difference > votes if votes is not None else F.lit(False)
        return by_votes | (percent > share) if share is not None else by_votes

    critical = over(policy.critical_votes, policy.critical_percent)
    critical = critical | (missing > 0) if policy.missing_is_critical else critical
    return F.when(difference == 0, LEVELS[0]).when(critical, LEVELS[3]).when(over(policy.significant_votes, policy.significant_percent), LEVELS[2]).otherwise(LEVELS[1])


def compare_units(diff: DataFrame, unit: str = "unit_id", policy: Policy = POLICIES["code"]) -> DataFrame:
    """A row for each unit of :func:`candidate_diff`: totals, difference, candidate_abs_diff, counts by status, level, level_rank."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    units = diff.groupBy(unit).agg(
        F.sum("official_all").alias("official_total"),
        F.sum("citizen_all").alias("citizen_total"),
        F.sum("difference").alias("candidate_abs_diff"),
        is_("matching").alias("n_matching"),
        F.count_if(F.col("official_votes") != F.col("citizen_votes")).alias("n_discrepant"),
        is_("missing_in_official").alias("n_missing_official"),
        is_("missing_in_citizen").alias("n_missing_citizen"),
    )
    units = units.withColumn("difference", F.abs(F.col("official_total") - F.col("citizen_total")))
    missing = F.col("n_missing_official") + F.col("n_missing_citizen")
    units = units.withColumn("level", level(F.col("difference"), F.col("official_total"), missing, policy))
    return units.withColumn("level_rank", level_rank(F.col("level")))


def policy_levels(units: DataFrame, policies: Mapping[str, Policy] = POLICIES) -> DataFrame:
    """(policy, level, units): compared units classified by several policies in one pass."""
    missing = F.col("n_missing_official") + F.col("n_missing_citizen")
    each = [F.struct(F.lit(name).alias("policy"), level(F.col("difference"), F.col("official_total"), missing, p).alias("level")) for name, p in policies.items()]
    return units.select(F.explode(F.array(*each)).alias("x")).groupBy("x.policy", "x.level").agg(F.count("*").alias("units"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def summarise(units: DataFrame) -> DataFrame:
    """One row: compared units, units of each level and their percentages.

    Without units all are 0: a report of nothing is a row that says so, not an error.
    """
    counts = [F.count_if(F.col("level") == x).alias(x.lower()) for x in LEVELS]
    one = units.agg(F.count("*").alias("total"), *counts)
    return one.select("total", *[x.lower() for x in LEVELS], *[F.coalesce(stats.rate(F.col(x.lower()), F.col("total")), F.lit(0.0)).alias(f"{x.lower()}_pct") for x in LEVELS])


def by_group(units: DataFrame, group: str) -> DataFrame:
    """Units, identical ones, discrepancies and critical ones of each group."""
    return units.groupBy(group).agg(F.count("*").alias("units"), F.count_if(F.col("level") == LEVELS[0]).alias("identical"), F.count_if(F.col("difference") > 0).alias("discrepancies"), F.count_if(F.col("level") == LEVELS[3]).alias("critical"))


def group_members(units: DataFrame, group: str, unit: str = "unit_id", page_rows: int = 1_000) -> DataFrame:
    """(group, page, units, members): each group's units in order, in numbered arrays of at most ``page_rows``; units counts the group.

    Places in a group come from one global order, so a group with most of the units
    is nested by as many tasks as it has pages.  Null groups are a group.
    """
    placed = with_ordinal(units.select(group, unit), group, unit, name="_at")
    firsts = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("units"))
    own = placed.alias("p").join(firsts.alias("f"), F.col(f"p.{group}").eqNullSafe(F.col(f"f.{group}"))).select(F.col(f"p.{group}").alias(group), unit, "units", F.floor((F.col("_at") - F.col("_first")) / page_rows).alias("page"))
    return own.groupBy(group, "page", "units").agg(F.array_sort(F.collect_list(unit)).alias("members"))


def level_members(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(level, unit, difference): the members of the groups of a chart by level, as rows; nest them at the sink."""
    return units.select("level", unit, "difference")


def level_groups(units: DataFrame) -> DataFrame:
    """(level, units, total_difference, largest): the groups of a chart by level."""
    return units.groupBy("level").agg(F.count("*").alias("units"), F.sum("difference").alias("total_difference"), F.max("difference").alias("largest"))


def notes(units: DataFrame) -> DataFrame:
    """Adds has_discrepancy, priority (high for critical units) and note (null without a difference)."""
    d, lv = F.col("difference"), F.col("level")
    text = F.concat(lv, F.lit(": "), F.format_number(d, 0), F.lit(" votes apart"))
    return units.withColumn("has_discrepancy", d > 0).withColumn("priority", F.when(lv == LEVELS[3], "high")).withColumn("note", F.when(d > 0, text))


def problem_groups(units: DataFrame, places: DataFrame, unit: str, group: str, limit: int = 10) -> DataFrame:
    """The ``limit`` groups with the most units of level SIGNIFICANT or worse (ties by name)."""
    bad = units.where(F.col("level").isin(*PROBLEMS)).select(unit)
    counts = places.join(bad, unit, "left_semi").groupBy(group).agg(F.count("*").alias("problem_units"))
    return counts.orderBy(F.desc("problem_units"), group).limit(limit)

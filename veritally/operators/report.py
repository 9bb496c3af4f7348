"""The nested anomaly report: every analysis' summary, histogram and first findings in one document.

A unit's measures are worked out once and kept, a row a unit; from there they become
rows (section, unit, value).  All summaries, quartiles and histograms come from one table of counts by section and value; the
findings of each section are cut to the first ``top`` in every task before they
meet, so nothing sorts a section, and the document's size depends on the number
of sections, edges and ``top`` alone.  All flags as rows stay a table beside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.functions import stats
from veritally.functions.shared import checkpoint
from veritally.operators import anomalies
from veritally.sources.schemas import LONG, REAL, TEXT, record

BIN = record(label=TEXT, count=LONG)
FINDING = record(unit_id=TEXT, value=REAL, flag=TEXT)
SECTION = record(
    name=TEXT, total=LONG, flagged=LONG, mean=REAL, median=REAL, stdev=REAL, q1=REAL, q3=REAL, lower_fence=REAL, upper_fence=REAL,
    histogram=T.ArrayType(BIN), findings=T.ArrayType(FINDING),
)
REPORT = record(total_units=LONG, flagged_units=LONG, analysis_categories=LONG, sections=T.ArrayType(SECTION))


@dataclass(frozen=True)
class Section:
    """One measure of a unit, to two places, and what of it is a finding.

    ``value``: null where the unit takes no part.  Findings lie over the upper fence
    (``fence`` "high"), beyond either ("both"), or over ``over`` or under ``under``;
    the farthest from the median, or the highest, or with ``under`` the lowest, come
    first, ties by unit.  ``edges``: the histogram's, in percent.
    """

    name: str
    value: Column
    fence: str | None = None
    over: float | None = None
    under: float | None = None
    edges: Sequence[float] = ()


def _flag(section: Section, fences: dict, x: Column) -> Column:
    """The finding's flag, null for none."""
    if section.fence:
        high = F.when(x > fences["upper_fence"], "high")
        return high.when(x < fences["lower_fence"], "low") if section.fence == "both" else high
    return F.when(x > section.over, "over") if section.over is not None else F.when(x < section.under, "under")


def _bin(section: Section, x: Column) -> Column:
    number, last = F.lit(None).cast("int"), len(section.edges) - 2
    for i in range(last + 1):
        lo, hi = section.edges[i], section.edges[i + 1]
        number = F.when((x >= lo) & ((x <= hi) if i == last else (x < hi)), i).otherwise(number)
    return number


def sections_of(units: DataFrame, unit: str, sections: Sequence[Section], top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(a row of SECTION for each section in order, (section, unit_id, value, flag) of all findings)."""
    return _sections_of(measures(units, unit, sections), sections, top)


def measures(units: DataFrame, unit: str, sections: Sequence[Section]) -> DataFrame:
    """(unit_id, v0, v1, ...): a row a unit with each section's value, kept by a checkpoint."""
    return checkpoint(units.select(F.col(unit).cast("string").alias("unit_id"), *[stats.clean(s.value.cast("double")).alias(f"v{k}") for k, s in enumerate(sections)]))


def _sections_of(kept: DataFrame, sections: Sequence[Section], top: int) -> tuple[DataFrame, DataFrame]:
    measured = F.array(*[F.struct(F.lit(k).alias("section"), F.col(f"v{k}").alias("value")) for k in range(len(sections))])
    rows = kept.select("unit_id", F.explode(measured).alias("m")).select("unit_id", "m.section", "m.value").where("value is not null")
    counts = stats.unit_counts(rows, "value", by=["section"])
    fences = stats.grouped_unit_fences(counts, "section")
    x, own = F.col("value"), lambda make, default: _chosen(sections, make, default)
    flag = own(lambda k, s: _flag(s, fences[k], x) if k in fences else None, F.lit(None).cast("string"))
    first = own(lambda k, s: -F.abs(x - fences[k]["median"]) if s.fence == "both" and k in fences else x if s.under is not None else -x, F.lit(0.0))
    tally = counts.withColumn("value", F.col("unit") / 100.0)
    binned = tally.withColumn("flag", flag).withColumn("bin", own(lambda k, s: _bin(s, x) if s.edges else None, F.lit(None).cast("int")))
    bins = binned.groupBy("section", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("flag").isNotNull(), F.col("n")).otherwise(0)).alias("flagged"))
    spark = kept.sparkSession
    labels = spark.createDataFrame([(k, i, f"{s.edges[i]}-{s.edges[i + 1]}%") for k, s in enumerate(sections) for i in range(len(s.edges) - 1)], "section int, bin int, label string")
    filled = labels.join(bins.where("bin is not null"), ["section", "bin"], "left").groupBy("section").agg(F.array_sort(F.collect_list(F.struct("bin", "label", F.coalesce("n", F.lit(0)).alias("count")))).alias("h"))
    filled = filled.select("section", F.transform("h", lambda h: F.struct(h["label"].alias("label"), h["count"].alias("count"))).alias("histogram"))
    flagged = bins.groupBy("section").agg(F.sum("flagged").alias("flagged"))
    findings = rows.withColumn("flag", flag).where("flag is not null")
    order = Window.partitionBy("section").orderBy("_first", "unit_id", "value")
    best = findings.withColumn("_first", first).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)
    best = best.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("_place", "unit_id", "value", "flag"))).alias("f"))
    best = best.select("section", F.transform("f", lambda f: F.struct(f["unit_id"].alias("unit_id"), f["value"].alias("value"), f["flag"].alias("flag"))).alias("findings"))
    names = ("mean", "median", "stdev", "q1", "q3", "lower_fence", "upper_fence")
    known = [(k, s.name, fences.get(k, {}).get("total", 0), *[fences.get(k, {}).get(n) for n in names]) for k, s in enumerate(sections)]
    summary = spark.createDataFrame(known, "section int, name string, total long, " + ", ".join(f"{n} double" for n in names))
    out = summary.join(flagged, "section", "left").join(filled, "section", "left").join(best, "section", "left")
    empty = lambda kind: F.array().cast(T.ArrayType(kind))
    out = out.select(
        "section", "name", "total", F.coalesce("flagged", F.lit(0)).alias("flagged"), *[stats.round_half_up(n, 2).alias(n) for n in names],
        F.coalesce("histogram", empty(BIN)).alias("histogram"), F.coalesce("findings", empty(FINDING)).alias("findings"),
    )
    return out, findings


def _chosen(sections: Sequence[Section], make, default: Column) -> Column:
    out = default
    for k, s in enumerate(sections):
        if (own := make(k, s)) is not None:
            out = F.when(F.col("section") == k, own).otherwise(out)
    return out


def digits_section(table: DataFrame, value: str, name: str = "benford") -> DataFrame:
    """The first-digit test as a section: a bin for each digit; flagged 1 if it fails."""
    digits = anomalies.benford_digits(table, value)
    one = digits.agg(F.array_sort(F.collect_list(F.struct("digit", "observed_count"))).alias("d"), F.max("total").alias("total"))
    test = anomalies.benford_test(table, value).select((~F.col("passes")).cast("long").alias("flagged"))
    bins = F.transform("d", lambda d: F.struct(d["digit"].cast("string").alias("label"), d["observed_count"].alias("count")))
    return one.crossJoin(F.broadcast(test)).select(F.lit(name).alias("name"), "total", F.coalesce("flagged", F.lit(0)).alias("flagged"), bins.alias("histogram"))


def patterns_section(patterns: DataFrame, province: str, name: str = "province_patterns", top: int = 10) -> DataFrame:
    """Provinces with a pattern as a section: a bin for each pattern; the first are those of one party with the most units."""
    patterns = checkpoint(patterns.select(province, "pattern", "total_cons"))  # read twice
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("pattern") == "monopoly"), F.desc("total_cons"), F.col(province).cast("string"))
    first = patterns.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)
    found = first.agg(F.array_sort(F.collect_list(F.struct("_place", F.col(province).cast("string").alias("unit_id"), F.col("total_cons").cast("double").alias("value"), F.col("pattern").alias("flag")))).alias("f"))
    count = lambda p: F.count_if(F.col("pattern") == p)
    bins = F.array(*[F.struct(F.lit(p).alias("label"), count(p).alias("count")) for p in ("monopoly", "high_variation")])
    one = patterns.agg(F.count("*").alias("total"), count("monopoly").alias("flagged"), bins.alias("histogram"))
    findings = F.transform("f", lambda f: F.struct(f["unit_id"].alias("unit_id"), f["value"].alias("value"), f["flag"].alias("flag")))
    return one.crossJoin(F.broadcast(found)).select(F.lit(name).alias("name"), "total", "flagged", "histogram", findings.alias("findings"))


def document(units: DataFrame, unit: str, sections: Sequence[Section], more: Sequence[DataFrame] = (), top: int = 10) -> DataFrame:
    """One row of REPORT: counts of units, and the sections in order, those of ``more`` last."""
    kept = measures(units, unit, sections)
    rows, findings = _sections_of(kept, sections, top)
    for k, other in enumerate(more):
        rows = rows.unionByName(other.withColumn("section", F.lit(len(sections) + k)), allowMissingColumns=True)
    empty = F.array().cast(T.ArrayType(FINDING))
    own = F.struct(*[(F.coalesce("findings", empty) if f.name == "findings" else F.col(f.name)).alias(f.name) for f in SECTION])
    nested = rows.agg(F.array_sort(F.collect_list(F.struct("section", own.alias("s")))).alias("x"))
    found = findings.agg(F.count_distinct("unit_id").alias("flagged_units"))
    all_ = kept.agg(F.count("*").alias("total_units"))
    return all_.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(nested)).select("total_units", "flagged_units", F.size("x").cast("long").alias("analysis_categories"), F.transform("x", lambda x: x["s"]).alias("sections"))

"""Statistics of one column: quartile fences, z-scores, histograms, first digits, correlation.

Results that are one row are meant to be cross-joined to the rows they describe:
Spark broadcasts the one row, where an unpartitioned window would gather all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.shared import checkpoint

#: Bins of a pass of :func:`exact_quantiles`, and distinct values it may gather at the end.
QUANTILE_BINS = 4_096
#: Value of the chi-square distribution with 8 degrees of freedom that is passed with probability 5 %.
CHI_SQUARE_5_PERCENT = 15.507

# Edges of the histograms, in percent.
EDGES = {
    "turnout": (0, 30, 40, 50, 55, 60, 65, 70, 75, 80, 100),
    "invalid": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15),
    "blank": (0, 2, 3, 4, 5, 6, 7, 8, 10, 15, 25),
    "dominance": (0, 20, 30, 35, 40, 45, 50, 55, 60, 70, 80, 100),
    "wasted": (0, 3, 5, 7, 9, 11, 13, 15, 20, 35),
}


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent, rounded; null where whole is 0 or null."""
    return round_half_even(F.try_divide(part, whole) * 100, digits)


def round_half_even(x: Column, digits: int = 2) -> Column:
    """The double nearest to the exact binary value of ``x`` at ``digits`` (up to 7) decimal places; exact ties to the even one.

    1.005 is below 1.005 and gives 1.0, 0.125 is a tie and gives 0.12.  ``x`` times
    the power of ten is a rounded product and its error, which halves of ``x`` give
    exactly; both decide.  Values too large to have such places stay.
    """
    scale = 10.0**digits
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper 26 bits
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (F.abs(whole) % 2 == 1))))
    return F.when(F.abs(x) < 2.0**52 / scale, (whole + F.when(up, 1).otherwise(0)) / scale).otherwise(x)


def round_half_up(x: Column | str, digits: int = 2) -> Column:
    """``x`` rounded as SQL's ``round`` does a double: its product with the power of ten, halves away from zero.

    Spark's own rounds the shortest decimal that reads as ``x``: 1.005 gives 1.01 there and 1.0 here.
    """
    x, scale = F.col(x) if isinstance(x, str) else x, 10.0**digits
    product = F.abs(x) * scale
    whole = F.floor(product)
    return F.when(product < 2.0**52, F.signum(x) * ((whole + F.when(product - whole >= 0.5, 1).otherwise(0)) / scale)).otherwise(x)


def exact_mean(x: Column, digits: int, scale: int = 8) -> Column:
    """Mean of values of 0 or more as an aggregate, rounded half up, the same in any order of the rows.

    Values count in whole units of 10 ** -scale, so that sums and rounding are exact.
    """
    units = F.floor(x * 10.0**scale + 0.5).cast("decimal(20,0)")
    n, unit = F.count(x).cast("decimal(20,0)"), F.lit(10 ** (scale - digits)).cast("decimal(18,0)")
    two = F.lit(2).cast("decimal(1,0)")
    return F.call_function("div", two * F.sum(units) + n * unit, two * n * unit) / 10.0**digits


def exact_deviation(x: Column, digits: int, scale: int = 4) -> Column:
    """Sample deviation as an aggregate, rounded, from exact sums of values in units of 10 ** -scale; null below two values."""
    units = F.floor(x * 10.0**scale + 0.5).cast("decimal(14,0)")
    n = F.count(x).cast("decimal(10,0)")
    spread = n * F.sum(units * units).cast("decimal(28,0)") - (F.sum(units) * F.sum(units)).cast("decimal(38,0)")
    variance = F.try_divide(spread.cast("double"), (n * (n - F.lit(1).cast("decimal(1,0)"))).cast("double"))
    return F.floor(F.sqrt(variance) / 10.0 ** (scale - digits) + 0.5) / 10.0**digits


def z_score(x: Column, mean: Column, deviation: Column, digits: int = 2) -> Column:
    """Distance from the mean in deviations, rounded; 0 where nothing varies."""
    return round_half_up(F.when(deviation > 0, (x - mean) / deviation).otherwise(0.0), digits)


def first_digit(x: Column) -> Column:
    """Leading decimal digit of the whole part of a number (0 for numbers below 1)."""
    return F.left(F.abs(x.cast("bigint")).cast("string"), F.lit(1)).cast("int")


def benford_share(digit: Column) -> Column:
    """Share of numbers that lead with a digit by Benford's law."""
    return F.log10(1 + 1 / digit)


def chi_square_tail_8(x: Column) -> Column:
    """P(X > x) for the chi-square distribution with 8 degrees of freedom, in closed form."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def safe_correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null if either side is constant or missing."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))))


def clean(x: Column) -> Column:
    """NaN as null, so that aggregates skip it and comparisons are false."""
    return F.when(F.isnan(x), None).otherwise(x)


FENCES = ("mean", "median", "stdev", "q1", "q3", "iqr", "lower_fence", "upper_fence", "total")


def fence_summary(df: DataFrame, *values: str) -> DataFrame:
    """One row: mean, median, stdev, q1, q3, iqr, lower_fence, upper_fence, total of a rounded column.

    With several columns these come in a struct for each, named like it, from one
    pass.  Exact quartiles by linear interpolation.  They are gathered as counts of
    distinct values, which rounding to two places keeps few for shares of a
    whole; for measures without a bound use :func:`unit_fences`.
    """
    parts = []
    for i, value in enumerate(values):
        q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts += [F.avg(value).alias(f"_mean{i}"), F.stddev_samp(value).alias(f"_sd{i}"), q.alias(f"_q{i}"), F.count(value).alias(f"_n{i}")]
    one = df.agg(*parts)

    def summary(i: int) -> list[Column]:
        q1, q2, q3 = (F.get(f"_q{i}", F.lit(k)) for k in range(3))
        found = (F.col(f"_mean{i}"), q2, F.coalesce(f"_sd{i}", F.lit(0.0)), q1, q3, q3 - q1, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), F.col(f"_n{i}"))
        return [c.alias(name) for c, name in zip(found, FENCES)]

    return one.select(*summary(0)) if len(values) == 1 else one.select(*[F.struct(*summary(i)).alias(value) for i, value in enumerate(values)])


#: Units from which a value counts as infinite, and distinct units that are gathered at once.
ENDLESS = 1 << 62
GATHERED = 4_096


def unit_counts(df: DataFrame, value: str, digits: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(*by, unit, n): how many rows (of each group) have each value of a column rounded to ``digits`` places, in whole units of the last.

    One shuffle of partial counts, checkpointed: what quantiles and moments need,
    whatever they are asked.  Nulls and NaN are left out; values of 2 ** 62 units
    or more count as infinite.
    """
    x = clean(F.col(value).cast("double")) * 10.0**digits
    unit = F.when(x >= ENDLESS, ENDLESS).when(x <= -ENDLESS, -ENDLESS).otherwise(F.floor(x + 0.5))
    return checkpoint(df.select(*by, unit.cast("bigint").alias("unit")).where("unit is not null").groupBy(*by, "unit").agg(F.count("*").alias("n")))


def between(low: float, high: float, part: float) -> float:
    """Linear interpolation of doubles as SQL's ``quantile_cont`` does it: the sum's one product isn't rounded before."""
    if low == high or math.isinf(low) or math.isinf(high):
        return low if low == high else low + (high - low) * part
    return float(Fraction(low) * Fraction(1 - part) + Fraction(high * part))


def unit_quantiles(counts: DataFrame, shares: Sequence[float], by: str | None = None, digits: int = 0) -> dict[object, tuple[list[float], int, float, float]]:
    """{group: (exact quantiles by linear interpolation, rows, mean, sample deviation)} of :func:`unit_counts`, of units of ``digits`` places.

    ``by``: a column of few groups (None: all rows are group None); groups without
    rows are absent.  Coarse bins (sign, digits and the first three of them) come
    first, each with its sum and its spread about its first unit; bins that hold a
    wanted rank are cut on until they span few units, which are gathered, those of
    all groups in one job.  For shares of a whole one such step is enough.
    """
    counts = counts.select((F.col(by) if by else F.lit(None).cast("int")).alias("g"), "unit", "n")
    size = F.abs("unit").cast("string")
    base = F.rpad(F.left(size, F.lit(3)), F.length(size), "0").cast("bigint") * F.signum("unit").cast("bigint")
    beyond = (F.col("unit") - base).cast("double")
    bins = counts.groupBy("g", base.alias("base")).agg(
        F.min("unit").alias("lo"), F.max("unit").alias("hi"), F.sum("n").alias("n"), F.sum(F.col("unit").cast("decimal(19,0)") * F.col("n").cast("decimal(15,0)")).alias("sum"), F.sum(beyond * beyond * F.col("n")).alias("spread")
    )
    groups: dict[object, list] = {}
    for r in sorted(bins.collect(), key=lambda r: r["lo"]):
        groups.setdefault(r["g"], []).append(r)
    moments, found, spans = {}, {}, []
    for g, rows in groups.items():
        total = sum(r["n"] for r in rows)
        moments[g] = total, *_moments(rows, total)
        wanted = sorted({int((total - 1) * p) + k for p in shares for k in (0, 1) if int((total - 1) * p) + k < total})
        spans += _spans(rows, g, 0, wanted, found)
    while spans:
        span, cell, inside = F.lit(-1), F.lit(None).cast("bigint"), F.lit(False)
        for k, (g, lo, hi, *_) in enumerate(spans):
            own = F.col("g").eqNullSafe(F.lit(g)) & (F.col("unit") >= lo) & (F.col("unit") <= hi)
            width = max(1, -(-(hi - lo + 1) // GATHERED))
            span, cell, inside = F.when(own, k).otherwise(span), F.when(own, F.call_function("div", F.col("unit") - F.lit(lo), F.lit(width))).otherwise(cell), inside | own
        cells = counts.where(inside).groupBy(span.alias("span"), cell.alias("cell")).agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"), F.sum("n").alias("n")).collect()
        narrower = []
        for k, (g, _, _, below, ranks) in enumerate(spans):
            narrower += _spans(sorted((c for c in cells if c["span"] == k), key=lambda c: c["lo"]), g, below, ranks, found)
        spans = narrower
    scale = 10.0**digits
    real = lambda u: math.copysign(math.inf, u) if abs(u) >= ENDLESS else u / scale
    out = {}
    for g, (total, mean, deviation) in moments.items():
        quantiles = []
        for p in shares:
            at = (total - 1) * p
            low, part = real(found[g, int(at)]), at - int(at)
            quantiles.append(between(low, real(found[g, int(at) + 1]) if part else low, part))
        out[g] = quantiles, total, mean / scale, deviation / scale
    return out


def _moments(rows: list, total: int) -> tuple[float, float]:
    """Mean and sample deviation from bins with exact sums; infinite or NaN where units are."""
    low, high = rows[0]["lo"] <= -ENDLESS, rows[-1]["hi"] >= ENDLESS
    if low or high:
        return math.nan if low and high else math.inf if high else -math.inf, math.nan
    mean, squares = sum(int(r["sum"]) for r in rows) / total, 0.0
    for r in rows:
        own = int(r["sum"]) / r["n"]
        squares += r["spread"] - r["n"] * (own - r["base"]) ** 2 + r["n"] * (own - mean) ** 2
    return mean, math.sqrt(max(0.0, squares) / (total - 1)) if total > 1 else 0.0


def _spans(rows: list, group: object, below: int, ranks: list[int], found: dict) -> list[tuple]:
    """(group, lo, hi, rows below, ranks) of the bins that hold ranks and more than one unit; others go to ``found``."""
    out = []
    for r in rows:
        if here := [k for k in ranks if below <= k < below + r["n"]]:
            if r["lo"] == r["hi"]:
                found |= {(group, k): r["lo"] for k in here}
            else:
                out.append((group, r["lo"], r["hi"], below, here))
        below += r["n"]
    return out


def unit_fences(counts: DataFrame, digits: int = 2) -> dict[str, float | None]:
    """FENCES of the values that :func:`unit_counts` counted."""
    return grouped_unit_fences(counts, None, digits).get(None) or dict.fromkeys(FENCES) | {"stdev": 0.0, "total": 0}


def grouped_unit_fences(counts: DataFrame, by: str | None, digits: int = 2) -> dict[object, dict[str, float]]:
    """:func:`unit_fences` of each group, from the same few jobs."""
    out = {}
    for g, ((q1, q2, q3), n, mean, deviation) in unit_quantiles(counts, (0.25, 0.5, 0.75), by, digits).items():
        out[g] = dict(zip(FENCES, (mean, q2, deviation, q1, q3, q3 - q1, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), n)))
    return out


def outside(x: Column, low: float | None, high: float | None) -> Column:
    """Whether a value lies beyond fences; a fence that is no number holds nothing off."""
    below = F.lit(False) if low is None or math.isnan(low) else x < low
    above = F.lit(False) if high is None or math.isnan(high) else (x > high) & ~F.isnan(x)
    return below | above


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles (linear interpolation) of a column with any number of distinct values.

    The order statistics are bracketed by histograms: each pass counts the values
    in a few thousand bins of every bracket and narrows it to one bin, until few
    distinct values are left.  Every pass is a partial aggregation with bounded
    output over the one column, which is kept meanwhile.  Infinities are counted
    apart and are values like others: a quantile may be infinite, or NaN between
    the two.  Nulls and NaN are skipped; without values the quantiles are None.
    """
    values = df.select(clean(F.col(value).cast("double")).alias("x")).where("x is not null").persist(StorageLevel.DISK_ONLY)
    try:
        return _quantiles(values, shares)
    finally:
        values.unpersist()


def _quantiles(values: DataFrame, shares: Sequence[float]) -> list[float | None]:
    x, inf = F.col("x"), float("inf")
    finite = (x > -inf) & (x < inf)
    ends = values.agg(F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi"), F.count("*").alias("n"), F.count_if(x == -inf).alias("below"), F.count_if(x == inf).alias("above")).first()
    n = ends["n"]
    if not n:
        return [None] * len(shares)
    wanted = sorted({int((n - 1) * p) + k for p in shares for k in (0, 1) if int((n - 1) * p) + k < n})
    found = {r: -inf if r < ends["below"] else inf for r in wanted if r < ends["below"] or r >= n - ends["above"]}
    ranks = [r for r in wanted if r not in found]
    brackets = {(ends["lo"], ends["hi"], ends["below"]): ranks} if ranks else {}  # (least, greatest, values below) -> ranks
    while brackets:
        narrowed: dict[tuple, list[int]] = {}
        for (lo, hi, below), ranks in brackets.items():
            inside = values.where((x >= lo) & (x <= hi))
            width = hi / QUANTILE_BINS - lo / QUANTILE_BINS  # the difference itself may overflow
            whole = lo == hi or not width > 0 or lo + width == lo
            bin_ = x if whole else F.floor(F.least((x / width) - (lo / width), F.lit(float(QUANTILE_BINS))))
            bins = inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z"))
            for row in sorted(bins.collect(), key=lambda r: r["a"]):
                here = [r for r in ranks if below <= r < below + row["n"]]
                if here and row["a"] == row["z"]:
                    found |= dict.fromkeys(here, row["a"])
                elif here:
                    if (row["a"], row["z"]) == (lo, hi):
                        raise ValueError("quantile bins don't part the values")
                    narrowed[row["a"], row["z"], below] = here
                below += row["n"]
        brackets = narrowed
    out = []
    for p in shares:
        at = (n - 1) * p
        low, part = found[int(at)], at - int(at)
        out.append(between(low, found[int(at) + 1] if part else low, part))
    return out


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bin, label, count): half-open bins, the last closed; empty ones stay, what is outside is left out."""
    last = len(edges) - 2
    number = F.lit(None).cast("int")
    for i in reversed(range(last + 1)):
        x, lo, hi = F.col(value), edges[i], edges[i + 1]
        number = F.when((x >= lo) & ((x <= hi) if i == last else (x < hi)), i).otherwise(number)
    counts = df.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(i, f"{edges[i]}-{edges[i + 1]}%") for i in range(last + 1)], "bin int, label string")
    return bins.join(counts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("count"))


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Adds each row's number, from 0, in the order of any sortable columns.

    Rows are dealt out by ranges of the whole key and, below it, of a number of
    their own, so that any count of rows with one key is spread; a row's number is
    its place in its part plus the sizes of the parts before, of which there are as
    many as shuffle partitions.  No task orders all rows.  Ties get numbers in no
    particular order.  The numbered rows are checkpointed.
    """
    own = df.withColumn("_ordinal_row", F.monotonically_increasing_id())
    sorted_ = own.repartitionByRange(*order, "_ordinal_row").sortWithinPartitions(*order, "_ordinal_row").drop("_ordinal_row")
    placed = checkpoint(sorted_.withColumn("_ordinal_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_ordinal_at", 33), F.col("_ordinal_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_ordinal_part")).agg(F.count("*").alias("_ordinal_n"))
    before = Window.orderBy("_ordinal_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_ordinal_part", F.coalesce(F.sum("_ordinal_n").over(before), F.lit(0)).alias("_ordinal_start"))
    numbered = placed.withColumn("_ordinal_part", part).join(F.broadcast(starts), "_ordinal_part")
    return numbered.withColumn(name, F.col("_ordinal_start") + at).drop("_ordinal_part", "_ordinal_at", "_ordinal_start")

"""Spatial autocorrelation of a measure: Moran's I on a grid, with its moments and a permutation test.

Two units are neighbours if their grid cells are the same or touch.  Sums over
pairs of units follow from the counts and sums of cells and of the nine cells
around each, so no pair is ever made and a crowded cell costs one row.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.stats import clean, with_ordinal

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def placed(units: DataFrame, x: Column, y: Column, value: Column, size: float) -> DataFrame:
    """(cx, cy, v) of the units with coordinates and a value that are numbers."""
    cell = lambda c: F.floor(clean(c.cast("double")) / size)
    rows = units.select(cell(x).alias("cx"), cell(y).alias("cy"), clean(value.cast("double")).alias("v"))
    return rows.where("cx is not null and cy is not null and v is not null")


def _sums(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each of ``by``: n, w (ordered pairs of neighbours), d (squared degrees), m2, m4 and c (sum of products over the pairs); rows hold z."""
    z = F.col("z")
    cells = rows.groupBy(*by, "cx", "cy").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(z * z).alias("m2"), F.sum(z * z * z * z).alias("m4"))
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND]))
    near = cells.select(*by, "cx", "cy", "n", "s", moves.alias("m")).groupBy(*by, (F.col("cx") + F.col("m.i")).alias("cx"), (F.col("cy") + F.col("m.j")).alias("cy")).agg(F.sum("n").alias("nn"), F.sum("s").alias("ss"))
    both = cells.join(near, [*by, "cx", "cy"])
    others = F.col("nn") - 1
    return both.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.sum(F.col("n") * others).cast("double").alias("w"), F.sum(F.col("n") * others.cast("double") * others).alias("d"),
        F.sum("m2").alias("m2"), F.sum("m4").alias("m4"), F.sum(F.col("s") * F.col("ss") - F.col("m2")).alias("c"),
    )


def _centred(rows: DataFrame) -> DataFrame:
    mean = rows.agg(F.avg("v").alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("z", F.col("v") - F.col("_mean")).drop("_mean")


def _index() -> Column:
    return F.try_divide(F.col("n") * F.col("c"), F.col("w") * F.col("m2"))


def morans_i(units: DataFrame, x: Column, y: Column, value: Column, size: float) -> DataFrame:
    """One row: units, pairs, moran_i, expected, z (under random assignment of the values; null below four units).

    Without neighbours, or where nothing varies, moran_i and z are null.
    """
    n, w, d, e = F.col("n"), F.col("w"), F.col("d"), F.try_divide(F.lit(-1.0), F.col("n") - 1)
    kurtosis = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2"))
    first = n * ((n * n - 3 * n + 3) * 2 * w - n * 4 * d + 3 * w * w)
    second = kurtosis * ((n * n - n) * 2 * w - 2 * n * 4 * d + 6 * w * w)
    variance = F.try_divide(first - second, (n - 1) * (n - 2) * (n - 3) * w * w) - e * e
    one = _sums(_centred(placed(units, x, y, value, size)))
    z = F.when((n > 3) & (variance > 0), (_index() - e) / F.sqrt(variance))
    return one.select(n.cast("bigint").alias("units"), (F.coalesce(w, F.lit(0.0)) / 2).cast("bigint").alias("pairs"), _index().alias("moran_i"), F.when(n > 1, e).alias("expected"), z.alias("z"))


def permutation_test(units: DataFrame, x: Column, y: Column, value: Column, size: float, permutations: int = 99, seed: int = 7) -> DataFrame:
    """One row: moran_i, permutations, as_far (permuted values whose index is as far from 0 or farther), p_value.

    Values are numbered in an order that their hashes and a seed make; each
    permutation hands every place the value ``a * number + b`` modulo the number of
    units, so a permutation is a join of rows and no list of values is gathered.
    """
    rows = _centred(placed(units, x, y, value, size))
    numbered = with_ordinal(rows.withColumn("h", F.xxhash64(F.lit(seed), "cx", "cy", "v")), "h", name="k")
    n = numbered.count()
    draw = random.Random(seed)
    maps = [(0, 1, 0)]
    while n and len(maps) <= permutations:
        a = draw.randrange(1, n + 1)
        if math.gcd(a, n) == 1:
            maps.append((len(maps), a, draw.randrange(n)))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).cast("decimal(19,0)").alias("a"), F.lit(b).cast("bigint").alias("b")) for r, a, b in maps]))
    source = F.pmod(F.col("m.a") * F.col("k").cast("decimal(19,0)") + F.col("m.b"), F.lit(max(1, n)).cast("decimal(19,0)")).cast("bigint")
    places = numbered.select("cx", "cy", "k", each.alias("m")).select("cx", "cy", F.col("m.r").alias("r"), source.alias("k"))
    found = _sums(places.join(numbered.select("k", "z"), "k"), ["r"]).select("r", _index().alias("i"))
    own = found.where("r = 0").select(F.col("i").alias("moran_i"))
    far = F.count_if(F.abs("i") >= F.abs("moran_i") - 1e-12)
    one = found.where("r > 0").crossJoin(F.broadcast(own)).agg(F.max("moran_i").alias("moran_i"), F.count("i").alias("permutations"), far.alias("as_far"))
    return one.withColumn("p_value", F.when(F.col("permutations") > 0, (F.col("as_far") + 1) / (F.col("permutations") + 1)))

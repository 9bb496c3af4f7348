"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to 32 counts, the set bits of each 2-bit
segment.  The Manhattan distance of two count vectors never exceeds the Hamming
distance of the fingerprints, so it is a safe filter.  Written in unary (each
segment's bits sorted), the counts fit in 64 bits again and their Manhattan
distance is ``bit_count(a ^ b)``.

Grid range join within distance r: the 32 coordinates fall into g groups.  A pair
within r differs in at most r groups, so it agrees on at least g - r and meets in
the grid cell of those groups' counts.  Cells are joined by equality, the range
condition and the exact Hamming distance are part of the join condition, so only
true links leave it.  g follows from the number of fingerprints, so that cells
don't grow with it; a cell that is crowded all the same is cut by a second grid
over the coordinates that the first leaves open.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import checkpoint
from veritally.llm.components import connected_components

SEED = 42
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
#: Hashes whose bits are counted at once (8 MB of unpacked bits).
BLOCK = 1 << 17
#: A grid cell with more fingerprints is cut by a second grid; what is crowded even then goes the way of :func:`_ball_links`.
HOT_CELL = 2048
#: Fingerprints that the likeliest cell should hold at most, by chance.
CELL_ROWS = 512
#: Groups of coordinates at most.
MOST_GROUPS = 9


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(text: bytes, shingle_words: int = 3) -> int:
    """Unsigned fingerprint of one UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    n, digest = len(words), xxhash.xxh64_intdigest
    if n == 0:
        return 0
    if n <= shingle_words:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle_words: int = 3) -> Column:
    """64-bit fingerprint of a text column as a long (the same bits, signed)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
        return pa.array((_signed(fingerprint_of(x.as_py() or b"", shingle_words)) for x in raw), pa.int64())

    return of(F.coalesce(F.col(text), F.lit("")))


def _embedded(fp: Column) -> Column:
    """The segment counts in unary: each 2-bit segment's bits sorted."""
    shifted = F.shiftrightunsigned(fp, 1)
    mask = F.lit(LOW_BITS)
    return fp.bitwiseOR(shifted).bitwiseAND(mask).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(mask), 1))


def _mask(segments) -> int:
    return sum(3 << (2 * int(x)) for x in segments)


def grids(distance: int, groups: int, segments=range(SEGMENTS)) -> list[np.ndarray]:
    """The segments of each grid: all choices of ``groups - distance`` of the groups."""
    parts = np.array_split(np.array(segments), groups)
    return [np.sort(np.concatenate(chosen)) for chosen in combinations(parts, groups - distance)]


def groups_for(fingerprints: int, distance: int) -> int:
    """The fewest groups of coordinates with which no cell is crowded by chance.

    The count of a two-bit segment is 1 for half of all fingerprints, so of n the
    likeliest cell of a grid over s segments holds n / 2 ** s.
    """
    for groups in range(distance + 2, max(distance + 2, MOST_GROUPS) + 1):
        if fingerprints / 2 ** min(map(len, grids(distance, groups))) <= CELL_ROWS:
            break
    return groups


def _ball_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links that connect all fingerprints of ``hot`` within ``distance``, without pairs.

    Each fingerprint writes the keys of its ball of radius floor(d/2).  All that
    share a key are within d of each other up to one step, so the least stands
    for them; the fingerprints whose ball of radius ceil(d/2) holds the key link
    to it.  By the triangle inequality no other links arise when both radii add
    up to d, and every pair within d has such a key on a shortest path.
    Rows per fingerprint: fixed by d, whatever the group's size.
    """
    small, large = distance // 2, distance - distance // 2
    flips = [[0], [_signed(1 << i) for i in range(64)], [_signed((1 << i) | (1 << j)) for i, j in combinations(range(64), 2)]]
    if large > 2:
        raise ValueError("distances over 4 are not supported")

    def ball(radius: int) -> DataFrame:
        deltas = F.array(*[F.lit(x) for r in range(radius + 1) for x in flips[r]])
        return hot.select("fp", F.explode(F.transform(deltas, lambda d: F.col("fp").bitwiseXOR(d))).alias("key"))

    stands = ball(small).groupBy("key").agg(F.min("fp").alias("least"))
    return ball(large).join(stands, "key").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v")).distinct()


def _cells(rows: DataFrame, grid: Column, masks: Column) -> DataFrame:
    """(fp, e, first, cell): each fingerprint in its cell of each grid.  ``grid``: what tells the grids' sets apart."""
    e = F.col("e")
    own = rows.select("fp", "e", grid.alias("_set"), F.posexplode(F.transform(masks, lambda m: e.bitwiseAND(m))).alias("grid", "key"))
    return own.select("fp", "e", "grid", F.xxhash64("_set", "grid", "key").alias("cell"))


def _split(cells: DataFrame, hot_cell: int) -> tuple[DataFrame, DataFrame | None]:
    """(cells with at most ``hot_cell`` fingerprints, the others or None)."""
    crowded = checkpoint(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot_cell).select("cell"))
    if crowded.isEmpty():
        return cells, None
    return cells.join(crowded, "cell", "left_anti"), cells.join(crowded, "cell", "left_semi")


def _within(cells: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) of fingerprints that share a cell; cells are told apart by a hash, which can only add pairs to compare."""
    a, b = cells.alias("a"), cells.alias("b")
    return a.join(
        b,
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.e").bitwiseXOR(F.col("b.e"))) <= distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_links(fingerprints: DataFrame, distance: int = 3, hot_cell: int = HOT_CELL, groups: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``) that differ in 1 to ``distance`` bits.

    A fingerprint is written once for each grid: C(g, distance) rows, 84 at most
    for distance 3, and for each crowded cell that it lies in once for each of a
    second grid's C(distance + 2, 2).  Every link of a cell with at most
    ``hot_cell`` fingerprints is returned.  The fingerprints of a cell that is
    crowded even in the second grid are linked exactly too, but through common
    keys (see :func:`_ball_links`), so that a huge group of near copies costs a
    fixed number of rows each, not all pairs; there the links returned connect
    what all links would connect.
    """
    groups = groups or groups_for(fingerprints.count(), distance)
    first = grids(distance, groups)
    literal = lambda sets: F.array(*[F.lit(_signed(_mask(x))) for x in sets])
    rows = fingerprints.select("fp", _embedded(F.col("fp")).alias("e"))
    cells, hot = _split(_cells(rows, F.lit(0), literal(first)), hot_cell)
    links = _within(cells, distance)
    if hot is None:
        return links
    second = F.array(*[literal(grids(distance, distance + 2, np.setdiff1d(np.arange(SEGMENTS), x))) for x in first])
    cells, hot = _split(_cells(hot, F.col("cell"), F.get(second, F.col("grid"))), hot_cell)
    links = links.unionByName(_within(cells, distance))
    return links if hot is None else links.unionByName(_ball_links(hot.select("fp").distinct(), distance))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, shingle_words: int = 3, hot_cell: int = HOT_CELL) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id and label.

    Texts are lower-cased (A-Z), cut into words at white space and hashed as
    ``shingle_words``-word shingles, repeats included; a shorter text is one
    shingle, a null or empty one has fingerprint 0 and is linked like any other.
    Equal fingerprints and those within ``distance`` bits link; component_id is
    the least doc_id reachable (null only where every reachable doc_id is null),
    label the component's least fingerprint.  Repeated rows and ties need no
    care: a row's result depends on its fingerprint alone.  Other columns of the
    input are ignored; an empty table gives an empty one.
    """
    prints = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text, shingle_words).alias("fp")))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(near_links(classes, distance, hot_cell))
    linked = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = linked.select("fp", "label").join(least, "label")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", "label")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, shingle_words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the least doc_id.

    Where doc_ids repeat or are null, one row of each group stays all the same.
    """
    found = checkpoint(near_duplicates(docs, doc_id, text, distance, shingle_words))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep"), "label").distinct()
    kept = docs.join(keep, F.col(doc_id).eqNullSafe(F.col("_keep")), "left_semi")
    ids = keep.agg(F.count("*").alias("rows"), F.count_distinct("_keep").alias("ids")).first()
    rows = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).count()
    if ids["rows"] == ids["ids"] == rows:
        return kept
    labels = found.select(F.col("fp").alias("_fp"), F.col("label").alias("_label")).distinct()
    again = kept.withColumn("_fp", fingerprint(text, shingle_words)).join(labels, "_fp")
    return again.dropDuplicates(["_label"]).select(*[again[c] for c in docs.columns])

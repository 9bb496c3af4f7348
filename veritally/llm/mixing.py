"""Mixing sources to target weights by Pfair scheduling.

A source's documents are put in a fixed pseudo-random order and cut into blocks.
With weight w, its i-th block (from 0) is released at slot floor(i / w) and due
by slot ceil((i + 1) / w).  In every slot the released block with the earliest
deadline runs; on one machine that meets all deadlines, so after any number of
slots every source has run less than one block more or less than its weight asks.

Weights are multiples of 1 / period, so the schedule repeats every ``period``
slots.  One period is worked out on the driver, whatever the number of rows; a
document's slot follows from its rank in its source and that table.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.common import checkpoint

#: Sources that the schedule's table can hold; more are an error, not cut.
MOST_SOURCES = 65_536
#: Slots of a period for each source at least; weights are exact to about 1 / period.
SLOTS_PER_SOURCE = 64
LEAST_PERIOD = 4_096
#: Rows that share a ranking window, about.
BUCKET_ROWS = 4_096
LEAST_BUCKETS = 256
#: Times the usual rows of a bucket above which it holds copies of a row, which are dealt out.
HOT_BUCKET = 16
#: Slots of a period up to which its table is broadcast; beyond, Spark chooses.
BROADCAST_SLOTS = 1_000_000

ADDED = ("block", "release", "deadline", "slot", "position", "in_mix")


class Slot(NamedTuple):
    source: str
    block: int
    release: int
    deadline: int
    slot: int


def quotas(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Blocks of each source in a period: largest remainders, one at least for a positive weight."""
    positive = {s: float(w) for s, w in sorted(weights.items()) if w > 0}
    total = sum(positive.values())
    exact = {s: w / total * period for s, w in positive.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    spare = period - sum(out.values())
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while spare > 0:
        for s in order[:spare]:
            out[s] += 1
        spare = period - sum(out.values())
    while spare < 0:  # many tiny weights were raised to one
        s = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1.0, s))
        out[s] -= 1
        spare += 1
    return out


def schedule(blocks: Mapping[str, int], period: int) -> list[Slot]:
    """Earliest deadline first over one period, in which source s runs ``blocks[s]`` times.

    Ties go to the first source by name.
    """
    waiting = [(0, s, 0) for s, q in sorted(blocks.items()) if q]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // blocks[s]), s, i, release))
        if not ready:
            continue
        deadline, s, i, release = heapq.heappop(ready)
        out.append(Slot(s, i, release, deadline, slot))
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * period // blocks[s], s, i + 1))
    return out


def tempered(sizes: Mapping[str, int], power: float) -> dict[str, float]:
    """Weights in proportion to a power of the sources' sizes."""
    return {s: n**power for s, n in sizes.items() if n}


def _name(source: Column) -> Column:
    """A source's name as a key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.7, block_rows: int = 16, key: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """Adds block, release, deadline, slot, position and in_mix to every row.

    ``weights``: target weights by source (None is the null source); without
    them, weights in proportion to ``size ** power``.  block: the row's block in
    its source; release, deadline and slot: its Pfair window and its slot;
    position: where the row comes in the mixture (with a gap after a source's
    last block, if that is not full).  in_mix: whether its slot lies before the
    first for which a source has no block left, up to which every source has run
    less than a block more or less than its weight asks.  Rows of a source
    without a positive weight have null slots and are not in the mix.

    Beyond that the schedule goes on: passing over the empty slots, the sources
    left share the rest in proportion to their weights, each within
    1 + min(d, l) * w blocks, where d sources have run dry, l are left and w is
    the source's share among those.

    No row is lost.  Rows with equal keys are told apart by their other columns,
    equal rows are interchangeable; an empty table gives an empty one.  Columns
    of the added names are replaced.  Ranks are taken in hash buckets of each
    source, so that a source with most of the rows spreads over all tasks.
    """
    keep = [c for c in docs.columns if c not in ADDED]
    named = docs.select(*keep, _name(F.col(source)).alias("_source"))
    sizes = {r["_source"]: r["n"] for r in named.groupBy("_source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = {("null" if s is None else f"={s}"): w for s, w in weights.items()} if weights is not None else tempered(sizes, power)
    wanted = {s: w for s, w in wanted.items() if w > 0 and s in sizes}
    period = max(LEAST_PERIOD, SLOTS_PER_SOURCE * len(wanted))
    blocks = quotas(wanted, period) if wanted else {}
    slots = schedule(blocks, period)
    place = {(x.source, x.block): x.slot for x in slots}
    has = {s: -(-sizes[s] // block_rows) for s in blocks}
    horizon = min((has[s] // q * period + place[s, has[s] % q] for s, q in blocks.items()), default=0)

    buckets = max(LEAST_BUCKETS, -(-sum(sizes.values()) // BUCKET_ROWS))
    order = F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(*keep))
    dealt = named.withColumn("_order", order).withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    full = HOT_BUCKET * BUCKET_ROWS
    hot = [r["_bucket"] for r in dealt.groupBy("_bucket").agg(F.count("*").alias("n")).where(F.col("n") > full).limit(buckets // HOT_BUCKET + 1).collect()]
    if hot:  # equal rows, which any order suits; the draw is kept, so that a lost task does not draw again
        dealt = checkpoint(dealt.withColumn("_bucket", F.when(F.col("_bucket").isin(hot), F.floor(F.rand(seed) * buckets)).otherwise(F.col("_bucket"))))
    counts = dealt.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", key, F.xxhash64(*keep))
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["_source", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_start")).withColumn("block", F.expr(f"_rank div {block_rows}"))

    spark = docs.sparkSession
    table = spark.createDataFrame([(*x, blocks[x.source]) for x in slots], "_source string, _i long, _release long, _deadline long, _slot long, _quota long")
    quota = spark.createDataFrame(list(blocks.items()), "_source string, _quota long")
    cycles = ranked.join(F.broadcast(quota), "_source", "left").withColumn("_cycle", F.expr("block div _quota")).withColumn("_i", F.expr("block % _quota"))
    table = table.drop("_quota")
    placed = cycles.join(F.broadcast(table) if len(slots) <= BROADCAST_SLOTS else table, ["_source", "_i"], "left")
    later = F.col("_cycle") * period
    slot = later + F.col("_slot")
    return placed.select(
        *keep,
        "block",
        (later + F.col("_release")).alias("release"),
        (later + F.col("_deadline")).alias("deadline"),
        slot.alias("slot"),
        (slot * block_rows + F.col("_rank") % block_rows).alias("position"),
        F.coalesce(slot < horizon, F.lit(False)).alias("in_mix"),
    )

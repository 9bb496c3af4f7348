"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import checkpoint


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component: its least node.

    ``links`` has two long columns ``u`` and ``v``; self links, repeats and
    either direction are allowed, null ends take no part.  An empty table gives
    an empty table.  Large-star and small-star alternate until nothing changes
    (a logarithmic number of rounds); every round is a pre-aggregated minimum
    and an equi-join that Spark may split when a hub is skewed, and ends in a
    checkpoint.  ``max_rounds`` guards against a bug, not against large inputs:
    passing it raises.
    """
    links = checkpoint(links.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    before = _signature(links)
    for _ in range(max_rounds):
        links = checkpoint(_small_star(_large_star(links)))
        after = _signature(links)
        if after == before:
            nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.unionByName(roots)
        before = after
    raise RuntimeError("components did not settle")

"""Sinks: nested JSON and CSV of finished, flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, files: int | None = None, compression: str = "none") -> None:
    """One JSON object a row, null fields kept; ``files``: at most so many (for small reports).

    ``compression``: "gzip" for large feeds, whose names and repeated words make
    most of them; such a file is read by one task, so there are as many as tasks wrote.
    """
    (df.coalesce(files) if files else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def write_csv(df: DataFrame, path: str, files: int | None = None, mark: bool = False) -> None:
    """CSV with a header, UTF-8, quotes inside quoted values doubled.

    ``mark``: each file starts with a byte order mark, and a table without rows
    leaves no file and no folder.  Files are then written as text, each part's first
    row behind the mark and the header, so Spark's task commit holds for them, too.
    """
    df = df.coalesce(files) if files else df
    if not mark:
        df.write.mode("overwrite").csv(path, header=True, escape='"')
        return
    if df.isEmpty():
        return
    header = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') else c for c in df.columns)
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"escape": '"'})
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = df.select(line.alias("value"), first.alias("first"))
    rows.select(F.when(F.col("first"), F.concat(F.lit(f"\ufeff{header}\n"), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(path)


def land(df: DataFrame, path: str) -> None:
    """A feed as it came, for later scans; appended, never overwritten."""
    df.write.mode("append").json(path)


def nested(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Documents: a row for each of ``keys`` with its rows as structs in an array ``name``; for groups that fit in one document."""
    own = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.collect_list(own).alias(name))


def keyed(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as the JSON object that a map-shaped document holds under its key."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("json"))


def audit_report(checks: DataFrame, generated_at: str) -> DataFrame:
    """One row: when, checks run, checks that found something, their names (bounded by the checks)."""
    found = F.array_sort(F.collect_list(F.when(F.col("findings") > 0, F.col("check"))))
    return checks.agg(F.lit(generated_at).alias("generated_at"), F.count("*").alias("checks"), F.count_if(F.col("findings") > 0).alias("with_findings"), F.array_join(found, ",").alias("names"))

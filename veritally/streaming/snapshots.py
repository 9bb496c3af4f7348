"""Snapshots of two-source documents as a stream.

Beyond batch comparison: landed files are read as a stream, each micro-batch is
reduced to the latest document of a unit, and changes of a unit's total between
snapshots raise alerts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veritally.sources import schemas
from veritally.streaming.state import LatestTable

TOTALS = schemas.record(unit_id=schemas.TEXT, ts=T.TimestampType(), total=schemas.LONG)


def read_snapshots(spark: SparkSession, folder: str, lines: bool = False, files: int | None = None) -> DataFrame:
    """(unit_id, ts, candidates, parties) of the JSON files that land in a folder; ``lines``: one object a line;
    ``files``: at most so many files a micro-batch."""
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    rows = reader.schema(schemas.UNIT_DOCUMENT).json(folder, multiLine=not lines)
    return rows.withColumn("ts", F.to_timestamp("timestamp"))


def totals(documents: DataFrame) -> DataFrame:
    """(unit_id, ts, total): votes of a document; candidates win over parties even if empty."""
    items = F.when(F.col("candidates").isNotNull(), F.col("candidates")).otherwise(F.col("parties"))
    votes = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c["votes"], F.lit(0)))
    return documents.select("unit_id", "ts", F.coalesce(votes, F.lit(0)).alias("total"))


def latest(totals: DataFrame, *ties: str) -> DataFrame:
    """The newest total of each unit; of equal times the one with the greatest ``ties``, then the greatest total."""
    return totals.groupBy("unit_id").agg(F.max(F.struct("ts", *ties, "total")).alias("m")).select("unit_id", "m.ts", "m.total")


def into_state(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For each micro-batch of changed units: the newest total of every unit so far, in a :class:`LatestTable`."""
    return state_table(spark, folder).put


def state_table(spark: SparkSession, folder: str) -> LatestTable:
    return LatestTable(spark, folder, TOTALS, ["unit_id"], "ts")


def changes(before: DataFrame, after: DataFrame, alert_over: int) -> DataFrame:
    """(unit_id, total_before, total_after, change, alert) of units in both snapshots that changed."""
    a, b = before.select("unit_id", F.col("total").alias("total_before")), after.select("unit_id", F.col("total").alias("total_after"))
    change = F.col("total_after") - F.col("total_before")
    return a.join(b, "unit_id").withColumn("change", change).where("change <> 0").withColumn("alert", F.abs("change") > alert_over)


def activity(totals: DataFrame, window: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Documents and units seen in each window of event time, late data up to a watermark."""
    seen = totals.withWatermark("ts", late).groupBy(F.window("ts", window))
    return seen.agg(F.count("*").alias("documents"), F.approx_count_distinct("unit_id").alias("units")).select("window.start", "window.end", "documents", "units")


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process all that has landed since the last run in micro-batches, then stop.

    ``mode`` "update" is for aggregates such as :func:`latest` of a stream: their
    state is a row for each unit, and a batch hands on only the units it changed.
    """
    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

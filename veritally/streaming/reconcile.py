"""Two sources as streams: their documents joined by unit and time, compared, and alerts on changed levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veritally.operators import compare
from veritally.streaming.state import LatestTable

LEVELS = T.StructType([T.StructField("unit_id", T.StringType()), T.StructField("start", T.TimestampType()), T.StructField("level", T.StringType())])


def entries(documents: DataFrame) -> DataFrame:
    """(unit_id, ts, entries): a document's list, candidates before parties even if empty."""
    items = F.when(F.col("candidates").isNotNull(), F.col("candidates")).otherwise(F.col("parties"))
    return documents.select("unit_id", "ts", F.coalesce(items, F.array().cast("array<struct<name:string,votes:bigint>>")).alias("entries"))


def windows_latest(documents: DataFrame, window: str, late: str) -> DataFrame:
    """(unit_id, window, entries) of the newest document of each unit and window of event time; later ones than ``late`` are dropped."""
    seen = documents.where("unit_id is not null and ts is not null").withWatermark("ts", late)
    return seen.groupBy("unit_id", F.window("ts", window)).agg(F.max(F.struct("ts", "entries")).alias("m")).select("unit_id", "window", "m.entries")


def _counted(entries: Column, name: Column) -> Column:
    """Votes of a name's last entry, 0 without one."""
    own = F.filter(entries, lambda x: x["name"].eqNullSafe(name))
    return F.coalesce(F.try_element_at(own, F.lit(-1))["votes"], F.lit(0))


def _total(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["votes"], F.lit(0)))


def compared(official: DataFrame, citizen: DataFrame, window: str = "1 hour", late: str = "10 minutes", policy: compare.Policy = compare.POLICIES["code"]) -> DataFrame:
    """(unit_id, start, end, sides, official_total, citizen_total, difference, n_discrepant, n_missing, level) for each unit and window of time.

    ``official`` and ``citizen``: (unit_id, ts, entries), streams or tables.  The
    newest documents of both in a window are joined by a full outer join, so a unit
    that one source lacks comes out as well (sides ``official`` or ``citizen``, level
    null), once the watermark has passed the window; of streams only such windows
    come out.  Candidates are compared within the row: a ballot bounds their number.
    """
    o = windows_latest(official, window, late).select(F.col("unit_id").alias("o_unit"), F.col("window").alias("o_window"), F.col("entries").alias("o"))
    c = windows_latest(citizen, window, late).select(F.col("unit_id").alias("c_unit"), F.col("window").alias("c_window"), F.col("entries").alias("c"))
    both = o.join(c, (F.col("o_unit") == F.col("c_unit")) & (F.col("o_window") == F.col("c_window")), "full_outer")
    names = F.array_union(F.transform("o", lambda x: x["name"]), F.transform("c", lambda x: x["name"]))
    diff = F.transform(names, lambda n: F.struct(_counted(F.col("o"), n).alias("x"), _counted(F.col("c"), n).alias("y")))
    at = F.coalesce("o_window", "c_window")
    sides = F.when(F.col("c").isNull(), "official").when(F.col("o").isNull(), "citizen").otherwise("both")
    rows = both.select(F.coalesce("o_unit", "c_unit").alias("unit_id"), at["start"].alias("start"), at["end"].alias("end"), sides.alias("sides"), _total(F.col("o")).alias("official_total"), _total(F.col("c")).alias("citizen_total"), diff.alias("diff"))
    count = lambda test: F.size(F.filter("diff", test))
    missing = count(lambda d: (d["x"] == 0) != (d["y"] == 0))
    apart = F.abs(F.col("official_total") - F.col("citizen_total"))
    rows = rows.select("*", apart.alias("difference"), count(lambda d: d["x"] != d["y"]).alias("n_discrepant"), missing.alias("n_missing")).drop("diff")
    level = compare.level(F.col("difference"), F.col("official_total"), F.col("n_missing"), policy)
    return rows.withColumn("level", F.when(F.col("sides") == "both", level))


def level_changes(rows: DataFrame) -> DataFrame:
    """(unit_id, start, level_before, level): windows whose level isn't that of the unit's compared window before."""
    before = F.lag("level").over(Window.partitionBy("unit_id").orderBy("start"))
    known = rows.where("level is not null").select("unit_id", "start", before.alias("level_before"), "level")
    return known.where("level_before <> level")


def alerts_into(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For each micro-batch of :func:`compared`: its rows to ``folder``/compared/batch=n, alerts on changed levels to
    ``folder``/alerts/batch=n, and the units' last levels to a :class:`LatestTable`.

    Levels before the batch come from that table, of the batch's units only.  All
    three are written again by a batch that is repeated.
    """
    last = LatestTable(spark, f"{folder}/levels", LEVELS, ["unit_id"], "start")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/compared/batch={number}")
        batch = spark.read.schema(batch.schema).parquet(f"{folder}/compared/batch={number}")
        own = batch.where("level is not null").select("unit_id", "start", "level")
        before = last.read(number).join(own.select("unit_id").distinct(), "unit_id", "left_semi")
        changed = level_changes(own.unionByName(before)).join(own.select("unit_id", "start"), ["unit_id", "start"], "left_semi")
        changed.write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
        last.put(own, number)

    return each


def run(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed since the last run, then stop; see :func:`alerts_into`."""
    return rows.writeStream.outputMode("append").foreachBatch(alerts_into(rows.sparkSession, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

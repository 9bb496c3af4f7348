"""A table of the latest row of each key, fed by micro-batches in proportion to their size.

Each micro-batch is written as a run of its own.  Whenever ``fan`` runs of one size
have gathered they are merged to one of the next, so that a row is written again
only as often as the logarithm of the number of batches, and there are at most
``fan - 1`` runs of each size.  Which runs hold the table after batch n follows from
n alone: a batch that is repeated after a failure writes the same runs again, and
what it merged is deleted by the batch after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def active_runs(count: int, fan: int) -> list[tuple[int, int]]:
    """(size, last batch) of the runs that hold ``count`` batches, the oldest first."""
    out, left, upto, size = [], count, 0, 0
    while fan ** (size + 1) <= count:
        size += 1
    for k in range(size, -1, -1):
        for _ in range(left // fan**k):
            upto += fan**k
            out.append((k, upto))
        left %= fan**k
    return out


class LatestTable:
    """The row of each key with the greatest ``order``; ties by the other columns.

    ``folder`` is one that driver and executors share.  Runs are partitioned by
    nothing and sorted by key, so that readers of a few keys skip most of them.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], order: str, fan: int = 8):
        self.spark, self.folder, self.schema, self.keys, self.order, self.fan = spark, folder, schema, list(keys), order, fan

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/size={run[0]}/upto={run[1]}"

    def latest(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema if f.name not in (*self.keys, self.order)]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(self.order, *rest)).alias("_m"))
        return best.select(*[c if c in self.keys else F.col(f"_m.{c}").alias(c) for c in self.schema.names])

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        self.latest(rows).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(self._path(run))

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._path, runs))

    def put(self, batch: DataFrame, number: int) -> None:
        """Adds the rows of micro-batch ``number`` (from 0, without gaps)."""
        if number:
            gone = set(active_runs(number - 1, self.fan)) - set(active_runs(number, self.fan))
            gone |= {(k, number) for k in range(self.fan) if number % self.fan**k == 0} - set(active_runs(number, self.fan))
            self._delete(sorted(gone))
        run = (0, number + 1)
        self._write(batch.select(*self.schema.names), run)
        while run[1] % self.fan ** (run[0] + 1) == 0:
            size = self.fan ** run[0]
            merged = (run[0] + 1, run[1])
            self._write(self._read([(run[0], run[1] - k * size) for k in range(self.fan)]), merged)
            run = merged

    def read(self, batches: int) -> DataFrame:
        """The table after so many batches."""
        return self.latest(self._read(active_runs(batches, self.fan)))

    def _delete(self, runs: list[tuple[int, int]]) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for run in runs:
            path = hadoop(self._path(run))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

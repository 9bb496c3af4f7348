"""Folds over sorted rows: what has to read a group in order, in bounded memory."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def fold_sorted(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], start: Callable[[], object], schema: T.StructType) -> DataFrame:
    """One row for each group: its keys and what ``start()`` makes of its rows.

    ``start()`` gives an object with ``add(row)``, called with each row of a group
    (a dict) in ``order``, and ``result()``, which returns a tuple of ``schema``'s
    columns.  Rows are sorted by Spark, which spills, and read in batches: a task
    holds a batch and one object, however large a group is.
    """
    keys = list(keys)
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    out = T.StructType([rows.schema[k] for k in keys] + list(schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, key, fold, done = None, None, None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow)], names=out.names)
            done.clear()
            return batch

        arrow = [to_arrow(f.dataType) for f in out]
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if fold is None or own != key:
                    if fold is not None:
                        done.append(key + tuple(fold.result()))
                    key, fold = own, start()
                fold.add(row)
            if done:
                yield flush()
        if fold is not None:
            done.append(key + tuple(fold.result()))
            yield flush()

    return placed.mapInArrow(run, out)


def to_arrow(kind: T.DataType) -> pa.DataType:
    """The Arrow type of a long, string, int, double or binary column."""
    return {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary()}[kind]


class Joined:
    """SHA-256 of the strings of column ``page``, with ``between`` them."""

    def __init__(self, between: str = ""):
        self.digest, self.between, self.first = hashlib.sha256(), between.encode(), True

    def add(self, row: dict) -> None:
        if not self.first:
            self.digest.update(self.between)
        self.first = False
        self.digest.update(row["page"].encode())

    def result(self) -> tuple[str]:
        return (self.digest.hexdigest(),)

"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions.shared import checkpoint  # noqa: F401 (the operators take it from here)

#: Word separators of every tokenising operator: space and 0x09-0x0D, which is
#: what ``bytes.split()`` splits on.  ``bytes.lower()`` changes A-Z only.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; -1 where the key is null."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus), F.lit(-1).cast("long"))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which at a task's end forgets and gives what it has freed back to the system.

    Spark keeps Python workers for later tasks and stages; what their allocators
    hold on to would add up over a session.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # of glibc
                trim(0)

    return task

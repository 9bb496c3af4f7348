"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Times as many rows as a sample takes are expected below its bound of hashes; with hundreds of rows, fewer than the sample are out of the question.
SPARE = 2
#: Characters of a sample's texts at most, together: what the driver gathers.
MOST_CHARS = 128_000_000


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int, max_labels: int = 256) -> DataFrame:
    """(key, label) of at most ``per_label`` rows for each label; more than ``max_labels`` labels are an error.

    The rows with the least hash of their key are taken, so the sample does not
    depend on the partitioning.  Labels are counted first; of each only hashes
    below a bound that about ``SPARE * per_label`` rows meet go to the window that
    ranks them, so no label gathers more, however many rows it has.  Null keys
    and labels are left out; repeated keys count once, with their greatest label.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    labels = known.groupBy(label).agg(F.count("*").alias("_rows"))
    found = labels.limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise ValueError(f"more than {max_labels} labels in {label}")
    labels = rows.sparkSession.createDataFrame([tuple(r) for r in found], labels.schema)
    hashed = known.join(F.broadcast(labels), label).withColumn("_hash", F.xxhash64(F.col(key)))
    place = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    near = hashed.where(place * F.col("_rows") <= SPARE * per_label)
    order = Window.partitionBy(label).orderBy(F.shiftrightunsigned("_hash", 11), F.col(key))
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).select(key, label)


def sample_texts(docs: DataFrame, sample: DataFrame, key: str, text: str, label: str, max_chars: int) -> list[tuple[bytes, object]]:
    """(UTF-8 text, label) of the sampled rows, in order of their keys.

    Texts over ``max_chars`` characters, or over an equal share of MOST_CHARS, are
    left out of the sample (not cut), so that it stays bounded however many labels
    there are; null texts are left out as well.
    """
    longest = min(max_chars, MOST_CHARS // max(1, sample.count()))
    chosen = docs.select(key, text).where(F.length(text) <= longest).join(F.broadcast(sample), key)
    rows = chosen.select(key, label, F.col(text).cast("binary").alias("_text")).dropDuplicates([key]).collect()
    return [(bytes(r["_text"]), r[label]) for r in sorted(rows, key=lambda r: r[key])]

"""A corpus pipeline: five operators in a row over ``documents``.

Languages are identified and undecided documents rejected, low-quality
documents rejected, near-duplicates reduced to one of each group, sources mixed
to target weights, and what is left encoded.  Every stage works on all that the
stage before it kept; all but the last return the columns of ``documents`` and
drop others.  Nulls in any column, repeated rows and ids, very long texts and
empty tables are allowed everywhere; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import bpe, langid, mixing, quality_knn, simhash
from veritally.llm.common import checkpoint, table
from veritally.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undecided: without letters (null and empty texts too), or unlike every language.

    Languages are learned from the rows with a ``lang``; without any, all rows go.
    Repeated rows share a verdict; equal odds go to the first language by name.
    """
    found = langid.identify(docs, langid.train_on(docs))
    return found.where(~F.col("rejected")).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the neighbours vote to be of low quality, and those without a word.

    Without labels the vote is even and the others stay; a tie keeps a document.
    Repeated rows share a verdict.
    """
    model = quality_knn.train_on(docs, table(spark, sf_dir, "labels"))
    return quality_knn.score(docs, model).where("predicted = 1").select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, as the operator's query defines them: the least doc_id.

    Null and empty texts are a group.  Of repeated and null ids one row of a group
    stays all the same.
    """
    return simhash.deduplicate(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule; a null source is a source.

    Slots of a source that has run dry are passed over, so the others go on in
    proportion to their weights; none is dropped because another is small.
    """
    mixed = mixing.mix(docs, power=0.7, block_rows=16)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256) of each row: its token ids, and digests of them and of the text they decode to.

    A null or empty text has no ids.
    """
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), TOKENIZER)
    return coded.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", remove_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifiers and the schedule have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is cut off by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs

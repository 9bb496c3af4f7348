"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured once (counts of words, symbols, repeated lines and
repeated three-word windows).  For every language and source a sketch of each
measure is kept: counts of logarithmic bins, whose quantiles are right to a
fixed relative error.  Sketches merge by adding counts, so they are plain
partial aggregations.  Thresholds are fences beyond two of the group's
quantiles, by the distance between them; shares that are zero in most documents
take upper quantiles of those above zero.  A group's quantiles are drawn to its
language's, these to those of all documents, and these to zero for the shares,
the more the fewer documents they come from.  Documents are joined with the thresholds and filtered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm.common import checkpoint

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Relative error of a sketch's quantiles is about half of this.
BIN_GROWTH = 0.02
#: Documents that the wider group's quantiles count as beside those of the group.
PRIOR_ROWS = 100.0
#: Documents with a share of zero that all documents' quantiles of shares above zero are drawn to: what hardly any document has is not usual.
ZERO_ROWS = 10.0
#: Fences lie so many times the distance of the two quantiles beyond them.
REACH = 3.0
#: A document of so many words has its mean word length's fences wider by the square root of two; long documents by nothing.
FEW_WORDS = 150.0
#: measure -> (numerator, denominator, the quantiles of its values above zero, two-sided).
MEASURES = {
    "word_length": ("word_chars", "n_words", (0.25, 0.75), True),
    "symbol_share": ("n_symbols", "n_words", (0.75, 0.95), False),
    "dup_line_share": ("n_dup_lines", "n_lines", (0.75, 0.95), False),
    "repeat_share": ("n_repeat_words", "n_words", (0.75, 0.95), False),
}
#: Threshold rows up to which they are broadcast; beyond, Spark shuffles and splits skew.
BROADCAST_GROUPS = 20_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    pairs = number[:-1] * size + number[1:]
    if size > 2_000_000:  # the product of three would not fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs[:-1] * size + number[2:], return_inverse=True, return_counts=True)
    often = counts[where] >= 2
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : k + n - 2] |= often
    return int(inside.sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS (longs) of the whole text; null is empty. Columns of these names are replaced.

    A line counts if it has a word; it is a repeat if it equals an earlier one.
    """
    keep = [c for c in docs.columns if c not in COUNTS]
    out = [c for c in keep if c != text]
    schema = T.StructType([docs.schema[c] for c in out] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep.index(text)).cast(pa.binary())
            rows = np.array([measure_text(x.as_py() or b"") for x in texts], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(keep.index(c)) for c in out] + [pa.array(rows[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*out, *COUNTS])

    return docs.select(*[docs[c] for c in keep]).mapInArrow(run, schema)


def _value(name: str) -> Column:
    over, under, _, _ = MEASURES[name]
    return F.col(over) / F.when(F.col(under) > 0, F.col(under))


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bin, n): the sketch of each measure in each group.

    Bin b > 0 holds values around exp(growth * (b - offset)); bin 0 holds zeros.
    """
    values = F.array(*[F.struct(F.lit(m).alias("measure"), _value(m).alias("value")) for m in MEASURES])
    long = measured.select(*groups, F.explode(values).alias("x")).select(*groups, "x.*").where("value is not null")
    width, least = math.log1p(BIN_GROWTH), 1e-9
    bins = F.when(F.col("value") < least, 0).otherwise(F.floor(F.log(F.col("value") / least) / width) + 1)
    return long.groupBy(*groups, "measure", bins.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, rows, q1, q2) of the values above zero, from sketches; merging is a sum over bins."""
    merged = sketch.where("bin > 0").groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*groups, "measure")
    ranked = merged.withColumn("rows", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("bin")))
    middle = F.lit(1e-9) * F.exp((F.col("bin") - 0.5) * math.log1p(BIN_GROWTH))

    def quantile(i: int) -> Column:
        share = F.element_at(F.create_map(*[F.lit(x) for m, (_, _, shares, _) in MEASURES.items() for x in (m, shares[i])]), F.col("measure"))
        return F.min(F.when(F.col("upto") >= share * F.col("rows"), middle))

    return ranked.groupBy(*groups, "measure").agg(F.max("rows").alias("rows"), quantile(0).alias("q1"), quantile(1).alias("q2"))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, <measure>_q1, <measure>_q2, <measure>_spread) for each language and source of ``measured``.

    The spread is the distance of the quantiles, at least the sketch's resolution.
    A measure that is zero in all documents has nulls: it holds nothing off.
    """
    sketch = checkpoint(sketches(measured, [lang, source]))
    named = lambda df, name, *keys: df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("measure").alias(f"_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in ("rows", "q1", "q2")])
    groups = sketch.select(lang, source, "measure").distinct()
    own, wide, every = named(quantiles(sketch, [lang, source]), "own", lang, source), named(quantiles(sketch, [lang]), "wide", lang), named(quantiles(sketch, []), "every")
    joined = groups.join(own, groups[lang].eqNullSafe(F.col(f"_own_{lang}")) & groups[source].eqNullSafe(F.col(f"_own_{source}")) & (F.col("measure") == F.col("_own")), "left")
    joined = joined.join(wide, joined[lang].eqNullSafe(F.col(f"_wide_{lang}")) & (F.col("measure") == F.col("_wide")), "left").join(F.broadcast(every), F.col("measure") == F.col("_every"), "left")

    def drawn(rows: str, q: Column, wider: Column) -> Column:
        n = F.coalesce(rows, F.lit(0))
        return (n * F.coalesce(q, F.lit(0.0)) + PRIOR_ROWS * wider) / (n + PRIOR_ROWS)

    both = F.col("measure").isin(*[m for m, (*_, both) in MEASURES.items() if both])
    usual = lambda q: F.col(f"every_{q}") * F.when(both, 1.0).otherwise(F.col("every_rows") / (F.col("every_rows") + ZERO_ROWS))
    fence = lambda q: drawn("own_rows", F.col(f"own_{q}"), drawn("wide_rows", F.col(f"wide_{q}"), usual(q)))
    fenced = joined.select(lang, source, "measure", fence("q1").alias("q1"), fence("q2").alias("q2"))
    fenced = fenced.withColumn("spread", F.greatest(F.col("q2") - F.col("q1"), BIN_GROWTH * F.col("q2")))
    one = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return fenced.groupBy(lang, source).agg(*[one(m, c) for m in MEASURES for c in ("q1", "q2", "spread")])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, kept and the rules broken.

    base_failed: fewer than 50 words, or over half of them in repeated windows.
    The sketches cover every document that passes the base rules; a document is
    kept if it passes them and lies within the fences of its language and
    source: REACH spreads beyond their quantiles, those of the mean word length
    wider for documents of few words, whose mean scatters.  Null languages and sources form groups of their own; a null or
    empty text has zero counts and fails the base rules.  Repeated rows each
    count and get the same verdict; an empty table gives an empty one.  Columns
    of ``docs`` other than the four named are ignored.
    """
    measured = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = checkpoint(measure(measured))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limits = checkpoint(thresholds(measured.where(~failed)))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    small = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = measured.join(F.broadcast(limits) if small else limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = []
    for m, (_, _, _, both) in MEASURES.items():
        reach = REACH * F.col(f"{m}_spread") * (F.sqrt(1 + FEW_WORDS / F.col("n_words")) if both else 1.0)
        outside = _value(m) > F.col(f"{m}_q2") + reach
        outside = outside | (_value(m) < F.col(f"{m}_q1") - reach) if both else outside
        broken.append(F.when(outside, F.lit(m)))
    rules = F.array_compact(F.array(*broken))
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.size(rules) == 0)).alias("kept"), rules.alias("rules_broken"))

"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of terms: its words hashed to buckets, the shapes of its words
(letters, capitals, digits and signs, runs folded) hashed to buckets, and levels
of how many of its three-word windows repeat.  Shares are damped, weighted by the
sample's inverse document frequencies and projected on the sample's leading
singular vectors.  The labelled vectors, a bounded sample balanced by label, are
broadcast; every document's exact cosines with all of them are a blocked matrix
product, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm.common import released
from veritally.llm.samples import bounded_sample, sample_texts
from veritally.llm.words import BLOCK_BYTES, Features, blocks, raw_texts

WORD_TERMS = 1536
SHAPE_TERMS = 504
#: A term for each share of repeated windows that a text reaches.
LEVELS = np.array([0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9])
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
TERMS = WORD_TERMS + SHAPE_TERMS + len(LEVELS)
#: Weight of shapes and levels against words, of which there are many more.
STRENGTH = np.repeat(np.float32([1, 2, 3]), (WORD_TERMS, SHAPE_TERMS, len(LEVELS)))
#: Term numbers of a word: of its letters and of its shape.
SHAPES = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


RUN = re.compile(rb"(.)\1+", re.S)


def word_terms(words: list[bytes]) -> np.ndarray:
    """Of each word the term of its letters, that of its shape (runs folded) and a hash."""
    out = np.zeros((len(words), 3), np.int64)
    for i, w in enumerate(words):
        out[i, 0] = xxhash.xxh32_intdigest(w.translate(None, SIGNS).lower(), 1) % WORD_TERMS
        out[i, 1] = WORD_TERMS + xxhash.xxh32_intdigest(RUN.sub(rb"\1", w.translate(SHAPES)), 2) % SHAPE_TERMS
        out[i, 2] = xxhash.xxh64_intdigest(w, 3) >> 1
    return out


def _windows(hashes: np.ndarray) -> np.ndarray:
    """A hash of each three-word window, of the words' hashes."""
    a, b, c = hashes[:-2].view(np.uint64), hashes[1:-1].view(np.uint64), hashes[2:].view(np.uint64)
    return ((a * GOLDEN + b) * GOLDEN + c) * GOLDEN


def _levels(once: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of the level terms: a text's words for each level that its share of repeated windows reaches."""
    repeated = 1 - once / np.maximum(windows, 1)
    return np.where((windows > 0)[:, None] & (repeated[:, None] >= LEVELS), lengths[:, None], 0)


def count_terms(texts: list[bytes], features: Features) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (first, term counts of a run of texts), each text once.

    A long text is counted in parts that are added up; its windows are gathered
    over all parts, so that its share of repeated ones is that of the whole text.
    """
    held, parts, size, at = np.zeros((1, TERMS), np.float32), [], 0, -1
    for first, words, lengths in blocks(texts, lower=False, overlap=2):
        if at >= 0 and first != at:
            held[0, -len(LEVELS) :] = _levels(np.array([len(np.unique(np.concatenate(parts)))]), np.array([sum(map(len, parts))]), np.array([size]))[0]
            yield at, held
            held, parts, size, at = np.zeros((1, TERMS), np.float32), [], 0, -1
        table, ids = features(words)
        rows, n = table[ids] if len(ids) else np.zeros((0, 3), np.int64), len(lengths)
        row = np.repeat(np.arange(n), lengths)
        long = len(texts[first]) > BLOCK_BYTES
        skip = 2 if long and at == first else 0  # words of the part before
        counts = np.zeros((n, TERMS), np.float32)
        for k in range(2):
            counts += np.bincount(row[skip:] * TERMS + rows[skip:, k], minlength=n * TERMS).reshape(n, TERMS)
        window = _windows(np.ascontiguousarray(rows[:, 2]))
        if long:
            at, size = first, size + len(rows) - skip
            held += counts
            parts.append(window)
            continue
        inside = row[2:] == row[:-2]
        of, window = row[2:][inside], window[inside] ^ (row[2:][inside].astype(np.uint64) * GOLDEN)
        once = np.bincount(of[np.unique(window, return_index=True)[1]], minlength=n)
        counts[:, -len(LEVELS) :] = _levels(once, np.bincount(of, minlength=n), lengths)
        yield first, counts
    if at >= 0:
        held[0, -len(LEVELS) :] = _levels(np.array([len(np.unique(np.concatenate(parts)))]), np.array([sum(map(len, parts))]), np.array([size]))[0]
        yield at, held


def damped(counts: np.ndarray) -> np.ndarray:
    """log(1 + 200 x share of the text's words) of each term."""
    words = counts[:, :WORD_TERMS].sum(axis=1, keepdims=True)
    return np.log1p(200 * counts / np.maximum(words, 1)).astype(np.float32)


@dataclass
class NeighbourModel:
    """idf and projection give the vectors; labelled: unit rows with their labels."""

    idf: np.ndarray
    projection: np.ndarray
    labelled: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = (damped(counts) * self.idf) @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, block: int = 1024) -> np.ndarray:
        """Share of label 1 among the neighbours' votes; the prior without a similar one, 0 without a word.

        Of equally similar vectors at the last place any may vote.
        """
        out = np.full(len(counts), self.prior)
        k = min(self.neighbours, len(self.labelled))
        for i in range(0, len(counts) if k else 0, block):
            cosine = self.vectors(counts[i : i + block]) @ self.labelled.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1)
            out[i : i + block] = np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.prior)
        return np.where(counts[:, :WORD_TERMS].any(axis=1), np.clip(out, 0.0, 1.0), 0.0)


def fit(sample: list[tuple[bytes, int]], dimensions: int = 64, neighbours: int = 15, oversample: int = 16, seed: int = 11) -> NeighbourModel:
    """Latent space and labelled vectors of a sample of texts and labels 0 or 1."""
    labels = np.array([float(y) for _, y in sample])
    if len(sample):
        parts = np.zeros((len(sample), TERMS), np.float32)
        for first, counts in count_terms([t for t, _ in sample], Features(word_terms)):
            parts[first : first + len(counts)] = counts
    else:
        parts = np.zeros((0, TERMS), np.float32)
    idf = np.log((1 + len(sample)) / (1 + (parts > 0).sum(axis=0))).astype(np.float32) * STRENGTH + 0.1
    x = damped(parts) * idf
    random = np.random.default_rng(seed)
    k = max(1, min(dimensions, len(sample)))
    basis = random.standard_normal((TERMS, k + oversample)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0] if len(sample) else np.linalg.qr(basis)[0]
    small = x @ basis
    projection = basis @ np.linalg.svd(small, full_matrices=False)[2].T[:, :k] if len(sample) else basis[:, :k]
    model = NeighbourModel(idf, projection.astype(np.float32), np.zeros((0, k), np.float32), labels, neighbours, float(labels.mean()) if len(sample) else 0.5)
    model.labelled = model.vectors(parts)
    return model


def train_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 1500, max_chars: int = 40_000) -> NeighbourModel:
    """Fit on at most ``per_label`` rows of each label, texts up to ``max_chars``."""
    sample = bounded_sample(labels.where(F.col(label).isin(0, 1)), doc_id, label, per_label)
    return fit(sample_texts(docs, sample, doc_id, text, label, max_chars))


def score(docs: DataFrame, model: NeighbourModel, text: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Whole texts count, those of any length by the same terms; a null or empty one,
    or one without a word, scores 0: nothing speaks for its quality.  Without
    labelled rows all others score 0.5.  Row by row: repeated rows score the same,
    an empty table gives an empty one; columns called score or predicted are
    replaced, others kept.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features(word_terms)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, counts in count_terms(raw_texts(batch.column(keep.index(text))), features):
                out[first : first + len(counts)] = model.score(counts)
            new = [pa.array(out), pa.array((out >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new], names=[*keep, "score", "predicted"])

    return docs.select(*[docs[c] for c in keep]).mapInArrow(released(run), schema)

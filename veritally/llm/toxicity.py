"""Toxicity by a convolutional text classifier, with thresholds by language.

Words are hashed to the buckets of an embedding table of fixed size, filters of
several widths slide over a text and each filter's greatest response feeds a
logistic layer.  Everything is trained in numpy on a bounded sample balanced by
label; buckets that too few sample texts hit stay zero, so that rare words say
nothing, and take no room.  On held-back
sample rows a threshold is fitted for each language, weighted to the labels'
natural frequency; the language is guessed from the text alone.  The score is
the logistic of the distance to that threshold.

Filters are linear before the pooling, so a trained model needs, for each trained
bucket, one row with its response at each place in each filter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm import langid
from veritally.llm.samples import bounded_sample, sample_texts
from veritally.llm.words import Features, blocks, raw_texts, sums

WIDTHS = (1, 2, 3)
FILTERS = 12
WIDTH = 16
#: Buckets of the embedding table: a rare word seldom falls into a trained one.
BUCKETS = 1 << 20
#: Sample texts that must hit a bucket for it to be trained.
LEAST_TEXTS = 5
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


def bucket(word: bytes) -> int:
    """Bucket of a word's letters and digits in lower case."""
    return xxhash.xxh64_intdigest(word.lower().translate(None, SIGNS)) % BUCKETS


@dataclass
class ToxicityModel:
    """rows: the row of each bucket (0: not trained); places: a row for each trained
    bucket; language: what a word of it says of the language; thresholds: by language,
    the last for none."""

    rows: np.ndarray
    places: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    language: np.ndarray
    guess: langid.LanguageModel | None
    thresholds: np.ndarray
    scale: float = 1.0

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        return self.rows[np.fromiter(map(bucket, words), np.int64, len(words))]

    def pooled(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Greatest response of each filter for each run of words, over the places of its words (one place for none).

        Windows may reach into the padding behind a run, never into the next run.
        """
        tail, places = max(WIDTHS) - 1, np.maximum(lengths, 1)
        ends = np.cumsum(places + tail)
        starts, n = ends - places - tail, int(ends[-1]) if len(ends) else 0
        padded = np.zeros(n + tail, np.int64)
        padded[np.arange(len(rows)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)] = rows
        beyond = np.arange(n) - np.repeat(starts, places + tail) >= np.repeat(places, places + tail)
        best, column = [], 0
        for width in WIDTHS:
            response = self.places[padded[:n], column : column + FILTERS].copy()
            for k in range(1, width):
                response += self.places[padded[k : n + k], column + k * FILTERS : column + (k + 1) * FILTERS]
            response[beyond] = -np.inf
            best.append(np.maximum.reduceat(response, starts, axis=0))
            column += width * FILTERS
        return np.concatenate(best, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.offset

    def languages(self, totals: np.ndarray) -> np.ndarray:
        """Number of each text's likeliest language from summed rows, the last for none."""
        if self.guess is None:
            return np.zeros(len(totals), np.int64)
        best = self.guess.decide(totals)[0]
        return np.where(best < 0, len(self.guess.languages), best)

    def score(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((logits - self.thresholds[languages]) * self.scale, -30, 30)))

    def scores(self, texts: list[bytes], features: Features) -> np.ndarray:
        """Scores of whole texts; long ones are pooled over overlapping parts."""
        most = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        totals = np.zeros((len(texts), self.language.shape[1]))
        for first, words, lengths in blocks(texts, overlap=max(WIDTHS) - 1):
            table, ids = features(words)
            rows = table[ids] if len(ids) else np.zeros(0, np.int32)
            here = slice(first, first + len(lengths))
            most[here] = np.maximum(most[here], self.pooled(rows, lengths))
            totals[here] += sums(self.language[rows], lengths)
        return self.score(self.logits(most), self.languages(totals))


def trained_buckets(texts: list[list[bytes]]) -> np.ndarray:
    """The row of each bucket: from 1 for those that LEAST_TEXTS texts hit, else 0."""
    hits = np.zeros(BUCKETS, np.int32)
    for words in texts:
        hits[list({bucket(w) for w in words})] += 1
    rows = np.zeros(BUCKETS, np.int32)
    there = np.flatnonzero(hits >= LEAST_TEXTS)
    rows[there] = np.arange(1, len(there) + 1)
    return rows


def _threshold(logits: np.ndarray, labels: np.ndarray, weight: float, usual: float | None = None) -> float:
    """The cut with the best F1 when each negative counts ``weight``; ties near ``usual``.

    Cuts lie midway between neighbouring logits.  Without both labels: ``usual``.
    """
    if usual is not None and (labels.sum() < 20 or (labels == 0).sum() < 20):
        return usual
    if not labels.any() or labels.all():
        return 0.0
    order = np.argsort(-logits)
    hits, false = np.cumsum(labels[order]), np.cumsum((1 - labels[order]) * weight)
    f1 = 2 * hits / (hits + false + labels.sum())
    at = int(f1.argmax())
    ranked = logits[order]
    return float((ranked[at] + ranked[min(at + 1, len(ranked) - 1)]) / 2)


def fit(sample: list[tuple[bytes, int]], negatives_weight: float = 1.0, guess: langid.LanguageModel | None = None, epochs: int = 12, rate: float = 0.05, batch: int = 32, decay: float = 1e-4, seed: int = 5) -> ToxicityModel:
    """Train on texts and labels 0 or 1 by Adam steps; every fifth is held back for the thresholds."""
    texts = [text.lower().split() for text, _ in sample]
    labels = np.array([float(y) for _, y in sample])
    is_held = np.arange(len(sample)) % 5 == 4
    rows = trained_buckets([t for t, h in zip(texts, is_held) if not h])
    count = int(rows.max(initial=0)) + 1
    random = np.random.default_rng(seed)
    shapes = {"embed": (count, WIDTH), "bias": (FILTERS * len(WIDTHS),), "out": (FILTERS * len(WIDTHS),), "offset": (1,)} | {f"w{w}": (w * WIDTH, FILTERS) for w in WIDTHS}
    p = {k: random.standard_normal(s).astype(np.float32) * {"embed": 0.3, "out": 0.3}.get(k, 0.25 if k[0] == "w" else 0.0) for k, s in shapes.items()}
    p["embed"][0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    known = [rows[np.fromiter(map(bucket, t), np.int64, len(t))].astype(np.int64) for t in texts]

    def model() -> ToxicityModel:
        places = [p["embed"] @ p[f"w{w}"][k * WIDTH : (k + 1) * WIDTH] for w in WIDTHS for k in range(w)]
        return ToxicityModel(rows, np.concatenate(places, axis=1).astype(np.float32), p["bias"], p["out"], float(p["offset"][0]), np.zeros((count, 1), np.float32), None, np.zeros(1))

    tail = max(WIDTHS) - 1
    train = np.flatnonzero(~is_held)
    step = 0
    for _ in range(epochs if len(train) else 0):
        random.shuffle(train)
        for i in range(0, len(train), batch):
            step += 1
            grad = {k: np.zeros_like(v) for k, v in p.items() if k != "embed"}
            touched: list[np.ndarray] = []
            pushed: list[np.ndarray] = []
            here = train[i : i + batch]
            for j in here:
                seq = np.concatenate((known[j], np.zeros(tail, np.int64))) if len(known[j]) else np.zeros(tail + 1, np.int64)
                n, e = len(seq) - tail, p["embed"][seq]
                tops, wheres = [], []
                for w in WIDTHS:
                    response = sum(e[k : n + k] @ p[f"w{w}"][k * WIDTH : (k + 1) * WIDTH] for k in range(w))
                    wheres.append(response.argmax(axis=0))
                    tops.append(response[wheres[-1], np.arange(FILTERS)])
                hidden = np.concatenate(tops) + p["bias"]
                active = np.maximum(hidden, 0)
                error = 1 / (1 + np.exp(-np.clip(active @ p["out"] + p["offset"][0], -30, 30))) - labels[j]
                error = np.float32(error / len(here))
                grad["out"] += error * active
                grad["offset"] += error
                back = error * p["out"] * (hidden > 0)
                grad["bias"] += back
                for a, w in enumerate(WIDTHS):
                    push = back[a * FILTERS : (a + 1) * FILTERS]
                    for k in range(w):
                        at = seq[wheres[a] + k]
                        part = slice(k * WIDTH, (k + 1) * WIDTH)
                        grad[f"w{w}"][part] += p["embed"][at].T * push
                        touched.append(at)
                        pushed.append(push[:, None] * p[f"w{w}"][part].T)
            at, where = np.unique(np.concatenate(touched), return_inverse=True)
            sparse = np.zeros((len(at), WIDTH), np.float32)
            np.add.at(sparse, where, np.concatenate(pushed))
            for k in p:
                chosen = at if k == "embed" else slice(None)
                g = (sparse if k == "embed" else grad[k]) + decay * p[k][chosen]
                m, v = moments[k]
                m[chosen] = 0.9 * m[chosen] + 0.1 * g
                v[chosen] = 0.99 * v[chosen] + 0.01 * g * g
                p[k][chosen] -= rate * (m[chosen] / (1 - 0.9**step)) / (np.sqrt(v[chosen] / (1 - 0.99**step)) + 1e-8)
            p["embed"][0] = 0
    out = model()
    if guess is not None:
        names = dict(sorted(((int(rows[bucket(w)]), w) for w in {w for t in texts for w in t}), reverse=True))  # the least word of each row
        out.guess = guess
        out.language = np.zeros((count, len(guess.languages) + 2), np.float32)
        out.language[1:] = guess.word_rows([names[i] for i in range(1, count)])
    held = np.flatnonzero(is_held) if is_held.any() else np.arange(len(sample))
    kinds = len(guess.languages) + 1 if guess else 1
    out.thresholds = np.zeros(kinds)
    if len(held):
        lengths = np.array([len(known[j]) for j in held])
        flat = np.concatenate([known[j] for j in held])
        logits, languages = out.logits(out.pooled(flat, lengths)), out.languages(sums(out.language[flat], lengths))
        usual = _threshold(logits, labels[held], negatives_weight)
        out.thresholds[:] = [_threshold(logits[languages == k], labels[held][languages == k], negatives_weight, usual) for k in range(kinds)]
    return out


def train_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", per_label: int = 2500, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on at most ``per_label`` rows of each label, texts up to ``max_chars``.

    The language guess learns from ``lang`` of ``docs``; both tables should hold
    the rows to learn from only.
    """
    known = labels.where(F.col(label).isin(0, 1))
    sample = bounded_sample(known, doc_id, label, per_label)
    rows = sample_texts(docs, sample, doc_id, text, label, max_chars)
    counts = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    taken = Counter(y for _, y in rows)
    weight = (counts.get(0, 0) / max(1, taken[0])) / max(1e-9, counts.get(1, 0) / max(1, taken[1])) if counts.get(1) else 1.0
    return fit(rows, weight, langid.train_on(docs, doc_id, text, lang, per_language=200, max_chars=max_chars))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Whole texts count; a null or empty one is scored as a text of unknown words.
    Row by row: repeated rows score the same, ties of responses change nothing, an
    empty table gives an empty one; columns called score or predicted are replaced,
    others kept.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.word_rows)
        for batch in batches:
            out = model.scores(raw_texts(batch.column(keep.index(text))), features) if batch.num_rows else np.zeros(0)
            new = [pa.array(out), pa.array((out >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new], names=[*keep, "score", "predicted"])

    return docs.select(*[docs[c] for c in keep]).mapInArrow(run, schema)

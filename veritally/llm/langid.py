"""Language identification by averaged hashed subword embeddings.

A text's words are cut into character n-grams of their lower-cased letters, with
word boundaries; each n-gram is hashed to an embedding, the embeddings are
averaged over the whole text and a linear softmax gives the languages' odds.
Embeddings and weights are trained together by stochastic gradient descent in
numpy.  A temperature fitted on held-back sample rows makes the odds calibrated
probabilities; a text is rejected when its probability, or the share of its
n-grams that training has seen, is below thresholds fitted on the same rows.  The
share's threshold lies between those rows' and what each language would have if
only the others had been trained; short texts, whose shares scatter, get slack.

Averaging and the weights are linear, so a trained model needs one row of
language scores for each bucket; a word's row is the sum over its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm.common import released
from veritally.llm.samples import bounded_sample, sample_texts
from veritally.llm.words import Features, blocks, raw_texts, sums

UNKNOWN = "und"
BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4)
WIDTH = 16
#: Most words of a short passage of a sample text.
PASSAGE = 10
#: n-grams of a text whose coverage is calibrated without slack.
LONG_GRAMS = 200
#: Share of an untrained language's texts that the coverage limit should lie above.
UNLIKE = 0.99


#: Byte -> byte: ASCII that is no letter a space.
CLASSES = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
NO_LETTER, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(word: bytes) -> bytes:
    """A word in lower case with a space for what is no letter (nor a mark on one) by its Unicode category."""
    if word.isascii():
        return word.lower()
    text = NO_LETTER.sub(" ", word.decode("utf-8", "replace").lower())
    return text.encode() if LETTER.search(text) else b" "


def word_grams(words: list[bytes]):
    """Yields for each n: (bucket of each n-gram of letters, its word's number).

    Letters are those of Unicode, in lower case.  n-grams are runs of n bytes of a word between two boundaries, which count as
    a byte; what is no letter is a boundary.  Numbers ascend.
    """
    words = [*map(letters, words)]
    raw = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(-1, len(words)), np.concatenate(([1], lengths + 1)))
    codes = CLASSES[raw]
    gap = codes == 32
    for n in GRAMS:
        size = len(codes) - n + 1
        if size <= 0:
            return
        code = np.full(size, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(16777619) + codes[k : size + k]
        valid = ~gap[:size] if n == 1 else np.ones(size, bool)
        for k in range(1, n - 1):
            valid &= ~gap[k : size + k]
        if n == 2:
            valid &= ~(gap[:size] & gap[1:])
        code = (code ^ (code >> np.uint32(15))) * np.uint32(2246822519)
        owner = np.where(gap[:size], word[1 : size + 1] if n > 1 else word[:size], word[:size])
        yield ((code ^ (code >> np.uint32(13))) % np.uint32(BUCKETS))[valid].astype(np.int64), owner[valid]


def _document(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and their shares."""
    grams = [g for g, _ in word_grams(words)]
    buckets, counts = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.int64), return_counts=True)
    return buckets, counts / max(1, counts.sum())


@dataclass
class LanguageModel:
    """scores: a row for each bucket, the embedding times the weights; the last
    column says whether training saw the bucket."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_probability: float = 0.0
    least_coverage: float = 0.0
    slack: float = 0.0

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its n-grams' rows, and their number."""
        out = np.zeros((len(words), len(self.languages) + 2), np.float32)
        for buckets, owner in word_grams(words):
            lengths = np.bincount(owner, minlength=len(words))
            out[:, :-1] += sums(self.scores[buckets], lengths)
            out[:, -1] += lengths
        return out

    def decide(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, -1 without letters; probability; coverage) from summed word rows."""
        n = totals[:, -1]
        mean = totals[:, :-1] / np.maximum(n, 1)[:, None]
        logits = (mean[:, :-1] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = np.where(n > 0, p.argmax(axis=1), -1)
        return best, np.where(n > 0, p.max(axis=1), 0.0), np.where(n > 0, mean[:, -1], 0.0)


    def rejects(self, totals: np.ndarray) -> np.ndarray:
        """Whether a text is unlike every language; the coverage it needs rises to the limit with its n-grams."""
        best, p, coverage = self.decide(totals)
        least = self.least_coverage - self.slack / np.sqrt(np.maximum(totals[:, -1], 1))
        return (best < 0) | (p < self.least_probability) | (coverage < least)


def fit(sample: list[tuple[bytes, str]], epochs: int = 4, rate: float = 4.0, seed: int = 7, lost: float = 0.002) -> LanguageModel | None:
    """Train on texts and their languages; None without any.

    Each text counts whole and as one short passage of it, so that short texts are
    learned and calibrated as well.  Every fifth text is held back for calibration: the temperature minimises
    their log loss; the least probability is half the level below which the
    share ``lost`` of the rightly predicted ones would fall.  The least coverage is
    that level for long texts, less a quarter of the way down to the coverage of
    the same texts when their own language isn't trained; the slack lets
    all but the share ``lost`` of the shorter ones pass.
    """
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    random = np.random.default_rng(seed)
    held, train, grams = [], [], []
    for i, (text, lang) in enumerate(sample):
        words = text.lower().split()
        n = int(random.integers(1, PASSAGE + 1))
        start = int(random.integers(0, max(1, len(words) - n + 1)))
        for part in (words, words[start : start + n]):
            if len((d := (*_document(part), number[lang]))[0]):
                (held if i % 5 == 4 else train).append(d)
                if i % 5 == 4:
                    grams.append(sum(len(g) for g, _ in word_grams(part)))
    embed = random.uniform(-0.5, 0.5, (BUCKETS, WIDTH)) / WIDTH
    weights, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    seen_by = np.zeros((len(languages), BUCKETS), bool)
    for buckets, _, y in train:
        seen_by[y, buckets] = True
    seen = seen_by.any(axis=0)
    steps, step = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in random.permutation(len(train)):
            buckets, share, y = train[i]
            mean = share @ embed[buckets]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            now = rate * (1 - step / steps)
            back = weights @ p
            weights -= now * np.outer(mean, p)
            bias -= 0.05 * now * p
            embed[buckets] -= now * share[:, None] * back
            step += 1
    scores = np.concatenate([embed @ weights, seen[:, None]], axis=1).astype(np.float32)
    model = LanguageModel(languages, scores, bias.astype(np.float32))
    calibrated, held = bool(held), held or train
    if held:
        totals = np.array([np.append(share @ scores[buckets], 1.0) for buckets, share, _ in held])
        truth = np.array([d[2] for d in held])

        def loss(t: float) -> float:
            model.temperature = t
            logits = (totals[:, :-2] + model.bias) / t
            logits -= logits.max(axis=1, keepdims=True)
            return float((np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(truth)), truth]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 81), key=loss)
        best, p, coverage = model.decide(totals)
        if (right := best == truth).any():
            model.least_probability = float(np.quantile(p[right], lost)) / 2
            model.least_coverage = float(np.quantile(coverage[right], lost)) / 2
        size = np.array(grams)
        if calibrated and len(languages) > 1 and (long := right & (size >= LONG_GRAMS)).any():
            times = seen_by.sum(axis=0)
            others = np.array([share @ (times[b] > seen_by[y, b]) for b, share, y in held])
            inside = float(np.quantile(coverage[long], lost))
            outside = max(float(np.quantile(others[long & (truth == y)], UNLIKE)) for y in np.unique(truth[long]))
            model.least_coverage = min(inside, inside - (inside - outside) / 4)
            model.slack = float(np.quantile(np.maximum(0, (model.least_coverage - coverage[right]) * np.sqrt(size[right])), 1 - lost))
    return model


def train_on(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, max_chars: int = 40_000) -> LanguageModel | None:
    """Fit on at most ``per_language`` rows of each language, texts up to ``max_chars``."""
    labelled = docs.select(doc_id, text, lang).where(F.col(lang) != UNKNOWN)
    sample = bounded_sample(labelled.where(F.length(text) <= max_chars), doc_id, lang, per_language)
    return fit(sample_texts(labelled.drop(lang), sample, doc_id, text, lang, max_chars))


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (calibrated probability), coverage and rejected.

    lang_pred is ``und`` with score 0 where the text is null or has no letter,
    and rejected is true there; elsewhere it is a learned language, whatever
    rejected says.  Whole texts count; without a model (no labelled rows) every
    text is ``und``.  Row by row, so repeated rows and ties need no care (equal
    odds go to the first language by name); the columns added replace input
    columns of the same names.
    """
    added = ("lang_pred", "score", "coverage", "rejected")
    keep = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rows = Features(model.word_rows) if model else None
        for batch in batches:
            n = batch.num_rows
            best, p, coverage, rejected = np.full(n, -1), np.zeros(n), np.zeros(n), np.ones(n, bool)
            if model:
                totals = np.zeros((n, len(model.languages) + 2))
                for first, words, lengths in blocks(raw_texts(batch.column(keep.index(text)))):
                    by_word, ids = rows(words)
                    totals[first : first + len(lengths)] += sums(by_word[ids], lengths)
                best, p, coverage = model.decide(totals)
                rejected = model.rejects(totals)
            names = [model.languages[b] if b >= 0 else UNKNOWN for b in best]
            new = [pa.array(names, pa.string()), pa.array(p), pa.array(coverage), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new], names=[*keep, *added])

    return docs.select(*[docs[c] for c in keep]).mapInArrow(released(run), schema)

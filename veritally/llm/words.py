"""Interned words: each distinct word's features are worked out once a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Distinct words a worker remembers, and their bytes; when full, the table starts anew.
MEMO = 400_000
MEMO_BYTES = 64 << 20
#: Bytes of text, and texts, that are turned into arrays at once (a longer text is cut at words, never dropped).
BLOCK_BYTES = 1 << 20
BLOCK_TEXTS = 1024


class Interned(dict):
    """word -> number; ``fresh`` gathers the words seen for the first time."""

    def __init__(self, memo: int):
        super().__init__()
        self.fresh: list[bytes] = []
        self.size, self.memo = 0, memo

    @property
    def full(self) -> bool:
        return len(self) > self.memo or self.size > MEMO_BYTES

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.size += len(word)
        self.fresh.append(word)
        return number


class Features:
    """Rows of a float32 or int table by word, computed in bulk for new words.

    ``of``: maps a list of new words to an array with a row for each; ``memo``:
    words after which the table starts anew (MEMO if None).
    """

    def __init__(self, of: Callable[[list[bytes]], np.ndarray], memo: int | None = None):
        self._of, self._memo = of, memo or MEMO
        self._ids, self._rows = Interned(self._memo), None

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(table, row number of each word)."""
        if self._ids.full:
            self._ids, self._rows = Interned(self._memo), None
        ids = np.fromiter(map(self._ids.__getitem__, words), np.int64, len(words))
        if self._ids.fresh:
            new, self._ids.fresh = self._of(self._ids.fresh), []
            n = len(self._ids)
            if self._rows is None or len(self._rows) < n:
                grown = np.zeros((max(n, 2 * len(self._rows) if self._rows is not None else 4096), *new.shape[1:]), new.dtype)
                if self._rows is not None:
                    grown[: n - len(new)] = self._rows[: n - len(new)]
                self._rows = grown
            self._rows[n - len(new) : n] = new
        return (self._rows if self._rows is not None else self._of([])), ids


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], lower: bool = True, overlap: int = 0):
    """Yields (first, words, lengths): the words of a run of texts, and how many each has.

    A run holds about BLOCK_BYTES and at most BLOCK_TEXTS texts.  A text longer than that comes in several
    runs of one entry, all with the same ``first``; each then begins with the last
    ``overlap`` words of the run before.
    """
    first, words, lengths, size = 0, [], [], 0
    for i, text in enumerate(texts):
        own = (text.lower() if lower else text).split()
        if len(text) > BLOCK_BYTES:
            if lengths:
                yield first, words, np.array(lengths)
            step = BLOCK_BYTES // 8
            for k in range(0, len(own), step):
                part = own[max(0, k - overlap) : k + step]
                yield i, part, np.array([len(part)])
            first, words, lengths, size = i + 1, [], [], 0
            continue
        words += own
        lengths.append(len(own))
        size += len(text)
        if size >= BLOCK_BYTES or len(lengths) >= BLOCK_TEXTS:
            yield first, words, np.array(lengths)
            first, words, lengths, size = i + 1, [], [], 0
    if lengths:
        yield first, words, np.array(lengths)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of the rows of each run; a run without rows sums to 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64)
    full = lengths > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out

"""Word-level BPE with end-of-word suffixes: encoding and decoding.

Files in the public ``tokenizers`` JSON format, kind "BPE with word ends": NFC,
white space dropped, lower case, words cut by a fixed pattern, bytes mapped to
printable letters, a suffix on the last letter of a word, no decoder.

A word's merges are found on a contiguous rank array: the ids of its parts and,
beside them, the rank of each adjacent pair.  The least rank is scanned for, the
boundary under it deleted and the two neighbouring ranks looked up again.  That
is quadratic, which suits short words; longer ones use a heap over a linked
list, with the same result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from veritally.llm.common import released

#: Words with more bytes than this are merged by a heap.
SHORT_WORD = 192
#: Chunks whose ids a worker remembers, and their bytes with those of their ids; when full, it starts anew.
MEMO = 250_000
MEMO_BYTES = 64 << 20
#: Bytes of text a task turns into one output batch at most (a longer text is a batch).
BATCH_BYTES = 4 << 20

# Fixed values of the file format: the word pattern, and the letters that stand
# for bytes (printable bytes stand for themselves, the rest follow from 256 on).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--N]+|[\p{N}--N]|(?:[^\p{White_Space}\p{L}\p{N}]|N)+"
# Letters and digits that Unicode got after version 16, which the
# format's pattern knows; it takes them for symbols.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed
1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6
"""
# Lower case of capitals that Unicode got in versions 16 and 17.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))


def word_pattern() -> regex.Pattern:
    newer = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
    return regex.compile(WORDS.replace("N]+", f"[{newer}]]+").replace("--N]", f"--[{newer}]]").replace("|N)", f"|[{newer}])"), regex.V1)


def byte_letters() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file, given as its text."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", ())}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._words = word_pattern()
        self._cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self._memo: dict[bytes, bytes] = {}
        self._size = 0

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word, given as its UTF-8 bytes."""
        inner = self.inner
        ids = [inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self._scan(ids) if len(ids) <= SHORT_WORD else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (1 << 60, 0)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            least = min(pairs)
            if least is none:
                break
            i = pairs.index(least)
            ids[i] = least[1]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        queue = [(r, i, a, b, m) for r, m, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (found := get((ids[x], ids[y]))):
                    heapq.heappush(queue, (found[0], x, ids[x], ids[y], found[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> Iterator[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(LOWER)
        for word in self._words.findall(text.lower()):
            yield from self.word_ids(word.encode())

    def _chunk(self, chunk: bytes) -> bytes:
        out = array("I")
        for part in self._cut.split(chunk.decode()):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self._plain(part))
        got = out.tobytes()
        self._size += len(chunk) + len(got)
        if len(self._memo) >= MEMO or self._size > MEMO_BYTES:
            self._memo.clear()
            self._size = len(chunk) + len(got)
        self._memo[chunk] = got
        return got

    def forget(self) -> None:
        self._memo.clear()
        self._size = 0

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers.

        No word crosses white space, so a text is the concatenation of its
        white-space-free chunks, which are remembered.
        """
        get, chunk = self._memo.get, self._chunk
        return b"".join([get(c) or chunk(c) for c in text.split()])

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a space, special tokens included."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_loaded: dict[str, WordBpe] = {}


def _tokenizer(spec: str) -> WordBpe:
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = WordBpe(spec)
    return _loaded[spec]


def _forget() -> None:
    for tokenizer in _loaded.values():
        tokenizer.forget()


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens (long), ids (binary: little-endian uint32) and decoded (string).

    Whole texts are encoded; a null or empty one has no ids and decodes to "".
    The file at ``tokenizer_path`` is read on the driver and broadcast; its size
    is that of one vocabulary.  Row by row, so ties, repeated rows and empty
    tables need no care; input columns called n_tokens, ids or decoded are
    replaced.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c not in ("n_tokens", "ids", "decoded")]
    fields = [df.schema[c] for c in keep]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec.value)
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            start = 0
            while start < len(raw):
                end, size, ids = start, 0, []
                while end < len(raw) and (size < BATCH_BYTES or end == start):
                    x = raw[end].as_py() or b""
                    size += len(x)
                    ids.append(bpe.encode(x))
                    end += 1
                part = batch.slice(start, end - start)
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + new, names=[*keep, "n_tokens", "ids", "decoded"])
                start = end

    return df.mapInArrow(released(run, _forget), T.StructType(fields + added))

"""Alignment of two tokenizers' tokens over the same bytes, and which of their ids go together.

A transducer reads both token sequences of a text.  Its state is the side that leads
and the bytes by which it does; it takes the next token of the other side, or of the
first when both are level, and transitions are remembered by state and token.
Whenever nothing dangles, a group closes: both sides have spelt the same bytes.

Texts are read as chunks that begin with a space after a sign that is none: no token
of either side reaches across such a space, so a text's tokens are those of its
chunks, one after another.  Each distinct chunk is encoded and aligned once a worker
while it is remembered.

Pairs of ids are counted by documents.  Documents are packed into blocks; a block
sends each pair it holds once, with its number of documents, and gets the pair's
corpus count back once, so the corpus' pairs are never gathered or broadcast.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from veritally.functions.shared import workspace
from veritally.llm.bpe import byte_letters
from veritally.llm.common import released

#: Bytes of text in a block of documents, about (a longer text is a block).
BLOCK_BYTES = 1 << 20
#: Blocks, and their bytes, in a row group of the written table, about: readers hold a row group's arrays at once.
ROW_GROUPS = {"parquet.block.row.count.limit": 8, "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
#: Chunks a worker remembers, and their bytes; when full, it starts anew.
MEMO = 400_000
MEMO_BYTES = 48 << 20
#: Chunks that are encoded at once.
AT_ONCE = 4096
#: Links of a group over which it is multiplied out by distinct ids.
LONG_GROUP = 256
#: States of the transducer and their transitions that are remembered.
STATES = 200_000
#: A space that starts a chunk.
SPACE = re.compile(r"(?<=\S) (?!\Z)")
#: White space before a space, where a text may not be cut at every space.
ODD = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class State(dict):
    """token -> next state, for one dangling suffix; ``first``: whether the next token is the first side's."""

    __slots__ = ("first", "suffix", "machine")

    def __init__(self, machine: Transducer, first: bool, suffix: bytes):
        super().__init__()
        self.machine, self.first, self.suffix = machine, first, suffix

    def __missing__(self, token: int) -> State | None:
        """The suffix less the token's bytes, or what of them goes beyond it; None where the bytes differ."""
        machine, spelt = self.machine, (self.machine.first if self.first else self.machine.second)[token]
        both = min(len(spelt), len(self.suffix))
        if spelt[:both] != self.suffix[:both]:
            return None
        rest, over = self.suffix[both:], spelt[both:]
        found = machine.state(self.first if rest or not over else not self.first, rest or over)
        machine.known += 1
        if machine.known <= STATES:
            self[token] = found
        return found


class Transducer:
    """``first``, ``second``: the bytes of each token id of both sides."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.first, self.second = first, second
        self.known, self.states = 0, {}
        self.level = State(self, True, b"")

    def state(self, first: bool, suffix: bytes) -> State:
        if not suffix:
            return self.level
        found = self.states.get((first, suffix))
        if found is None:
            found = State(self, first, suffix)
            if len(self.states) < STATES:
                self.states[first, suffix] = found
        return found

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """Numbers of tokens of both sides in each group; None where they don't spell the same."""
        if self.known > STATES:
            self.known = 0
            self.states.clear()
            self.level.clear()
        level, n, m, i, j, p, q, sizes_a, sizes_b = self.level, len(a), len(b), 0, 0, 0, 0, [], []
        state = level
        while i < n or j < m:
            if state.first:
                if i == n:
                    return None
                state = state[a[i]]
                i += 1
            else:
                if j == m:
                    return None
                state = state[b[j]]
                j += 1
            if state is level:
                sizes_a.append(i - p)
                sizes_b.append(j - q)
                p, q = i, j
            elif state is None:
                return None
        return (sizes_a, sizes_b) if state is level else None


def piece_bytes(piece: str) -> bytes:
    m = BYTE_PIECE.fullmatch(piece)
    return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()


class Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self):
        self.flat, self.ends, self.n = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 0

    def extend(self, rows: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        used = int(self.ends[self.n])
        total = used + int(sizes.sum())
        self.flat = self._room(self.flat, total)
        self.ends = self._room(self.ends, self.n + len(rows) + 1)
        self.flat[used:total] = np.fromiter(chain.from_iterable(rows), np.int32, total - used)
        self.ends[self.n + 1 : self.n + len(rows) + 1] = used + np.cumsum(sizes)
        self.n += len(rows)

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate((values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows' values one after another, the rows' sizes)."""
        begin, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.flat[spread(begin, sizes)].astype(np.int64), sizes


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (sizes[0] of them), begin[1], ..."""
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Aligner:
    """Both tokenizers of a worker; ``spec`` is the first one's JSON, ``model`` the second one's file."""

    def __init__(self, spec: str, model: bytes):
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = {c: k for k, c in enumerate(byte_letters())}
        spelt = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        first = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in spelt]
        second = [piece_bytes(self.b.id_to_piece(k)) for k in range(self.b.vocab_size())]
        self.stride = len(second)
        self.transducer = Transducer(first, second)
        names = [str(k).encode() for k in range(max(len(first), len(second)))]
        width = len(names[-1])
        self.digits = np.frombuffer(b"".join(x.rjust(width, b"\0") for x in names), np.uint8).reshape(-1, width)
        self.places = np.array([len(x) + 1 for x in names])
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.size = 0
        self.tokens_a, self.tokens_b, self.sizes_a, self.sizes_b = Ragged(), Ragged(), Ragged(), Ragged()

    @staticmethod
    def cut(text: str) -> list[str]:
        """A text's chunks, each without the space before it."""
        if not text:
            return []
        odd = text[0] == " " or text[-1] == " " or any(x in text for x in ODD)
        return SPACE.split(text) if odd else text.split(" ")

    def remember(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks; encodes and aligns those not known yet.  One that both sides don't spell alike has no groups."""
        unknown = list({c for c in chunks if c not in self.memo})
        for k in range(0, len(unknown), AT_ONCE):
            fresh = unknown[k : k + AT_ONCE]
            a = [x.ids for x in self.a.encode_batch_fast([" " + c for c in fresh], add_special_tokens=False)]
            b = self.b.encode(fresh, num_threads=1)
            found = [self.transducer.groups(x, y) or ((), ()) for x, y in zip(a, b)]
            self.memo.update(zip(fresh, range(len(self.memo), len(self.memo) + len(fresh))))
            self.size += sum(map(len, fresh))
            for table, rows in ((self.tokens_a, a), (self.tokens_b, b), (self.sizes_a, [x for x, _ in found]), (self.sizes_b, [y for _, y in found])):
                table.extend(rows)
        return np.fromiter(map(self.memo.__getitem__, chunks), np.int64, len(chunks))

    def block(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """The columns of a block but its number and doc_ids, for whole texts."""
        if len(self.memo) > MEMO or self.size > MEMO_BYTES:
            self._forget()
        n_docs, cuts = len(texts), [self.cut(text) for text in texts]
        at = self.remember(list(chain.from_iterable(cuts)))
        doc = np.repeat(np.arange(n_docs), np.fromiter(map(len, cuts), np.int64, n_docs))
        bad = np.zeros(n_docs, bool)
        bad[doc[self.sizes_a.ends[at + 1] == self.sizes_a.ends[at]]] = True
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        (a, per_a), (b, per_b) = self.tokens_a.take(at), self.tokens_b.take(at)
        (x, per_group), (y, _) = self.sizes_a.take(at), self.sizes_b.take(at)
        of = lambda counts: np.bincount(doc, counts, n_docs).astype(np.int64)
        group_doc = np.repeat(doc, per_group)
        links = np.zeros(n_docs, np.int64)
        np.add.at(links, group_doc, x * y)
        key, times = self._pairs(a, b, x, y, group_doc)
        vocabulary = len(self.transducer.first) * self.stride
        distinct, n_of = np.unique(key % vocabulary, return_counts=True)
        n_a, n_b = of(per_a), of(per_b)
        groups = self._text(a, b, x, y, n_a, n_b)
        return {"n_a": n_a, "n_b": n_b, "n_groups": of(per_group), "n_links": links, "groups": groups, "n_pairs": np.bincount(key // vocabulary, minlength=n_docs), "pairs": key % vocabulary, "times": times, "distinct": distinct, "n_docs": n_of}

    def _pairs(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document and pair as one number, how often) of all linked pairs, in order.

        Long groups are multiplied out by distinct ids, not by tokens.
        """
        from_a, from_b, size = np.cumsum(x) - x, np.cumsum(y) - y, x * y
        vocabulary = len(self.transducer.first) * self.stride
        short = np.flatnonzero(size <= LONG_GROUP)
        sizes = size[short]
        k = spread(np.zeros(len(short), np.int64), sizes)
        wide = np.repeat(y[short], sizes)
        keys = np.repeat(doc[short], sizes) * vocabulary + a[np.repeat(from_a[short], sizes) + k // wide] * self.stride + b[np.repeat(from_b[short], sizes) + k % wide]
        keys.sort()
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        key, times = [keys[starts]], [np.diff(np.append(starts, len(keys)))]
        for g in np.flatnonzero(size > LONG_GROUP):
            (u, n), (v, m) = np.unique(a[from_a[g] : from_a[g] + x[g]], return_counts=True), np.unique(b[from_b[g] : from_b[g] + y[g]], return_counts=True)
            key.append((doc[g] * vocabulary + u[:, None] * self.stride + v).ravel())
            times.append((n[:, None] * m).ravel())
        if len(key) == 1:
            return key[0], times[0]
        key, where = np.unique(np.concatenate(key), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.concatenate(times))
        return key, total

    def _text(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """Each document's groups as text: ``a1,a2|b1;a3|b2,b3``."""
        ends_a, ends_b = np.cumsum(x), np.cumsum(y)
        place_a, place_b = np.arange(len(a)) + np.repeat(ends_b - y, x), np.arange(len(b)) + np.repeat(ends_a, y)
        out = np.empty((len(a) + len(b), self.digits.shape[1] + 1), np.uint8)
        out[:, -1] = ord(",")
        long = np.empty(len(out), np.int64)
        for ids, place, last, sign in ((a, place_a, ends_a, "|"), (b, place_b, ends_b, ";")):
            out[place, :-1] = self.digits[ids]
            out[place[last - 1], -1] = ord(sign)
            long[place] = self.places[ids]
        text = out[out != 0].tobytes()
        ends = np.concatenate(([0], np.cumsum(long)))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        return [text[i : max(i, j - 1)] for i, j in zip(ends, ends[1:])]


_loaded: dict[tuple, Aligner] = {}


def _aligner(spec: str, model: bytes) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps memory of its own
    key = hash(spec), hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(spec, model)
    return _loaded[key]


def _forget() -> None:
    for aligner in _loaded.values():
        aligner._forget()


LONGS = pa.list_(pa.int64())
BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_id", LONGS), ("n_a", LONGS), ("n_b", LONGS), ("n_groups", LONGS), ("n_links", LONGS), ("groups", pa.list_(pa.string()))]
    + [("n_pairs", LONGS), ("pairs", LONGS), ("times", LONGS), ("distinct", LONGS), ("n_docs", LONGS)]
)
DDL = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, n_pairs array<long>, pairs array<long>, times array<long>, distinct array<long>, n_docs array<long>"


def align_blocks(docs: DataFrame, first_path: str, second_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents with their alignments: arrays with an entry for each document.

    groups: ``a1,a2|b1;a3|b2,b3`` (ids of both sides, groups apart by semicolons);
    pairs, times: the documents' distinct linked id pairs one after another (a pair is
    the first side's id times ``stride`` plus the second's), n_pairs of them each;
    distinct, n_docs: the block's distinct pairs and how many of its documents hold each.
    Texts that are null, empty or not spelt alike by both sides have no tokens.
    Block numbers hold only for one run: write the table before using it twice.
    """
    with open(first_path, encoding="utf-8") as f, open(second_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        number = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            found = aligner.block(texts) | {"doc_id": ids}
            columns = [pa.array([found[f.name]], f.type) if f.name != "groups" else pa.array([found["groups"]], pa.list_(pa.binary())).cast(f.type) for f in list(BLOCKS)[1:]]
            return pa.RecordBatch.from_arrays([pa.array([number]), *columns], schema=BLOCKS)

        for batch in batches:
            for key, words in zip(batch.column(0), batch.column(1)):
                texts.append(words.as_py() or "")
                ids.append(key.as_py())
                size += len(texts[-1]) + 64
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(run, _forget), DDL)


def pair_counts(blocks: DataFrame, stride: int) -> DataFrame:
    """(pair, count, best): in how many documents each linked id pair stands, and whether no pair of its first id stands in more."""
    counts = blocks.select(F.explode(F.arrays_zip("distinct", "n_docs")).alias("x")).groupBy(F.col("x.distinct").alias("pair")).agg(F.sum("x.n_docs").alias("count"))
    first = F.floor(F.col("pair") / stride)
    tops = counts.groupBy(first.alias("first")).agg(F.max("count").alias("top"))  # as many rows as the first vocabulary has ids, at most
    return counts.withColumn("first", first).join(F.broadcast(tops), "first").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


def align(docs: DataFrame, first_path: str, second_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, counts, blocks) of a corpus.

    documents: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    in any order, one for each row of ``docs`` (doc_id, text; other columns are not
    looked at); n_best and count_sum are over its links, by the corpus' counts.
    counts: see :func:`pair_counts`.  blocks: what :func:`align_blocks` found, the
    groups as digests (SHA-256; "" for no tokens), written to the shared folder.
    Repeated rows and null ids are documents of their own; an empty table gives
    empty ones.
    """
    spark = docs.sparkSession
    path = workspace(spark, "alignment")
    stride = sentencepiece.SentencePieceProcessor(model_file=second_path).vocab_size()
    found = align_blocks(docs, first_path, second_path)
    digest = F.transform("groups", lambda g: F.when(g == "", "").otherwise(F.sha2(g.cast("binary"), 256)))
    found.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256").write.options(**ROW_GROUPS).parquet(path)
    blocks = spark.read.parquet(path)
    counts = pair_counts(blocks, stride)
    told = blocks.select("block", F.explode("distinct").alias("pair")).join(counts, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    held = blocks.select("block", *kept, "groups_sha256", "n_pairs", "pairs", "times")

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        """A block's documents; its row and its pairs' counts are all that a worker holds."""
        x = {name: block[name][0].values for name in block.column_names if name != "block"}
        n, pairs, times = x["n_pairs"].to_numpy(), x["pairs"].to_numpy(), x["times"].to_numpy()
        known, count, best = (told[name].to_numpy() for name in ("pair", "count", "best"))
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], pairs)]
        upto = np.concatenate(([0], np.cumsum(n)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(times * v[at])))[upto]) for v in (best, count)]
        return pa.table([x[k] for k in kept] + [pa.array(s, pa.int64()) for s in sums] + [x["groups_sha256"]], names=[*kept, "n_best", "count_sum", "groups_sha256"])

    documents = held.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, SCORED + ", groups_sha256 string")
    return documents, counts, blocks

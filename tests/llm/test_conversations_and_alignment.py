"""Prefix trie, reply trees and tokenizer alignment against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veritally.llm import alignment, prefix_trie, queries, reply_trees

SCHEMA = "conv_id long, turn long, role string, text string, a string, pos int, id string"
TURNS = [
    (c, t, r, f"text {x}", "x", 1, "x")
    for c, turns in {
        0: "abcdefghij", 1: "abcd", 2: "zz", 3: "abcdefghijkl", 4: "a", 5: "mnopq", 6: "mno", 7: "q", 8: "rstuvwxyz", 9: "", 10: "abc", 16: "aaaaaaaaaaaaaa",
        20: "k" * 60, 40: "k" * 60, 60: "k" * 60 + "z", 80: "k" * 30 + "y",
    }.items()
    for t, (r, x) in enumerate(("user" if i % 2 else "assistant", x) for i, x in enumerate(turns))
]
ODD = [
    (7, None, "user", "null turn first", "x", 1, "x"), (7, None, None, None, "x", 1, "x"), (8, 3, "user", "tie", "x", 1, "x"), (8, 3, "user", "tie", "x", 1, "x"),
    (None, 1, "user", "nobody's", "x", 1, "x"), (None, None, None, None, None, None, None), (11, 0, "user", "é漢👍", "x", 1, "x"), (12, 5, None, "long " * 200_000, "x", 1, "x"),
]


def conversations(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in out.items()}


def nodes(rows):
    """The trie of the rebuilt conversations by dictionaries."""
    turns, members, ends, children = conversations(rows), defaultdict(list), defaultdict(list), defaultdict(list)
    for c, own in sorted(turns.items()):
        h = zlib.crc32(str(c).encode()) % 9
        new = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        ends[new].append(c)
        for d in range(len(new) + 1):
            members[new[:d]].append(c)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = sum(saved[k] for k in children[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    digest = lambda n: hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(children[n]), leaves[n], saved[n], digest(n)) for n, m in members.items())


def trie(df):
    found = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_trie_equals_dictionaries(spark, monkeypatch, block):
    """With repeats, ties, nulls, conversations left without turns, chains, and blocks and pages cut small."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PAGE", 4 if block == 7 else 4096)
    rows = TURNS + ODD
    if block == 7:
        rows = rows + [(1000 + 5 * k, 0, "user", "same", "x", 1, "x") for k in range(30)]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == nodes(rows)


def test_trie_of_nothing(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x", None, None, None)], SCHEMA)) == []


def test_trie_query(spark, sf_dir):
    got = sorted(tuple(-1 if v is None else v for v in r) for r in queries.op11_prefix_trie(spark, sf_dir).collect())
    assert got == nodes([tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


CONTROL = "</s>[INST] ok [/INST]"


def read(turns):
    """What the query returns of a conversation."""
    loss = "".join(x for r, x in turns if r == "assistant")
    whole = "".join(f"{r}\n{x}\n" for r, x in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query_reads_back_every_turn(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: read(t) for c, t in conversations(rows).items()} | {-1: read([("user", CONTROL), ("assistant", CONTROL)])}
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_chat_format(spark, sf_dir).collect()}
    assert {c: x[:4] for c, x in got.items()} == want
    assert all(x[4] > x[2] for x in got.values())


MESSAGES = "tree string, id long, parent long, score double, role string, text string, up string, depth int"
TEXTS = ["", "plain", CONTROL, "\\", "\\\\n", "a\\</s>", "<\\/s>", "[", "<", "<s", "<s><s></s", "[/INST] [SYS][/SYS][ROLE]x[/ROLE]", "$1 \\1", "line\nline\n", "漢字👍 é", None]
ROLES = ["system", "user", "assistant", "tool", "", None, "[ROLE] odd [/ROLE] ", "assistant"]


def paths(rows):
    """{tree: [(mean score, length, leaf, path)], best first} by walking up."""
    first = {}
    for tree, i, parent, score, role, text, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[4] is not None, r[4] or "", r[5] is not None, r[5] or "")):
        first.setdefault(i, (tree, parent, score, role, text))
    parents, out = {v[1] for v in first.values()}, defaultdict(list)
    for i in first:
        if i in parents:
            continue
        path = [i]
        while first[path[-1]][1] in first and len(path) <= len(first):
            path.append(first[path[-1]][1])
        if len(path) <= len(first):
            path = path[::-1]
            mean = sum(first[k][2] or 0.0 for k in path) / len(path)
            out[first[i][0]].append((-mean, -len(path), i, [(first[k][3] or "", first[k][4] or "") for k in path]))
    return {t: sorted(v) for t, v in out.items()}


def test_reply_trees(spark):
    """Branches, ties of scores, orphans, cycles, repeated and null ids, odd texts and roles, empty tables."""
    rows = [("t", 0, None, 1.0, "user", "root", "x", 1)]
    rows += [("t", k, (k - 1) // 2, float(k % 5), ROLES[k % len(ROLES)], TEXTS[k % len(TEXTS)], "x", 1) for k in range(1, 80)]
    rows += [("deep", 1000 + k, 999 + k if k else None, 0.5, ROLES[k % 3], TEXTS[k % len(TEXTS)], "x", 1) for k in range(50)]
    rows += [("orphan", 2000, 1_999_999, None, "user", "o", "x", 1), (None, 2001, None, None, "user", "n", "x", 1), ("cycle", 2002, 2003, 1.0, "user", "c", "x", 1), ("cycle", 2003, 2002, 1.0, "user", "c", "x", 1)]
    rows += [("cycle", 2004, 2003, 1.0, "user", "below a cycle", "x", 1), ("t", 0, None, 1.0, "user", "root", "x", 1), ("t", None, 0, 9.0, "user", "no id", "x", 1)]
    for top in (1, 3):
        want = {(t, n): path for t, found in paths(rows).items() for n, (*_, path) in enumerate(found[:top], 1)}
        pages = reply_trees.formatted(spark.createDataFrame(rows, MESSAGES), top)
        got = defaultdict(list)
        for r in pages.orderBy("page").collect():
            turns = list(reply_trees.turns_of(r["text"]))
            learned = [reply_trees.unescaped(r["text"][s["start"] : s["stop"]]) for s in r["spans"]]
            assert learned == [x for role, x in turns if role == "assistant"] and r["n_turns"] == len(turns) <= reply_trees.PAGE_TURNS
            got[r["tree"], r["branch"]] += turns
        assert dict(got) == want
        back = {(r["tree"], r["branch"]): tuple(r)[2:6] for r in reply_trees.read_back(pages).collect()}
        assert back == {k: read(v) for k, v in want.items()}
    assert reply_trees.read_back(reply_trees.formatted(spark.createDataFrame([], MESSAGES))).collect() == []


def aligned(texts):
    """(per text: n_a, n_b, n_groups, n_links, groups; pairs with counts) by byte offsets."""
    a, b = Tokenizer.from_file(queries.ALIGNED[0]), sentencepiece.SentencePieceProcessor(model_file=queries.ALIGNED[1])
    a.encode_special_tokens = True
    letters = {c: k for k, c in enumerate(alignment.byte_letters())}
    spell = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
    out = []
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p, q = [spell(a.id_to_token(k)) for k in x], [alignment.piece_bytes(b.id_to_piece(k)) for k in y]
        if not text or {b"".join(p), b"".join(q)} != {(" " + text).encode()}:
            out.append((0, 0, 0, 0, "", Counter()))
            continue
        ends_p, ends_q = list(accumulate(map(len, p))), list(accumulate(map(len, q)))
        at_p, at_q = {e: k + 1 for k, e in enumerate(ends_p)}, {e: k + 1 for k, e in enumerate(ends_q)}
        i = j = links = 0
        groups, pairs = [], Counter()
        for e in sorted(set(ends_p) & set(ends_q)):
            u, v = x[i : at_p[e]], y[j : at_q[e]]
            groups.append(",".join(map(str, u)) + "|" + ",".join(map(str, v)))
            links += len(u) * len(v)
            counts = Counter(v)
            for s, n in Counter(u).items():
                for t, m in counts.items():
                    pairs[s, t] += n * m
            i, j = at_p[e], at_q[e]
        out.append((len(x), len(y), len(groups), links, ";".join(groups), pairs))
    corpus = Counter(k for *_, pairs in out for k in pairs)
    top = defaultdict(int)
    for (s, _), n in corpus.items():
        top[s] = max(top[s], n)
    rows = []
    for *ints, groups, pairs in out:
        best = sum(n for k, n in pairs.items() if corpus[k] == top[k[0]])
        rows.append((*ints, best, sum(n * corpus[k] for k, n in pairs.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return rows, corpus


ODD_TEXTS = ["", None, " ", "a ", " a", "  a  b\n c", "\n \nx", "▁x y", "　 x", "x" + " " * 5000 + "b\n\n" + "z" * 3000 + " " * 999, "漢字 👍🏽 \u0000 é ß", "<|endoftext|> </s> <s> <unk> <0x0A>", "it's  12,345.67\r\n\tnaïve", "   x", "a  b"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_byte_offsets(spark, frame, edges, monkeypatch, small):
    """Also with one document a block, and memories that overflow at once."""
    rows = edges + [(20 + k, x, "en", "s0") for k, x in enumerate(ODD_TEXTS)]
    docs = [(r[0], r[1]) for r in rows]
    docs = [(i, x if x is None or len(x) < 200_000 or not small else x[:20_000]) for i, x in docs]
    if small:
        aligner = alignment.Aligner(open(queries.ALIGNED[0]).read(), open(queries.ALIGNED[1], "rb").read())
        monkeypatch.setattr(alignment, "MEMO", 1)
        monkeypatch.setattr(alignment, "STATES", 3)
        got = [aligner.block([x or ""]) for _, x in docs]
        want, _ = aligned([x for _, x in docs])
        assert [(int(g["n_a"][0]), int(g["n_b"][0]), int(g["n_groups"][0]), int(g["n_links"][0])) for g in got] == [w[:4] for w in want]
        return
    found, counts, _ = alignment.align(frame([(i, x, "en", "s") for i, x in docs]), *queries.ALIGNED)
    want, corpus = aligned([x for _, x in docs])
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(((i, *w) for (i, _), w in zip(docs, want)), key=key)
    assert {divmod(r["pair"], 32_000): r["count"] for r in counts.collect()} == corpus


def test_alignment_of_nothing(spark):
    found, counts, _ = alignment.align(spark.createDataFrame([], "doc_id long, text string"), *queries.ALIGNED)
    assert found.collect() == [] and counts.collect() == []


def test_alignment_reads_few_blocks_at_once(spark, frame, corpus, monkeypatch):
    """However many blocks a task writes, a reader holds the arrays of eight; a block's counts meet it alone."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    found, _, blocks = alignment.align(frame(corpus + [(1, None, "en", "s"), (2, "", "en", "s")]).coalesce(1), *queries.ALIGNED)
    parts = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]
    assert sum(m.num_rows for m in parts) == len(corpus) + 2
    assert max(m.row_group(k).num_rows for m in parts for k in range(m.num_row_groups)) <= 8
    want, _ = aligned([x for _, x, *_ in corpus] + [None, ""])
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, *w) for i, w in zip([*(r[0] for r in corpus), 1, 2], want))


def test_alignment_encodes_few_chunks_at_once(corpus, monkeypatch):
    """However many chunks of a block are new; the columns are the same."""
    texts, sizes = [x for _, x, *_ in corpus], []
    make = lambda: alignment.Aligner(open(queries.ALIGNED[0]).read(), open(queries.ALIGNED[1], "rb").read())
    whole = make().block(texts)
    aligner = make()

    class Counted:
        def encode_batch_fast(self, chunks, **options):
            sizes.append(len(chunks))
            return library.encode_batch_fast(chunks, **options)

    library, aligner.a = aligner.a, Counted()
    monkeypatch.setattr(alignment, "AT_ONCE", 5, raising=False)
    parts = aligner.block(texts)
    assert max(sizes) <= 5 < sum(sizes)
    assert {k: list(v) for k, v in parts.items()} == {k: list(v) for k, v in whole.items()}


def test_alignment_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = aligned([x for _, x in docs])
    got = sorted(tuple(r) for r in queries.op13_tokenizer_alignment(spark, sf_dir).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(docs, want))

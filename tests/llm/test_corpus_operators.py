"""Operators that look at many rows: suffix tree, mixing, near-duplicates, neighbours, rules, pipeline."""

import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from conftest import prose

import corpus_pipeline
from veritally.llm import ann, mixing, quality_rules, queries, simhash, suffix_tree


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_counts_and_base_score(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    rows = queries.op2_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in seen for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


SMALL = suffix_tree.Tree(least_word=0.004, least_core=0.02, least_context=3, context_root=0.0, least_pair=2, pair_root=0.0, endings=16)


def test_next_word_probabilities_sum_to_one(frame, corpus):
    tree, counts = suffix_tree.train(frame(corpus), how=SMALL)
    words, count = tree.words, {bytes(r["word"]): r["c"] for r in counts.collect()}
    assert len(tree.parent) > 5 and len(words.symbols) < len(words.counts) < len(count)  # contexts were retained, words are of all three kinds
    alphabet = np.arange(1, words.alphabet + 1)
    for context in ([], ["the"], ["the", "of"], ["haus", "fluss", "wasser"], ["zzz", "yyy"]):
        before = [int(words.rows([w.encode()])[0, 0]) for w in context]
        coded = [np.array([*before, s], "<u2").tobytes() for s in alphabet]
        text, symbols, keys = suffix_tree.contexts_of(coded, words.how.depth)
        last = np.flatnonzero(np.diff(np.append(text, -1)))
        assert symbols[last].tolist() == alphabet.tolist()
        assert (10 ** tree.steps([k[last] for k in keys], symbols[last])).sum() == pytest.approx(1.0, abs=1e-9)
    for k in range(words.how.endings):
        own = [(c - 0.5) / words.class_total[k] for w, c in count.items() if w not in words.symbols and suffix_tree.ending(w, 16) == k]
        assert not own or sum(own) + 10 ** words.unseen(k) == pytest.approx(1.0)


def brute_tree_scores(train, texts, how):
    """log10 probabilities by definition, with dictionaries and recursion."""
    count = Counter(w for t in train for w in tokens(t))
    n = sum(count.values())
    core = {w for w, c in count.items() if c >= how.least_core * n and c >= max(2.0, how.least_word * n)}
    sym = lambda w: w if w in core else suffix_tree.ending(w, how.endings)
    in_class = Counter()
    for w, c in count.items():
        if w not in core:
            in_class[sym(w)] += c
    distinct = Counter(sym(w) for w in count if w not in core)
    start = {s: how.start_count for s in [*core, *range(how.endings)]}
    for w, c in count.items():
        start[sym(w)] += c
    whole = sum(start.values())
    grams = [Counter() for _ in range(how.depth + 1)]
    for t in train:
        x = ["<"] * how.depth + [sym(w) for w in tokens(t)]
        for i in range(how.depth, len(x)):
            for d in range(1, how.depth + 1):
                grams[d][tuple(x[i - d : i]), x[i]] += 1
    found, pairs = {}, {}
    allowed = None
    for d in range(1, how.depth + 1):
        mine = {k: c for k, c in grams[d].items() if allowed is None or k[0] in allowed}
        total = Counter()
        for (ctx, _), c in mine.items():
            total[ctx] += c
        found |= {ctx: c for ctx, c in total.items() if c >= how.least_context}
        pairs |= {k: c for k, c in mine.items() if c >= how.least_pair and k[0] in found}
        allowed = {(*ctx, s) for (ctx, s), c in mine.items() if c >= how.least_context}
    rest = {ctx: 1 - sum((c - how.discount) / n for (x, _), c in pairs.items() if x == ctx) for ctx, n in found.items()}

    def p(ctx, s):
        if not ctx:
            return start[s] / whole
        if ctx not in found:
            return p(ctx[1:], s)
        c = pairs.get((ctx, s))
        return (0 if c is None else (c - how.discount) / found[ctx]) + rest[ctx] * p(ctx[1:], s)

    kept = set()
    for ctx in found:
        own = [s for x, s in pairs if x == ctx]
        a, b = [p(ctx, s) for s in own], [p(ctx[1:], s) for s in own]
        gain = sum(x * math.log(x / y) for x, y in zip(a, b)) + max(1 - sum(a), 1e-12) * math.log(max(1 - sum(a), 1e-12) / max(1 - sum(b), 1e-12))
        if gain >= how.divergence:
            kept |= {ctx[k:] for k in range(len(ctx))}
    out = []
    for t in texts:
        x, score = ["<"] * how.depth + [sym(w) for w in tokens(t)], 0.0
        for i, w in enumerate(tokens(t), how.depth):
            ctx = next((c for d in range(how.depth, 0, -1) if (c := tuple(x[i - d : i])) in kept), ())
            score += math.log10(p(ctx, x[i]))
            if w not in core:
                k = x[i]
                score += math.log10(((count[w] - how.discount) if w in count else how.discount * distinct[k]) / in_class[k]) if in_class[k] else 0.0
        out.append(score)
    return out, kept


def test_scores_equal_a_brute_force_tree(frame, corpus):
    train = corpus[::2]
    texts = [t for _, t, _, _ in corpus[:30]] + ["", "unheard of words the of", "the the the the", "zzz zzz"]
    tree, counts = suffix_tree.train(frame(train), how=SMALL)
    want, kept = brute_tree_scores([t for _, t, _, _ in train], texts, SMALL)
    assert len(kept) == len(tree.parent) - 1 > 20 and max(map(len, kept)) == 3
    rows = suffix_tree.score(frame([(i, t, None, None) for i, t in enumerate(texts)]), tree, counts).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == {i: pytest.approx(x, rel=1e-9) for i, x in enumerate(want)}


def test_tree_in_parts_leaves_nothing_out(frame, corpus):
    """A tree over the limit of pairs is grown and used in parts; scores are those of the whole tree."""
    train, how = corpus[::2], replace(SMALL, most_pairs=40)
    texts = [t for _, t, _, _ in corpus[:30]] + ["", "unheard of words the of", "the the the the", "zzz zzz"]
    tree, counts = suffix_tree.train(frame(train), how=how)
    want, kept = brute_tree_scores([t for _, t, _, _ in train], texts, SMALL)
    rows = suffix_tree.score(frame([(i, t, None, None) for i, t in enumerate(texts)]), tree, counts).collect()
    assert len(rows) == len(texts) and {r["doc_id"]: r["score"] for r in rows} == {i: pytest.approx(x, rel=1e-9) for i, x in enumerate(want)}
    parts = [tree, *tree.more()]
    assert len(parts) > 2 and sum(len(p.parent) - 1 for p in parts) == len(kept)
    assert [p.span[0] for p in parts[1:]] == [p.span[1] for p in parts[:-1]] and all(len(p.pairs) <= 120 or p.span[1] - p.span[0] == 1 for p in parts)


def test_text_ids_and_marked_rows(spark):
    docs = spark.createDataFrame([("a", "the river the tree"), ("b", "the river"), (None, None), ("b", "the river")], "doc_id string, text string")
    tree, counts, encoded = suffix_tree.fit(docs, ann.F.col("doc_id") == "a", how=SMALL)
    rows = suffix_tree.score_encoded(encoded, tree, counts).collect()
    assert tree.words.total == 5 and sorted((r["doc_id"] or "", r["n_tokens"], r["n_known"]) for r in rows) == [("", 1, 1), ("a", 5, 5), ("b", 3, 3), ("b", 3, 3)]


def test_limits_grow_with_the_corpus(spark):
    rows = spark.range(1, 1001).selectExpr("id as n")
    assert suffix_tree._limit(rows, 10.0, 1000) == 10.0 and suffix_tree._limit(rows, 10.0, 300) == 10.0 * 2**7 and suffix_tree._limit(rows.limit(0), 2.0, 5) == 2.0
    assert suffix_tree._limit(rows, 100.0, 500) == 800.0


def test_contexts_matter(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tree, counts, encoded = suffix_tree.fit(docs, ann.F.col("doc_id") % 5 != 0)
    held = encoded.where("doc_id % 5 = 0")
    n = held.agg({"n_tokens": "sum"}).first()[0]
    per = lambda t: suffix_tree.score_encoded(held, t, counts).agg({"score": "sum"}).first()[0] / n
    root = suffix_tree.SuffixTree(tree.words, [k[:0] for k in tree.keys], [k[:0] for k in tree.states], tree.parent, tree.rest, tree.pairs, tree.logs, tree.root)
    assert per(tree) - per(root) > 0.12


def test_score_of_edges(frame, edges):
    df = frame(edges)
    tree, counts = suffix_tree.train(df)
    rows = suffix_tree.score(df, tree, counts).collect()
    assert len(rows) == len(edges)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[1]["score"] == by[3]["score"] < 0
    assert by[6]["score"] == by[7]["score"] and by[5]["n_tokens"] == 900_001
    assert suffix_tree.score(df.limit(0), tree, counts).count() == 0
    empty, none = suffix_tree.train(df.limit(0))
    assert all(r["n_known"] == 0 for r in suffix_tree.score(frame(edges[:4]), empty, none).collect())


def test_schedule_stays_within_a_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    period = 1000
    blocks = mixing.quotas(weights, period)
    assert sum(blocks.values()) == period
    run = Counter()
    for x in mixing.schedule(blocks, period):
        assert x.release <= x.slot < x.deadline
        run[x.source] += 1
        assert all(abs(run[s] - (x.slot + 1) * q / period) < 1 for s, q in blocks.items())


def test_mixture_of_edges(frame, edges):
    df = frame(edges)
    out = mixing.mix(df, block_rows=2)
    rows = out.collect()
    assert len(rows) == len(edges) and set(out.columns) == {*df.columns, *mixing.ADDED}
    positions = [r["position"] for r in rows]
    assert len(set(positions)) == len(positions) and None not in positions
    blocks = Counter((r["source"], r["block"]) for r in rows)
    assert max(blocks.values()) <= 2
    mixed = sorted((r for r in rows if r["in_mix"]), key=lambda r: r["position"])
    assert mixed and all(r["position"] == r["slot"] * 2 + r["position"] % 2 for r in mixed)
    end = max(r["slot"] for r in mixed) + 1
    assert len({(r["source"], r["block"]) for r in mixed}) == end  # every slot before the end has its block
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", ["cast(null as long)", "7L"])
def test_null_and_repeated_keys_spread(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    docs = spark.range(3000).selectExpr(f"{rows} as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "if(id < 1500, id, 0) as other")
    out = mixing.mix(docs, block_rows=4).collect()
    assert len(out) == 3000 and len({r["position"] for r in out}) == 3000
    blocks = Counter((r["source"], r["block"]) for r in out)
    assert max(blocks.values()) == 4 and sum(n < 4 for n in blocks.values()) <= 2
    assert Counter(r["other"] for r in out) == Counter(r["other"] for r in docs.collect())


def test_query_of_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    rows = queries.op3_mixing(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter(map(tuple, docs))
    sizes = Counter(r["source"] for r in docs)
    period = max(mixing.LEAST_PERIOD, mixing.SLOTS_PER_SOURCE * len(sizes))
    blocks = mixing.quotas({f"={s}": n**0.7 for s, n in sizes.items()}, period)
    by_slot = {}
    for r in rows:
        q = blocks[f"={r['source']}"]
        cycle, i = divmod(r["block"], q)
        assert (r["release"], r["deadline"]) == (cycle * period + i * period // q, cycle * period - (-(i + 1) * period // q))
        assert r["release"] <= r["slot"] < r["deadline"] and r["position"] // 16 == r["slot"]
        assert by_slot.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert {b: n for b, n in Counter((r["source"], r["block"]) for r in rows).items() if n > 16} == {}
    assert all(sorted(r["block"] for r in rows if r["source"] == s) == sorted(k // 16 for k in range(n)) for s, n in sizes.items())


def test_mixture_of_given_weights(frame, corpus):
    rows = mixing.mix(frame(corpus), {"s0": 2.0, "s1": 1.0, "other": 5.0}, block_rows=1).collect()
    assert len(rows) == len(corpus)
    assert all(r["slot"] is None and not r["in_mix"] for r in rows if r["source"] == "s2")
    mixed = sorted((r for r in rows if r["in_mix"]), key=lambda r: r["position"])
    assert len(mixed) >= 35
    for n in range(1, len(mixed) + 1):
        assert abs(sum(r["source"] == "s0" for r in mixed[:n]) - n * 2 / 3) < 1.01


def test_small_source_does_not_end_the_mixture(spark, sf_dir):
    docs = spark.range(2416).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "case when id < 16 then 'tiny' when id < 816 then 'mid' else 'big' end as source", "1L as n_chars")
    mixed = [r["source"] for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()]
    assert Counter(mixed) == {"tiny": 16, "mid": 800, "big": 1600}
    share = 800**0.7 / (800**0.7 + 1600**0.7)
    rest = [s for s in mixed if s != "tiny"]
    for n in range(1, rest.index("big") + 1 + 1200):
        assert abs(rest[:n].count("mid") - n * share) < 16 * (1 + share) + 1
    assert set(mixed[-16:]) == {"big"}


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=3):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= distance:
                    label[i], changed = label[j], True
    return label


def test_groups_follow_from_the_number_of_fingerprints():
    found = {n: simhash.groups_for(n, 3) for n in (10, 10**6, 10**7, 10**8, 10**9, 10**12)}
    assert found[10] == found[10**6] == 5 and found[10**7] == 6 and 7 <= found[10**8] <= found[10**9] <= found[10**12] == 9
    assert [len(simhash.grids(3, g)) for g in (5, 6, 8, 9)] == [10, 20, 56, 84]


@pytest.mark.parametrize("hot_cell, groups", [(simhash.HOT_CELL, None), (simhash.HOT_CELL, 6), (simhash.HOT_CELL, 8), (2, None), (4, 6), (4, 8), (12, 5)])
def test_links_equal_brute_force(spark, hot_cell, groups):
    r = np.random.default_rng(5)
    prints = {0, (1 << 64) - 1}
    for base in r.integers(0, 1 << 63, 12).tolist():
        for _ in range(6):
            x = base
            for b in r.integers(0, 64, int(r.integers(0, 6))).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    links = simhash.near_links(df, 3, hot_cell, groups).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all(1 <= (unsigned(a["u"]) ^ unsigned(a["v"])).bit_count() <= 3 for a in links)
    label = {x: x for x in prints}
    for _ in prints:
        for a in links:
            u, v = unsigned(a["u"]), unsigned(a["v"])
            label[u] = label[v] = min(label[u], label[v])
    want = [prints[k] for k in brute_components(prints)]
    groups = lambda xs: sorted(map(sorted, {k: [p for p, y in zip(prints, xs) if y == k] for k in xs}.values()))
    assert groups([label[x] for x in prints]) == groups(want)


def test_query_of_near_duplicates(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [brute_fingerprint(docs[i]) for i in ids]
    label = brute_components(prints)
    rows = {r["doc_id"]: r for r in queries.op5_simhash_near_dedup(spark, sf_dir).collect()}
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        assert (rows[i]["fingerprint"], rows[i]["component_id"]) == (f"{prints[k]:016x}", ids[label[k]])


def test_near_duplicates_of_edges(frame, edges):
    small = [e for e in edges if e[0] != 5]
    got = simhash.near_duplicates(frame(small)).collect()
    assert len(got) == len(small)
    prints = [brute_fingerprint(t) for _, t, _, _ in small]
    label = brute_components(prints)
    want = Counter()
    for (i, *_), p, k in zip(small, prints, label):
        ids = [small[j][0] for j in range(len(small)) if label[j] == k and small[j][0] is not None]
        want[i, p, min(ids, default=None)] += 1
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.deduplicate(frame(small))
    assert kept.count() == len(set(label)) and kept.columns == frame(small).columns
    assert simhash.near_duplicates(frame(small).limit(0)).count() == 0 and simhash.deduplicate(frame(small).limit(0)).count() == 0


def brute_nearest(rows, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine.setdefault((i, tuple(v)), np.array(v) / np.linalg.norm(v))
    out = {}
    for (q, v), unit in fine.items():
        if q % 50 == 0:
            found = sorted((-round(float(unit @ u), 12), i) for (i, w), u in fine.items() if i != q and len(w) == len(v))[:k]
            out[q] = [i for _, i in found]
    return out


@pytest.mark.parametrize("full_bucket", [ann.FULL_BUCKET, 5])
def test_neighbours_equal_brute_force(spark, monkeypatch, full_bucket):
    monkeypatch.setattr(ann, "FULL_BUCKET", full_bucket)
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(300)]
    rows += [(400 + i, rows[100][1]) for i in range(10)]  # copies of a query's vector: ties
    rows += [(350, None), (600, [0.0] * 8), (601, [float("nan")] * 8), (602, [1.0, None] * 4), (603, [float("inf")] * 8), (None, rows[3][1]), rows[7], rows[7]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, gid string, rank int")
    out = ann.nearest(df, lambda x: x % 50 == 0, k=5, how=ann.Probing(probes=4000, projections=4)).collect()
    want, got = brute_nearest(rows, 5), {}
    for x in sorted(out, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append(x["vec_id"])
        assert -1 <= x["score"] <= 1
    assert got == want
    assert ann.nearest(df.limit(0), lambda x: x % 50 == 0).count() == 0
    two = ann.nearest(df.where("vec_id in (50, 51)"), lambda x: x % 50 == 0).collect()
    assert [(x["query_id"], x["rank"], x["vec_id"]) for x in two] == [(50, 1, 51)]


def test_visits_follow_from_the_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((400, 24))
    close = [(i, (centres[i % 400] + 0.05 * r.standard_normal(24)).tolist()) for i in range(4000)]
    apart = [(i, x) for i, x in enumerate(r.standard_normal((4000, 24)).tolist())]
    found = {}
    for name, rows in (("close", close), ("apart", apart)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        classes = ann.distinct_vectors(ann.usable(df, "vec_id", "embedding").withColumn("asks", ann.F.col("vec_id") % 50 == 0), 5)
        assert classes.schema["v"].dataType.elementType == ann.T.FloatType()
        found[name] = ann.fitted(ann.true_neighbours(classes, 5), 4000)
    assert found["close"].probes <= 2 < found["apart"].probes
    want = brute_nearest([(i, [float(np.float32(x)) for x in v]) for i, v in close], 5)
    got = Counter()
    for x in ann.nearest(spark.createDataFrame(close, "vec_id long, embedding array<float>"), lambda x: x % 50 == 0).collect():
        got[x["query_id"]] += x["vec_id"] in want[x["query_id"]]
    assert sum(got.values()) >= 0.9 * sum(map(len, want.values()))
    assert ann.fitted([], 10) is None


def test_vectors_with_equal_hashes_stay_apart(spark, monkeypatch):
    real, tried = ann.F.xxhash64, []

    def clashing(seed, v):
        tried.append(1)
        return real(seed, v) if len(tried) > 1 else ann.F.lit(7).cast("long")

    monkeypatch.setattr(ann.F, "xxhash64", clashing)
    rows = spark.createDataFrame([(1, [1.0, 0.0], True), (2, [0.0, 1.0], False)], "vec_id long, v array<double>, asks boolean")
    assert sorted(r["ids"] for r in ann.distinct_vectors(rows, 5).collect()) == [[1], [2]] and len(tried) == 2


@pytest.mark.parametrize("block", [ann.SHORT_QUERIES, 2])
def test_queries_with_too_few_in_their_buckets_get_all(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "SHORT_QUERIES", block)
    monkeypatch.setattr(ann, "PACKED", 7 if block == 2 else ann.PACKED)
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(260)] + [(300 + i, r.standard_normal(9).tolist()) for i in range(4)]
    rows += [(400, [1.0, 0.0]), (401, [-1.0, 0.0]), (450, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(df, lambda x: x % 50 == 0, k=5, how=ann.Probing(tables=1, probes=1, width=0.1)).collect()
    got = {}
    for x in sorted(out, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    want = {q: ids for q, ids in brute_nearest(rows, 5).items() if ids}
    assert len(want[300]) == 3 and want[400] == [401] and 450 not in want
    assert got == want
    two = df.where("vec_id in (50, 51)")
    assert ann.nearest(two, lambda x: x % 50 == 0, how=ann.Probing(tables=1, probes=1, width=0.1)).count() == 1


def test_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 5)
    got = Counter()
    for r in queries.op8_nearest_neighbours(spark, sf_dir).collect():
        got[r["query_id"]] += r["vec_id"] in want[r["query_id"]]
    assert sum(got.values()) >= 0.9 * sum(map(len, want.values()))


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_measures_and_verdicts(frame, edges):
    odd = [(9000, "<<|>> ### " * 10 + prose("en", 1, 90), "en", "s0"), (9001, "a a a\na a a\n\n\nb\nb", "en", "s0")]
    rows = quality_rules.judge(frame(edges + odd)).collect()
    assert len(rows) == len(edges) + 2
    texts = {i: t for i, t, _, _ in edges + odd}
    for r in rows:
        want = brute_measure(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] and 100 <= r["doc_id"] < 9000:
            assert r["kept"]
    assert not next(r for r in rows if r["doc_id"] == 9000)["kept"]
    assert quality_rules.judge(frame(edges).limit(0)).count() == 0


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    n = 5000
    measured = spark.range(n).select(F.lit("x").alias("lang"), F.lit(1).alias("n_words"), (F.col("id") + 1).alias("word_chars"), F.lit(0).alias("n_symbols"), F.lit(1).alias("n_lines"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"))
    parts = quality_rules.sketches(measured.where("id % 3 = 0"), ["lang"]).unionByName(quality_rules.sketches(measured.where("id % 3 > 0"), ["lang"]))
    q = {r["measure"]: r for r in quality_rules.quantiles(parts, ["lang"]).collect()}
    assert q["word_length"]["rows"] == n and q["word_length"]["q1"] == pytest.approx(n / 4, rel=0.02) and q["word_length"]["q2"] == pytest.approx(3 * n / 4, rel=0.02)
    assert list(q) == ["word_length"]


def brute_verdicts(docs):
    """{doc_id: kept} and each group's quantiles, by sorting values in place of merging sketches."""
    names = list(quality_rules.MEASURES)
    counts = {d["doc_id"]: dict(zip(quality_rules.COUNTS, quality_rules.measure_text((d["text"] or "").encode()))) for d in docs}
    failed = {i: c["n_words"] < 50 or 2 * c["n_repeat_words"] > c["n_words"] for i, c in counts.items()}

    def value(i, m):
        over, under = quality_rules.MEASURES[m][:2]
        return counts[i][over] / counts[i][under] if counts[i][under] else None

    def quantile(ids, m):
        xs = sorted(binned(x) for i in ids if (x := value(i, m)))
        return len(xs), [xs[max(0, math.ceil(p * len(xs)) - 1)] if xs else 0.0 for p in quality_rules.MEASURES[m][2]]

    def binned(x):
        width = math.log1p(quality_rules.BIN_GROWTH)
        return 1e-9 * math.exp((math.floor(math.log(x / 1e-9) / width) + 0.5) * width)

    by = {}
    for d in docs:
        if not failed[d["doc_id"]]:
            for key in ((d["lang"], d["source"]), (d["lang"],), ()):
                by.setdefault(key, []).append(d["doc_id"])
    found = {(key, m): quantile(ids, m) for key, ids in by.items() for m in names}
    prior, out, fences = quality_rules.PRIOR_ROWS, {}, {}
    for d in docs:
        i, key = d["doc_id"], (d["lang"], d["source"])
        out[i] = not failed[i]
        for m in names if out[i] else ():
            (n, own), (k, wide), (z, every) = found[key, m], found[key[:1], m], found[(), m]
            every = [e if m == "word_length" else e * z / (z + quality_rules.ZERO_ROWS) for e in every]
            q = [(n * o + prior * (k * w + prior * e) / (k + prior)) / (n + prior) for o, w, e in zip(own, wide, every)]
            fences[key, m] = tuple(q)
            reach = 3 * max(q[1] - q[0], 0.02 * q[1]) * (math.sqrt(1 + 150 / counts[i]["n_words"]) if m == "word_length" else 1)
            x = value(i, m) or 0.0
            if x > q[1] + reach > 0 or m == "word_length" and x < q[0] - reach:
                out[i] = False
    return out, fences


def test_verdicts_equal_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, fences = brute_verdicts(docs)
    rows = queries.op9_quality_rules(spark, sf).collect()
    assert set(rows[0].asDict()) >= {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    assert len(rows) == len(docs) and [r["doc_id"] for r in rows if r["kept"] != want[r["doc_id"]]] == []
    assert any(not r["kept"] and not r["base_failed"] for r in rows)
    measured = quality_rules.checkpoint(quality_rules.measure(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")))
    limits = quality_rules.thresholds(measured.where("n_words >= 50 and 2 * n_repeat_words <= n_words")).collect()
    for r in limits:
        for m in quality_rules.MEASURES:
            if r[f"{m}_q1"] is not None:
                assert (r[f"{m}_q1"], r[f"{m}_q2"]) == pytest.approx(fences[(r["lang"], r["source"]), m], rel=0.021)
    for m in ("word_length", "repeat_share"):
        assert len({round(r[f"{m}_q2"], 9) for r in limits}) > 0.5 * len(limits)  # groups has fences of its own
        assert all(r[f"{m}_spread"] == r[f"{m}_q2"] - r[f"{m}_q1"] for r in limits)  # the resolution binds nowhere


def test_pipeline(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "simhash_near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, sizes = docs.columns, None, []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.checkpoint(stage(spark, docs, sf_dir))
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert before is None or ids <= before
        if name == "simhash_near_dedup":
            texts = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
            label = brute_components([p for _, p in texts])
            assert ids == {min(i for (i, _), k in zip(texts, label) if k == g) for g in set(label)}
        if name != "bpe":
            assert out.columns == columns
        docs, before = out, ids
        sizes.append(len(ids))
    assert sizes[-1] > 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == before


def test_pipeline_of_edges(spark, frame, edges, sf_dir):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
    docs, columns = frame(edges), list(corpus_pipeline.COLUMNS)
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.checkpoint(stage(spark, docs, sf_dir))
        rows = sorted(out.join(docs.select("doc_id", "text").distinct(), "doc_id", "left").collect() if name == "bpe" else out.collect(), key=key)
        before, now = Counter(kept), Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "language_id":
            assert {r["doc_id"] for r in rows}.isdisjoint({1, 2, 3, 4}) and all(i in {r["doc_id"] for r in rows} for i, *_ in edges if i and i >= 100)
            assert now[6, prose("de", 7, 80)] == 2 and now[None, prose("en", 3)] == 1 and now <= before
        elif name == "quality_classifier":
            model = corpus_pipeline.quality_knn.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            good = corpus_pipeline.quality_knn.score(docs, model).where("predicted = 1").collect()
            assert now == Counter((r["doc_id"], r["text"]) for r in good) and 0 < sum(now.values()) <= sum(before.values())
        elif name == "simhash_near_dedup":
            label = brute_components([brute_fingerprint(t) for _, t in kept])
            assert len(rows) == len(set(label)) and now <= before
        elif name == "mixing":
            assert now == before
        else:
            assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(i) for i, _ in kept) and out.where("n_tokens <> length(ids) / 4").count() == 0
        if name != "bpe":
            assert out.columns == columns
            kept = [(r["doc_id"], r["text"]) for r in rows]
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and empty.columns == out.columns
        docs = out
    assert kept


def test_stages_of_nothing_but_nulls(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = {name: stage(spark, docs, sf_dir).count() for name, stage in corpus_pipeline.STAGES}
    assert sizes == {"language_id": 0, "quality_classifier": 0, "simhash_near_dedup": 1, "mixing": 4, "bpe": 4}

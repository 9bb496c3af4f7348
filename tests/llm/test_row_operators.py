"""Operators that work text by text: languages, quality, toxicity, BPE, HTML."""

import hashlib

import numpy as np
import pytest
from conftest import LONG, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritally.llm import bpe, langid, quality_knn, queries, samples, toxicity, words

TOKENIZER = queries.TOKENIZER


@pytest.fixture(scope="module")
def languages(corpus):
    return langid.fit([(t.encode(), lang) for _, t, lang, _ in corpus])


def test_language_of_edges(frame, edges, languages):
    df = frame(edges)
    out = langid.identify(df, languages)
    rows = out.collect()
    assert len(rows) == len(edges)
    assert set(out.columns) == {*df.columns, "lang_pred", "coverage", "rejected"}
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 4):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["lang"] and r["doc_id"] and r["doc_id"] >= 100:
            assert r["lang_pred"] == r["lang"] and not r["rejected"]


def test_texts_without_letters_are_undecided(frame, languages):
    texts = ["١٢٣ — €", "²½", "👍🏽 — “”", "12 34", "…", "\u0301\u0302", "x", "é", "Ж", "漢"]
    got = [r["lang_pred"] for r in sorted(langid.identify(frame([(i, t, None, None) for i, t in enumerate(texts)]), languages).collect(), key=lambda r: r["doc_id"])]
    assert got[:6] == ["und"] * 6 and "und" not in got[6:]
    assert langid.letters("ÉCOLE—3".encode()) == "école ".encode() and langid.letters(b"AB-c") == b"ab-c"


def test_language_without_training_rows(spark, frame, edges):
    assert langid.train_on(frame(edges[:5]).limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(frame(edges), None).collect()} == {"und"}
    assert langid.identify(frame(edges).limit(0), None).count() == 0


def test_language_rejects_what_is_like_none(frame, languages):
    rows = [(1, "漢字 かな 한국어 漢字 漢字", None, None), (2, prose("en", 99), None, None)]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(frame(rows), languages).collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize("other", ["de", "es", "fr"])
def test_language_rejects_untrained_latin_script(spark, sf_dir, other):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").where("lang <> 'und' and length(text) between 200 and 40000")
    rows = [(r["text"].encode(), r["lang"]) for r in docs.select("text", "lang").orderBy("doc_id").limit(500).collect()]
    model = langid.fit([x for x in rows[::2] if x[1] != other])
    totals = np.array([model.word_rows(text.lower().split()).sum(axis=0) for text, _ in rows[1::2]])
    untrained = np.array([lang == other for _, lang in rows[1::2]])
    rejected = model.rejects(totals) if hasattr(model, "rejects") else (model.decide(totals)[1] < model.least_probability) | (model.decide(totals)[2] < model.least_coverage)
    assert rejected[untrained].mean() > 0.9 and rejected[~untrained].mean() < 0.02


def test_word_rows_equal_whole_text(languages):
    words = prose("fr", 5).lower().encode().split()
    buckets, share = langid._document(words)
    total = languages.word_rows(words).sum(axis=0)
    assert np.allclose(total[:-1] / total[-1], share @ languages.scores[buckets], atol=1e-4)


def held_out_auc(df, labels, column):
    from pyspark.sql import functions as F

    rows = df.where("held_out").join(labels.dropDuplicates(["doc_id"]).select("doc_id", F.col(column).alias("y")), "doc_id").where("y is not null").select("score", "y").toPandas()
    rank, y = rows["score"].rank().to_numpy(), rows["y"].to_numpy()
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize("name, label, size, least", [("op4_quality_classifier", "quality", "sf0.01", 0.95), ("op6_toxicity", "toxic", "sf0.1", 0.9)])
def test_held_out_ranking(spark, sf_dir, name, label, size, least):
    """On tables with enough held-out rows of each label: sf0.01 holds six toxic ones."""
    sf = sf_dir.replace("sf0.001", size)
    out = queries.QUERIES[name](spark, sf)
    assert held_out_auc(out, spark.read.parquet(f"{sf}/labels.parquet"), label) >= least


def test_held_out_languages(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    out = queries.op1_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right, n = out.where("lang = lang_pred").count(), out.count()
    assert n > 100 and right >= 0.97 * n


@pytest.fixture(scope="module")
def neighbours():
    good = [(prose("en", i, 70).encode(), 1) for i in range(30)]
    bad = [(("$$$ click ### " * 20 + prose("en", i, 10)).encode(), 0) for i in range(30)]
    return quality_knn.fit(good + bad)


def test_neighbour_votes_equal_brute_force(neighbours):
    counts = next(quality_knn.count_terms([prose("en", 77, 70).encode(), b"$$$ click ### word", b""], quality_knn.Features(quality_knn.word_terms)))[1]
    got = neighbours.score(counts, block=2)
    v = neighbours.vectors(counts)
    for i in range(3):
        cosine = [float(v[i] @ x) for x in neighbours.labelled]
        best = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: neighbours.neighbours]
        weight = [max(cosine[k], 0) ** 4 for k in best]
        want = sum(w * neighbours.labels[k] for w, k in zip(weight, best)) / sum(weight) if sum(weight) > 1e-9 else neighbours.prior
        assert got[i] == pytest.approx(want if i < 2 else 0.0, abs=1e-4)
    assert got[0] > 0.5 > got[1]


@pytest.mark.parametrize("repeats", [0, 1, 3])
def test_long_texts_count_like_short_ones(repeats, monkeypatch):
    text = (" ".join(f"word{i}" for i in range(3000)) + " ").encode() * (repeats + 1)
    whole = next(quality_knn.count_terms([text], quality_knn.Features(quality_knn.word_terms)))[1]
    monkeypatch.setattr(quality_knn, "BLOCK_BYTES", 800)
    monkeypatch.setattr(words, "BLOCK_BYTES", 800)  # parts of 100 words
    monkeypatch.setattr(words, "MEMO", 500)
    parts = list(quality_knn.count_terms([b"a b", text, b"c d e", text, text], quality_knn.Features(quality_knn.word_terms)))
    assert [(first, len(c)) for first, c in parts] == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1)]
    assert all(np.array_equal(parts[k][1], whole) for k in (1, 3, 4))
    share = 1 - (3000 if repeats else 2998) / (3000 * (repeats + 1) - 2)
    assert (whole[0, -len(quality_knn.LEVELS) :] > 0).tolist() == [share >= level for level in quality_knn.LEVELS]


def test_empty_texts_are_not_good(frame, edges, neighbours):
    rows = quality_knn.score(frame(edges), neighbours).collect()
    assert {(r["score"], r["predicted"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0.0, 0)}


def test_memos_are_bounded_by_bytes(own, monkeypatch):
    monkeypatch.setattr(words, "MEMO_BYTES", 1000)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 10_000)
    features = words.Features(lambda new: np.array([[len(w)] for w in new]))
    for i in range(50):
        table, ids = features([b"x" * 100 + str(i).encode(), b"y"])
        assert table[ids, 0].tolist() == [100 + len(str(i)), 1] and features._ids.size <= 1200
        own.encode(b"abc" * 300 + str(i).encode())
        assert own._size <= 20_000


def test_more_labels_than_fit_are_an_error(spark):
    rows = spark.range(20).selectExpr("id as doc_id", "id as label")
    with pytest.raises(ValueError):
        samples.bounded_sample(rows, "doc_id", "label", 5, max_labels=19)
    assert samples.bounded_sample(rows, "doc_id", "label", 5, max_labels=20).count() == 20


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from veritally.functions import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared.shared_folder(Cluster)


def test_quality_of_edges(frame, edges, neighbours):
    df = frame(edges)
    rows = quality_knn.score(df, neighbours).collect()
    assert len(rows) == len(edges)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality_knn.score(df.limit(0), neighbours).count() == 0


def test_quality_without_labels(spark, frame, edges):
    labels = spark.createDataFrame([(100, None), (None, 1)], "doc_id long, quality int")
    model = quality_knn.train_on(frame(edges), labels)
    assert {r["score"] for r in quality_knn.score(frame(edges), model).collect() if r["text"] and r["text"].strip()} == {0.5}


@pytest.fixture(scope="module")
def toxic(languages):
    bad = [(f"{prose(k, i, 30)} scum {prose(k, i + 50, 30)}".encode(), 1) for k in ("en", "de", "fr") for i in range(30)]
    good = [(prose(k, i + 200, 60).encode(), 0) for k in ("en", "de", "fr") for i in range(60)]
    order = np.random.default_rng(1).permutation(len(bad + good))
    return toxicity.fit([(bad + good)[i] for i in order], 1.0, languages)


def test_words_share_the_row_of_their_bucket(toxic):
    assert len(toxic.rows) == toxicity.BUCKETS and len(toxic.places) == toxic.rows.max() + 1
    rows = toxic.word_rows([b"scum", b"SCUM!!", b"neverheard"])
    assert rows[0] == rows[1] > 0 == rows[2] and not toxic.places[0].any()
    counts = toxicity.trained_buckets([[b"a", b"a"]] * 5 + [[b"b"]] * 4)
    assert counts[toxicity.bucket(b"A.")] == 1 and counts.sum() == 1


def test_thresholds_by_language(toxic):
    r = np.random.default_rng(3)
    logits = r.standard_normal(300)
    labels = (logits + r.standard_normal(300) > 1).astype(float)
    for weight in (1.0, 5.0):
        def f1(cut):
            hit, false = labels[logits > cut].sum(), weight * (1 - labels[logits > cut]).sum()
            return 2 * hit / (hit + false + labels.sum())
        assert f1(toxicity._threshold(logits, labels, weight)) == pytest.approx(max(f1(c) for c in logits))
    assert toxicity._threshold(logits[:10], labels[:10], 1.0, usual=0.7) == 0.7
    assert len(toxic.thresholds) == 4
    moved = toxicity.ToxicityModel(**(vars(toxic) | {"thresholds": np.array([3.0, 1.0, 0.0, 0.0])}))
    assert (moved.score(np.array([2.0, 2.0]), np.array([0, 1])) > 0.5).tolist() == [False, True]


def test_pooling_equals_plain_convolution(toxic):
    """Each text's filters slid over its own words alone, whatever stands beside it in a run; and in training."""
    r = np.random.default_rng(7)
    texts = [r.integers(0, len(toxic.places), n) for n in (0, 1, 2, 3, 40, 0, 5, 1)]

    def plain(rows):
        out, column = [], 0
        padded = [*(rows if len(rows) else [0]), 0, 0]
        for width in toxicity.WIDTHS:
            parts = [toxic.places[padded, column + k * toxicity.FILTERS : column + (k + 1) * toxicity.FILTERS] for k in range(width)]
            out.append(np.max([sum(parts[k][i + k] for k in range(width)) for i in range(len(padded) - 2)], axis=0))
            column += width * toxicity.FILTERS
        return np.concatenate(out)

    want = np.array([plain(t) for t in texts])
    for order in (range(8), reversed(range(8)), [3, 3, 0, 4, 7, 1]):
        order = list(order)
        got = toxic.pooled(np.concatenate([texts[i] for i in order]), np.array([len(texts[i]) for i in order]))
        assert np.allclose(got, want[order], atol=1e-5)
    assert np.allclose(toxic.pooled(np.zeros(0, np.int64), np.array([0])), plain([]))


def test_repeated_texts_score_the_same_beside_any_others(frame, toxic):
    bad = [f"you {w} scum" for w in ("are", "be", "look")]
    rows = [(i, t, None, None) for i, t in enumerate(["calm words", *bad, "calm words", "scum of it", "calm words", "", "scum", "calm words"])]
    rows = toxicity.score(frame(rows).coalesce(1), toxic).collect()
    assert len({r["score"] for r in rows if r["text"] == "calm words"}) == 1


def test_toxic_word_anywhere_in_a_text(frame, toxic):
    texts = ["scum " + LONG, LONG + " scum", prose("en", 300) + " SCUM!! " + prose("en", 301), prose("en", 302), prose("de", 303) + " scum.", prose("de", 304)]
    rows = toxicity.score(frame([(i, t, None, None) for i, t in enumerate(texts)]), toxic).collect()
    assert [r["predicted"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [1, 1, 1, 0, 1, 0]


def test_toxicity_of_edges(frame, edges, toxic):
    rows = toxicity.score(frame(edges), toxic).collect()
    assert len(rows) == len(edges)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert not any(r["predicted"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert toxicity.score(frame(edges).limit(0), toxic).count() == 0


def test_toxicity_without_labels(spark, frame, corpus):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_on(frame(corpus), labels)
    assert toxicity.score(frame(corpus[:3]), model).count() == 3


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(open(TOKENIZER, encoding="utf-8").read())


def test_bpe_of_edges(frame, edges, library):
    df = frame(edges)
    rows = bpe.encode_decode(df, TOKENIZER).collect()
    assert len(rows) == len(edges)
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(want, "<u4").tobytes() and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0), TOKENIZER).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(library, own, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text.encode("utf-8", "replace")) if not any(0xD800 <= ord(c) <= 0xDFFF for c in text) else None
    assert got is None or got == np.array(want, "<u4").tobytes()


def test_special_strings_and_long_words(library, own):
    for text in ("<|endoftext|>a<|startoftext|> b <|endof", "ab" * 2000, "the" * 300 + " 'll've 12٣", "x" * 193):
        assert own.encode(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text("abcdehinorst", min_size=1, max_size=40))
def test_scan_equals_heap(own, word):
    ids = [own.inner[b] for b in word.encode()]
    ids[-1] = own.last[word.encode()[-1]]
    assert own._scan([*ids]) == own._heap([*ids])


def test_query_digests(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_bpe_round_trip(spark, sf_dir).collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

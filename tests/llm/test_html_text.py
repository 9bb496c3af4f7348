"""Main text of pages: hand-made pages, the windows against brute force, the query against plain regular expressions."""

import re
import time
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritally.llm import html_text, queries

WORDS = ("A paragraph of real text with many words in it. " * 4).strip()
P = f"<p>{WORDS}</p>"
THREE = " ".join([WORDS] * 3)
SIDE = "<div class='sidebar'><p>Text at the side, short but long enough to surge if nothing spoke against it, which it does.</p></div>"


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='content has-sidebar'>", "<div class='content with-ads'>", "<div class='no-comments'>", "<div id='post' class='comments-closed'>", "<div class='widget'>", "<form id='page'>",
     "<article class='comments'>", "<article class='post comment-status-open'>", "<div title='a hidden gem'>", "<div data-hidden='false'>", "<div hidden>", "<section role='main' class='search'>"],
)
def test_wrapper_of_all_text_stays(wrapper):
    page = f"<html><body><nav><a href=/>Home</a></nav>{wrapper}{P * 3}</{wrapper[1:].split()[0]}>{SIDE}</body></html>"
    assert html_text.main_text(page) == THREE


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>x</title><meta charset=utf-8><body>{P * 3}", THREE),
        ("<body><article><p>See <a href='/hidden/x' class='share'>this page</a> and on.</p></article>", "See this page and on."),
        ("<body><article><p>Up.</p><p class='share-price'>The price: 3</p></article>", "Up. The price: 3"),
        ("<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>3</mn></math> be.</p></article>", "Let x=3 be."),
        (f"<body><div><p>{WORDS}</p></div><div id='comments'>{P * 9}</div></body>", WORDS),
        (f"<body><main><h1>T</h1>{P}</main><div id='disqus_thread'>{P * 9}</div>", f"T {WORDS}"),
        (f"<body><article><h1>T</h1>{P}<section class='comments'><h2>Said</h2><article class='comment'><p>{WORDS}</p></article></section></article>", f"T {WORDS}"),
        (f"<body><div>{P}<div class='advert'>Buy</div><p>Short end.</p></div><footer>f</footer><div>Made in 3 s</div>", f"{WORDS} Short end."),
        (f"<body><div><section>{P * 9}</section><div class='ad-slot'>Buy</div><section>{P}</section></div>", " ".join([WORDS] * 10)),
        (f"<body><article>{P}<p class=ad>Buy this now<p>{WORDS}</p></article>", f"{WORDS} {WORDS}"),
        (f"<body><header><h1>Site</h1></header><article><header><h1>T</h1></header>{P}<footer>by me</footer></article><footer>x</footer>", f"T {WORDS}"),
        (f"<body><div><a href=1>Home</a></div><div><a href=2>News and much more news</a></div><h1>T</h1>{P}<div><a href=3>Imprint</a></div>", f"T {WORDS}"),
        ("<body><article><p>a&amp;b &lt;i&gt; a<script>x('<p>')</script>b<!-- c -->c<br>d</p></article>", "a&b <i> abc d"),
        ("<body><article><ul><li><a href=x>One</a></li><li>Two</li></ul></article>", "One Two"),
        (f"<body><div>{P}<p><a href=x>All of it is told here</a></p></div><div><a href=3>Imprint</a></div>", f"{WORDS} All of it is told here"),
        (f"<body><div><h1>T</h1>{P * 4}</div><div class='talkback'><p>Well said, thank you.</p></div>", " ".join(["T", *[WORDS] * 4])),
        (f"<body><div><h1>T</h1>{P * 4}</div><ul><li>A teaser</li><li>Another teaser</li></ul>", " ".join(["T", *[WORDS] * 4])),
        (f"<body><article><h1>A</h1><p>by B</p><p>May 3</p><p>in C</p><p>D</p>{P}</article>", f"A by B May 3 in C D {WORDS}"),
        ("", ""),
        ("<nav><a href=/>Home</a></nav>", ""),
    ],
)
def test_pages_by_hand(page, want):
    assert html_text.main_text(page) == want


def brute_kept(weights, kinds, window):
    """Line numbers of the high stretches, each decided from the definition."""
    n = len(weights)
    total = lambda i: sum(weights[k] for k in range(i, min(n, i + window)) if all(kinds[x] == kinds[i] for x in range(i, k + 1)))
    runs = []
    for i in range(n):
        if weights[i] > 0 and not any(i in r for r in runs):
            live = [k for k in range(i, n) if all(kinds[x] == kinds[i] and total(x) > 0 for x in range(i, k + 1))]
            runs.append(range(i, max(k for k in live if weights[k] > 0) + 1))
    peak = {r: max(map(total, r)) for r in runs}
    highest = max([peak[r] for r in runs if kinds[r[0]] < 2], default=0)
    limit = lambda kind: max(60 if kind >= 2 or highest >= 60 else 0, 0.15 * highest)
    return sorted(k for r in runs if peak[r] >= limit(kinds[r[0]]) for k in r)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.0, 1.0, 5.0, 30.0, 70.0, 900.0]), st.integers(0, 3)), max_size=30), st.integers(1, 4))
def test_surge_and_dive_equal_brute_force(lines, window):
    weights, kinds = [w for w, _ in lines], [k for _, k in lines]
    assert html_text.kept_lines(weights, kinds, None, window) == brute_kept(weights, kinds, window)


def plain(html):
    """An article's blocks by regular expressions: right for the plain pages of the test tables only."""
    inner = re.search(r"<article>(.*?)</article>", html or "", re.S)
    blocks = re.split(r"</?(?:p|h1|div)\b[^>]*>", inner[1]) if inner else []
    return " ".join(filter(None, (" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks)))


def test_query_equals_plain_reading(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op10_html_text(spark, sf).collect()
    assert len(rows) == len(pages) and set(rows[0].asDict()) == {"page_id", "url", "text", "n_chars"}
    for r in rows:
        page = pages[r["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], plain(page["html"]), len(plain(page["html"])))


def test_surge_and_dive_decide_on_the_pages(spark, sf_dir):
    """Without the windows, lines with weight, unpenalised or long ones are another text on most pages; without any names and classes the windows still find nearly the same letters."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()]
    same, both, found, wanted = [0, 0], 0, 0, 0
    for html in pages:
        lines, want = html_text.lines_of(html), html_text.main_text(html)
        weight, _ = html_text.weights(lines)
        kept = ([w > 0 for w in weight], [w >= html_text.SURGE for w in weight])
        for k, keep in enumerate(kept):
            same[k] += " ".join(x.text for x, y in zip(lines, keep) if y) == want
        main = set(html_text.kept_lines(*html_text.weights(lines), [x.boxes for x in lines]))
        for x in lines:
            x.content = x.penalised = False
        unnamed = set(html_text.kept_lines(*html_text.weights(lines), [x.boxes for x in lines]))
        size = lambda own: sum(len(lines[k].text) for k in own)
        both, found, wanted = both + size(main & unnamed), found + size(unnamed), wanted + size(main)
    assert max(same) < 0.3 * len(pages), (same, len(pages))
    assert both > 0.95 * found and both > 0.99 * wanted, (both, found, wanted)


@pytest.mark.parametrize("piece", ["<a ", "<select>", '<a "', "<div class=ad>", "<title>", "<!--", "<script>", "</div>", "<p class=ad>", "<article><p>x", "&"])
def test_time_is_linear(piece):
    began = time.perf_counter()
    html_text.main_text(piece * 100_000)
    assert time.perf_counter() - began < 20


def test_pages_of_edges(spark):
    from pyspark.sql import functions as F

    pages = [(1, None), (2, ""), (3, "<p></p>"), (4, f"<article>{P}</article>"), (4, f"<article>{P}</article>"), (5, "plain words only"), (6, "<div><p>unclosed <b>words <p>more"), (7, "<p>" + "long text " * 200_000), (8, "<" * 2000)]
    df = spark.createDataFrame([(i, h, "x") for i, h in pages], "page_id long, html string, text string")
    got = [r["t"] for r in df.select("page_id", html_text.extract(F.col("html")).alias("t")).collect()]
    assert got[:3] == ["", "", ""] and got[3] == got[4] == WORDS and got[5] == "plain words only"
    assert got[6] == "unclosed words more" and len(got[7]) == 1_999_999 and isinstance(got[8], str)
    assert df.limit(0).select(html_text.extract(F.col("html"))).count() == 0

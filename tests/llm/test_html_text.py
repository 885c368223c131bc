"""Main text of pages: rules by hand, and the given pages by their article element."""

import html
import os
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from tallymill.llm import html_text

SMALL = "/root/testdata/sf0.001/pages.parquet"
LONG = "The first thing to know of this is that it was for all of us and not only for one, so that we can be with it. " * 3


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; me</footer>", ["A & B", LONG, "Short."]),
        (f"<div id=main><h2>Head</h2><p>{LONG}<p>Also short one here<p>{LONG}</div><div class='cookie-notice'>{LONG}</div>", ["Head", LONG, "Also short one here", LONG]),
        (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><form>{LONG}</form><aside>x</aside><p>End&nbsp; \n of it</p></article>", [LONG, "End of it"]),
        (f"<article><header><h1>Top</h1></header><p>a<b>b</b><br>c</p></article><section id='comments'><article class=comment><p>{LONG}</p></article></section>", ["Top", "ab c"]),
        (f"<main><p><b>{LONG}<br><p>Next, unclosed", [LONG, "Next, unclosed"]),
        ("<ul><li><a href=1>One link here</a></li><li><a href=2>Two</a></li></ul>", []),
        (f"<script>never closed <p>{LONG}</p>", []),
        ("<!-- <p>x</p> --><article><p>&lt;p&gt; &#x41;&eacute; < 5</p></article>", ["<p> Aé < 5"]),
    ],
)
def test_rules(body, want):
    assert html_text.main_text(page(body)) == "\n".join(" ".join(w.split()) for w in want)


@pytest.mark.parametrize(
    "given",
    [
        f"<script>for(i=0;i<n;i++){{f(i)}}</script><article><p>{LONG}</p></article><script>x</script>",
        f"<html><head><meta charset=utf-8><title>T</title><body><p>{LONG}</p></body></html>",
        f"<div class='layout has-sidebar'><p>{LONG}</p><div class=ad>{LONG}</div></div>",
        f"<div class='sidebar-layout'><p>{LONG}</p><div class=ad>{LONG}</div></div>",
        f"<article class='post comments-open'><p>{LONG}</p></article><p>Also {LONG}</p>",
    ],
)
def test_whole_articles_are_kept(given):
    assert html_text.main_text(given) == LONG.strip()


@pytest.mark.parametrize(
    "given",
    [
        f"<body><a name='top'><p>{LONG}</p></body>",
        f"<body><a name='top'/><p>{LONG}</p></body>",
        f"<body><a href='#top'><p>{LONG}</p></body>",
        f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav><h1></h1><p>{LONG}</p></form></body>",
        f"<body><form action=x><p>{LONG}</p></body>",
        f"<body><p>{LONG}</p><form><input name=a><p>{LONG}</p></form></body>",
        f"<body><button>Press<p>{LONG}</p></body>",
        f"<body><audio src=x><p>{LONG}</p><audio src=y>old</audio></body>",
        f"<body><p title=it's class=a>{LONG}</p></body>",
        f'<body><p title="a > b" class=\'"\'>{LONG}</p></body>',
        f"<body><nav><a href=x>Home</a><article><p>{LONG}</p></article></body>",
    ],
)
def test_unbalanced_pages(given):
    assert html_text.main_text(given) == LONG.strip()


def test_other_languages():
    text = "これは日本語の文章です。記事の本文は長く、いくつかの文からなります。" * 4
    given = f"<body><ul><li><a href=1>一覧</a></li></ul><h1>見出し</h1><p>{text}</p><p>短い文。</p><p>{text}</p><div>日本 東京 大阪 京都 奈良 神戸 札幌 福岡 仙台 広島 千葉 横浜</div></body>"
    assert html_text.main_text(given) == f"見出し\n{text}\n短い文。\n{text}"
    assert html_text.main_text("<body><div>" + "red blue green shop " * 30 + "</div></body>") == ""


@pytest.mark.parametrize(
    "given",
    ["<div>ab</div>" * 100_000, '<a "' * 100_000, "<div>" * 100_000, "<!" * 100_000, "<a b=\"x" * 100_000, "<script>" + "</script" * 100_000, "<form><nav>" * 50_000],
)
def test_long_pages_take_linear_time(given):
    begin = time.process_time()
    html_text.main_text(given)
    assert time.process_time() - begin < 5


def by_scanning(blocks, first, k):
    """Nearest decided neighbour, looked for outwards."""
    near = sorted((abs(j - k), j < k, j) for j, b in enumerate(blocks) if j != k and b.inside == 0 and first[j] != "short" and not b.aside)
    return first[near[0][2]] if near else "bad"


def test_neighbours_equal_a_scan():
    rng = random.Random(2)
    for _ in range(200):
        blocks = [html_text.Block(rng.choice(["x", LONG, "zzz " * 40]), 0, 0, rng.random() < 0.2, False) for _ in range(rng.randrange(1, 25))]
        done = html_text.decide([html_text.Block(**vars(b)) for b in blocks])
        # blocks that are not short keep their first label
        first = ["short" if len(b.text) < html_text.SHORT and not b.aside else d.label for b, d in zip(blocks, done)]
        assert [d.label for d in done] == [by_scanning(blocks, first, k) if f == "short" else f for k, f in enumerate(first)]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "a < b"), (3, "u", "a < b")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    assert [r[:2] for r in got] == sorted([r[:2] for r in rows], key=str) and all(r[3] == len(r[2]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_given_pages():
    """Their articles hold paragraphs only, so the truth is what stands between the article's tags."""
    for given in pq.read_table(SMALL).column("html").to_pylist():
        article = re.search(r"<article>(.*?)</article>", given, re.S).group(1)
        parts = re.split(r"</?(?:h1|p)>", article.replace("<br>", " "))
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert html_text.main_text(given) == "\n".join(t for t in texts if t)

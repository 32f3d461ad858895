import itertools
import os
import random

import numpy as np
import pytest

from tallyweave.llm import html_extract as m

W = np.array(m.train())


def test_minimum_cut_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 8)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a) if rng.random() < 0.6]
        cost = lambda x: sum(-u if keep else 0 for u, keep in zip(unary, x)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(m.minimum_cut(unary, edges)) - best) < 1e-9


def test_article():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{}</style></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- x --><div class='ad'>Buy the best shoes now.</div>"
        "<article><h1>Title &amp; more</h1><p><b>First   paragraph\nhas some words in it, quite a few of them.<br><p>Second one &eacute;&#233; is here, with enough words to tell.</p><p>Ok.</p></article>"
        "<form><p>Your mail</p><input></form><div id='comments'><p>I liked this a lot, thank you for it.</p></div><footer>&copy; someone</footer></body></html>"
    )
    want = ["Title & more", "First paragraph has some words in it, quite a few of them.", "Second one éé is here, with enough words to tell.", "Ok."]
    assert m.main_text(page, W) == "\n\n".join(want)
    assert m.main_text(page[: page.index("Second") + 6], W) == "\n\n".join([*want[:2], "Second"])


def test_odd_pages():
    assert m.main_text(None, W) == m.main_text("", W) == ""
    assert m.main_text("just text", W) in ("", "just text")
    m.main_text("<div>" * 30_000 + "x", W)
    m.main_text("<p" + "<" * 1000 + "</ >" + "&#xZZ; <script>", W)


def test_held_out_made_pages():
    rng = random.Random(123)
    hit = wrong = missed = 0
    for _ in range(100):
        page, content = m._made_page(rng)
        got = set(m.main_text(page, W).split("\n\n"))
        hit, wrong, missed = hit + len(got & set(content)), wrong + len(got - set(content)), missed + len(set(content) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.98


def test_extract(spark):
    rows = [(1, "u", "<p>A paragraph that is long enough to be one.</p>", "clash"), (2, None, None, ""), (1, "u", "", "")]
    got = m.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and got[1]["text"] == ""
    assert m.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WORDS = "This paragraph of the article has enough words in it to be told from a menu, and it ends well."


@pytest.mark.parametrize(
    "before,after",
    [
        ("<html><head><title>x</title><body><article><h1>Heading</h1>", "</article></body></html>"),
        ("<body><svg/><article><h1>Heading</h1>", "</article>"),
        ("<body><noscript>enable it<article><h1>Heading</h1>", "</article>"),
        ("<body><canvas/><article><h1>Heading</h1>", "</article>"),
        ("<body class='single comments-open sidebar-right'><div class='post has-comments'><h1>Heading</h1>", "</div>"),
        ("<body><div class='main-content no-sidebar'><h1>Heading</h1>", "</div>"),
        ("<body><div class='wrapper sidebar-left'><nav><a href=/>Home</a></nav><main><h1>Heading</h1>", "</main></div>"),
        ("<body><select><option>One<option>Two</select><article><h1>Heading</h1>", "</article><button>Go"),
        ("<body><article><svg><path d='M0'/><title>icon</title></svg><h1>Heading</h1>", "</article><iframe src='x'>"),
        ('<body><article><a title="it\'s>x</a><h1>Heading</h1>', "</article>"),
    ],
)
def test_legal_and_common_pages(before, after):
    got = m.main_text(f"{before}<p>{WORDS}</p><p>{WORDS}<svg/> {WORDS}</p>{after}", W).split("\n\n")
    assert got[-3:] == ["Heading", WORDS, f"{WORDS} {WORDS}"]


def test_hidden_text_is_not_content():
    page = f"<article><h1>Heading</h1><p>{WORDS} <button>Like</button><noscript><p>no scripts</p></noscript></p><template><p>{WORDS}</p></template><div hidden><p>{WORDS}</p></div></article>"
    assert m.main_text(page, W) == f"Heading\n\n{WORDS}"


def test_large_undecided_pages_end():
    rng = random.Random(5)
    n = 4000
    unary = [rng.uniform(-0.6, 0.6) for _ in range(n)]
    edges = [(k - 1, k, 0.5) for k in range(1, n)] + [(k - 7, k, 0.5) for k in range(7, n)]
    assert len(m.minimum_cut(unary, edges)) == n


def test_articles_of_the_pages_table():
    import html
    import re

    import duckdb

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    hit = wrong = missed = 0
    for (page,) in duckdb.sql(f"SELECT html FROM '{path}' WHERE html LIKE '%<article>%'").fetchall():
        article = page[page.index("<article>") : page.index("</article>") if "</article>" in page else len(page)]
        parts = re.split(r"</?(?:p|h1|h2|h3|li|ul|blockquote|article|div|section)\b[^>]*>", article)
        want = {t for p in parts if (t := re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p.replace("<b>", "").replace("</b>", "")))).strip())}
        got = set(m.main_text(page, W).split("\n\n"))
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit and hit / (hit + wrong) > 0.98 and hit / (hit + missed) > 0.98

from __future__ import annotations

import html
import itertools
import random
import re

from siltstone.llm.html_extraction import extract, main_text, min_cut


def test_cut_is_least():
    random.seed(4)
    for _ in range(60):
        n = random.randint(1, 8)
        odds = [random.choice([-3.0, -1, -0.5, 0.25, 1, 2.5]) for _ in range(n)]
        edges = [(a, b, random.choice([0.2, 0.7, 1.6])) for a, b in itertools.combinations(range(n), 2) if random.random() < 0.5]
        cost = lambda side: sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert abs(cost(min_cut(odds, edges)) - best) < 1e-9


def test_articles_of_the_table(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article[^>]*>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert main_text(r.html) == "\n".join(w for w in want if w)


def test_parts_of_a_page_that_go():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><ul class="menu"><li><a href=x>Home</a><li><a href=y>News</a></ul>
    <div class="cookie-notice">We use cookies to make this site better for you.</div><div id=content><h2>A heading</h2><p>First&nbsp;paragraph &amp; more of it,\n with <b>bold</b> words.<p>Short one.
    <script>var s = "<p>not text</p>";</script><p>Another paragraph with enough words to look like the text of an article.</div>
    <div id="comments"><p>Great post! I really enjoyed all of this, thank you very much.</p></div><form>Sign up <input name=q> for the weekly letter <button>Go</button></form><aside>Related stories that others read.</aside><footer>Imprint</footer>"""
    assert main_text(page).split("\n") == ["A heading", "First paragraph & more of it, with bold words.", "Short one.", "Another paragraph with enough words to look like the text of an article."]


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<p>", "x"), (3, "w", "<<<>><a <b", "x"), (4, "z", "<article>" + "<p>Some words of text here.</p>" * 3000 + "</article>", "x"), (4, "z", "<article><p>Twice.", "x")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows) and {r.text for r in out if r.page_id in (1, 2, None)} == {""}
    assert max(r.text.count("\n") for r in out) == 2999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

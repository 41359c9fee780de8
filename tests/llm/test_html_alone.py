"""Pages judged on their own: what leaks, what is lost, and odd input."""

from __future__ import annotations

import time

import pytest

from siltstone.llm.html_extraction import PRIOR, WEIGHTS, extract, fit, main_text

LONG = "A paragraph with enough words in it to look like the text of an article, and a few more."
OTHER = "Another block of prose that others wrote below, long enough to be taken for the text itself."
BOTH = pytest.mark.parametrize("weights", [PRIOR, WEIGHTS])


@BOTH
@pytest.mark.parametrize("outer", ["<div class='post'>{}</div>", "<article>{}</article>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize(
    "part",
    [
        "<ol class='commentlist'><li><p>{}</p><p>{}</p></li></ol>", "<div class='side-column'><p>{}</p></div>", "<div class='cookiebar'><p>{}</p></div>", "<div id='sidebarleft'><p>{}</p></div>",
        "<div class='leftsidebar'><p>{}</p></div>", "<div class='newsletterbox'><p>{}</p></div>", "<div class='wp-block-comments'><p>{}</p></div>", "<div class='AdContainer'><p>{}</p></div>",
    ],
)
def test_compound_names_of_frames_go(weights, outer, part):
    page = f"<body><nav><a href=x>Home</a></nav>{outer.format(f'<h1>Title</h1><p>{LONG}<p>{LONG}')}{part.replace('{}', OTHER)}<footer>Imprint</footer>"
    assert main_text(page, weights).split("\n") == ["Title", LONG, LONG]


@BOTH
@pytest.mark.parametrize("name", ["market-share", "search-algorithms", "privacy-law", "menu-of-the-day", "notice-periods"])
@pytest.mark.parametrize("outer", ["article", "main"])
def test_topics_in_names_stay(weights, name, outer):
    assert main_text(f"<{outer}><p>{LONG}<div class='{name}'><p>{OTHER}</div><p>{LONG}</{outer}>", weights).split("\n") == [LONG, OTHER, LONG]


@BOTH
@pytest.mark.parametrize("page", ["<p>Short.</p>", "Only words", "<html><body><div><h1>Gone</h1></div></body></html>", "<div>one two</div><nav><a href=x>Home</a></nav>"])
def test_short_pages_keep_their_words(weights, page):
    import re

    shown = re.sub("<nav>.*", "", page)
    assert main_text(page, weights) == re.sub("<[^>]*>", "", shown)
    assert main_text("<nav><a href=x>Home</a></nav><footer>Imprint</footer>", weights) == ""


@BOTH
def test_short_items_of_a_list_stay(weights):
    items = "".join(f"<li>{w}</li>" for w in ("one", "two", "three and more"))
    page = f"<body><nav><ul><li><a href=x>Home</a></ul></nav><div id=x><p>{LONG}<ul>{items}</ul><p>{LONG}</div><footer>Imprint of it, all rights reserved.</footer>"
    assert main_text(page, weights).split("\n") == [LONG, "one", "two", "three and more", LONG]


@BOTH
@pytest.mark.parametrize("tag", ["article", "main"])
def test_an_article_below_an_unclosed_navigation_stays(weights, tag):
    assert main_text(f"<nav><a href=x>Home</a><{tag}><p>{LONG}<p>{LONG}</{tag}><footer>Imprint</footer>", weights).split("\n") == [LONG, LONG]
    assert main_text(f"<{tag}><p>{LONG}<p>{LONG}</{tag}><aside><article><p>{OTHER}</article></aside>", weights).split("\n") == [LONG, LONG]


def test_a_page_alone_and_in_the_table_give_the_same(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(10**6, "u", f"<div class='market-share'><p>{LONG}</div><p>Short."), (10**6 + 1, "u", "<p>x")]
    whole = {r.page_id: r.text for r in extract(pages.unionByName(spark.createDataFrame(odd, pages.schema))).collect()}
    assert {i: main_text(h) for i, _, h in odd} == {i: whole[i] for i, _, _ in odd}
    assert all(main_text(r.html) == whole[r.page_id] for r in pages.collect())


def test_weights_are_what_the_pages_teach(spark):
    learnt = fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert all(abs(a - b) < 0.2 for a, b in zip(learnt, WEIGHTS, strict=True))


@pytest.mark.parametrize("odd", ["<!x", "<!--", "<?", "<a ", "<p", "<", "</", "<title>", "<div class='", "&"])
def test_broken_markup_takes_little_time(odd):
    began = time.process_time()
    main_text(odd * 100_000)
    assert time.process_time() - began < 1 and main_text(f"<p>{LONG}<!x").split("\n") == [LONG]

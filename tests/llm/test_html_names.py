"""Names of classes and ids: what is part of the article stays, whatever a part of its name says."""

import pytest

from vigil.llm import html

SCHEMA = "page_id long, url string, html string, host string, winner string"
KEPT = ['<section id="related-work">', '<p class="share-price">', '<div class="search-results">', '<p class="menu-of-the-day">', '<div class="notice-period">', '<span id="login-times">', '<section class="comment-guide">', '<div id="ad-hoc">', '<p class="promotion-to-major">']
LEFT = ['<div class="comments">', '<section id="comment-list">', '<div class="ad">', '<div class="ad-slot-2">', '<p class="notice">', '<ul class="related-posts">', '<div class="shareButtons">', '<div class="cookie consent">', '<aside class="x">', '<form id="x">', '<div role="navigation">']


def text_of(spark, page, url="http://a.example/1"):
    rows = [(i, url, p, "h", "w") for i, p in enumerate(page if isinstance(page, list) else [page])]
    out = {r.id: r.text for r in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [out[i] for i in range(len(rows))]


def test_names_inside_an_article(spark):
    close = lambda tag: f"</{tag[1:].split()[0]}>"
    pages = [f"<html><body><nav>menu</nav><article><h1>Title</h1><p>First words of it.</p>{tag}the inner words{close(tag)}<p>Last.</p></article></body></html>" for tag in KEPT + LEFT]
    got = text_of(spark, pages)
    assert [("the inner words" in t) for t in got] == [True] * len(KEPT) + [False] * len(LEFT)
    assert all(t.startswith("Title\nFirst words of it.") and t.endswith("Last.") for t in got)


@pytest.mark.parametrize("name", ["comment-guide", "share", "search results", "ad"])
def test_the_article_itself_stays(spark, name):
    page = f'<body><div class="menu">x</div><article class="{name}" id="{name}"><p>All of the words.</p></article><footer>y</footer></body>'
    assert text_of(spark, page) == ["All of the words."]


def test_the_vote_decides_for_hosts_without_an_article(spark):
    """Most pages of the host hold their text in one container, a teaser box is longer on a few of them."""
    body = lambda n, m: f'<body><div class="box"><div class="story s{n}"><p>{"story words " * 20}</p><p class="share-price">{n} points</p></div><div class="extra"><p>{"other words " * m}</p></div></div></body>'
    got = text_of(spark, [body(i, 60 if i % 5 == 0 else 3) for i in range(40)])
    assert all(t == "story words " * 19 + f"story words\n{i} points" for i, t in enumerate(got))


def test_equal_votes_give_one_answer(spark):
    page = '<body><div class="a"><p>same words here</p></div><div class="b"><p>same words here</p></div></body>'
    first = text_of(spark, [page] * 4)
    assert len(set(first)) == 1 and first == text_of(spark, [page] * 4) and first[0] in ("same words here", "same words here\nsame words here")

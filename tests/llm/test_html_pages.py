"""Main text: names are votes, wrappers stay, broken markup costs linear time, and a plain version for the pages of the tables."""

import os
import re
import time
from html import unescape

import pytest

from readmill.llm.html_extract import main_text

TABLES = [f"/root/testdata/{sf}/pages.parquet" for sf in ("sf0.001", "sf0.01", "sf0.1")]


def sentences(n, first=0):
    return " ".join(f"This is sentence number {k} of a text with some words in it." for k in range(first, first + n))


BODY = f"<h1>T</h1><p>{sentences(4)}</p><p>{sentences(5, 4)}</p>"
TEXT = f"T {sentences(4)} {sentences(5, 4)}"
AROUND = '<nav><a href=/>Home</a></nav>{}<div class=sidebar><h3>Popular</h3><ul><li><a href=1>One post</a></li></ul></div><footer>Foot</footer>'


@pytest.mark.parametrize("name", ["site has-sidebar", "content no-sidebar", "post comments-open", "elementor-widget-wrap", "sidebar-left", "widget-area main-sidebar", "wrapper nav-collapsed", "menu"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>"])
def test_wrappers_stay_whatever_their_names(name, inner):
    page = AROUND.format(f'<div id=page class="{name}">{inner.format(BODY)}</div>')
    assert main_text(f"<html><body>{page}</body></html>") == TEXT


@pytest.mark.parametrize("name", ["content no-sidebar", "post comments-open", "elementor-widget-wrap", "wrapper nav-collapsed"])
def test_wrappers_of_plain_elements(name):
    comments = f"<div class=comments><h3>2 comments</h3><p>{sentences(3, 40)}</p></div>"
    assert main_text(f'<body><div class=menu><a href=/>Home</a></div><div class="{name}">{BODY}</div>{comments}') == TEXT


@pytest.mark.parametrize("section", ["<section id=social-history>", "<section id=register>", '<section class="share-price-analysis">', "<section id=legal-notice>"])
def test_sections_of_an_article_with_names_of_other_parts(section):
    page = f"<body><article><h1>T</h1><p>{sentences(4)}</p>{section}<h2>More</h2><p>{sentences(6, 10)}</p></section><p>{sentences(5, 4)}</p></article>"
    assert main_text(page) == f"T {sentences(4)} More {sentences(6, 10)} {sentences(5, 4)}"


@pytest.mark.parametrize("part", ["<div class=comments>", "<div class='comment-list'>", "<div id=share-buttons>", "<aside>", "<div class=cookie-banner>", "<div class='ad ad-slot-1'>", "<div class=newsletter-box>"])
def test_parts_that_are_no_article_go(part):
    end = "</aside>" if "aside" in part else "</div>"
    assert main_text(f"<body><article>{BODY}{part}<p>{sentences(2, 30)}</p>{end}</article>") == TEXT


def test_articles_of_any_size_beside_each_other():
    page = f"<body><main><article><h1>A</h1><p>{sentences(20)}</p><p>{sentences(20, 20)}</p></article><article><p>{sentences(1, 50)}</p></article></main>"
    assert main_text(page) == f"A {sentences(20)} {sentences(20, 20)} {sentences(1, 50)}"
    teaser = "<div class=related-posts><article><h3><a href=1>A title of it</a></h3><p>One teaser line.</p></article></div>"
    assert main_text(f"<body><article>{BODY}</article>{teaser}") == TEXT
    assert main_text(f"<body><article>{BODY}</article><article><h3><a href=1>A title of it</a></h3><p>One teaser line.</p></article>") == TEXT


@pytest.mark.parametrize("name", ["post comments-open", "post"])
def test_equal_posts(name):
    page = "".join(f'<div class="{name}"><h2>P{k}</h2><p>{sentences(5, 10 * k)}</p></div>' for k in range(3))
    assert main_text(f"<body>{page}") == " ".join(f"P{k} {sentences(5, 10 * k)}" for k in range(3))


@pytest.mark.parametrize("piece", ["<a b=", "<!--x", "</a ", '<a b="x ', "<![CDATA[", "<?x", "<!x", "<", "&", "<a b='"])
@pytest.mark.parametrize("end", ["", ">", "-->"])
def test_broken_markup_costs_linear_time(piece, end):
    began = time.perf_counter()
    main_text(piece * 100_000 + end)
    text = main_text(f"<article><p>{sentences(9)}</p></article>" + piece * 100_000 + end)
    assert time.perf_counter() - began < 4 and sentences(9) in text


def test_what_follows_the_last_tag():
    assert main_text(f"<p>{sentences(3)}</p> and &amp; the rest") == f"{sentences(3)} and & the rest"
    assert main_text(f"<p>{sentences(3)}</p><!-- no end <p>hidden</p> x") == sentences(3)
    assert main_text(f"<p>{sentences(3)} a < b</p> end <b class=x") == f"{sentences(3)} a < b end"
    assert main_text("no tags &lt; at all") == "no tags < at all"


# --- a plain version for well-formed pages with one article each, as those of the tables are ------------------------------------------

INLINE = set("a abbr b bdi bdo cite code em i kbd mark q s small span strong sub sup time u var wbr font img".split())
OUT = set("nav aside footer form script style noscript header button".split())


def plain(html):
    article = re.search(r"<article\b.*</article>", html, re.S)[0]
    lines, skipped, path = [""], 0, []
    for token in re.findall(r"<[^>]*>|[^<]+", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", article, flags=re.S)):
        tag = re.match(r"<(/?)([a-z0-9]+)([^>]*)>", token)
        if not tag:
            lines[-1] += "" if skipped else unescape(token)
            continue
        if tag[2] not in INLINE:
            lines.append("")
        if tag[2] in ("br", "hr", "img", "wbr"):
            continue
        if tag[1]:
            skipped -= path.pop()
        else:
            path.append(tag[2] in OUT or bool(re.search(r"\b(ad|comments?|share|related|newsletter|promo|sidebar)\b", tag[3])))
            skipped += path[-1]
    return " ".join(" ".join(x.split()) for x in lines if x.split())


@pytest.mark.parametrize("table", TABLES)
def test_all_pages_of_the_tables(table):
    import pyarrow.parquet as pq

    if not os.path.exists(table):
        pytest.skip("no such table here")
    pages = pq.read_table(table).column("html").to_pylist()
    assert len(pages) >= 50 and all(main_text(h) == plain(h) for h in pages if h)

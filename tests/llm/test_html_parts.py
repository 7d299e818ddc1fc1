"""Pages whose text stands in several elements."""

from __future__ import annotations

import html
import re
import time

import pytest

from tesserae.llm.html_extract import HtmlExtraction

LONG = "A paragraph of the text that goes on with many words and has no tags inside of it at all."
MENU = '<nav><a href="x">Home</a></nav>'


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<div id=content><h1>Title</h1><div class=lead>A lead.</div><div class=body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>", ["Title", "A lead.", LONG, LONG, LONG]),
        (f"<div><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p></section></div>", [LONG] * 4),
        (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>Short.</p></article>", [LONG] * 4 + ["Short."]),
        (f"<h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div>", ["Title", LONG, LONG]),
    ],
)
def test_parts_beside_the_longest_stay(page, expected):
    assert HtmlExtraction().main_text(f"<html><body>{MENU}{page}<footer>End</footer></body></html>").split("\n") == expected


@pytest.mark.parametrize("part", ['<section id="discussion">%s</section>', '<div class="text-widget">%s</div>', '<div id="sharing-data">%s</div>'])
def test_a_name_alone_hides_no_text_of_an_article(part):
    body = f'<h2 id="related-work">Related</h2><p class="notice">{LONG}</p>' + part % f"<p>{LONG}</p><p>{LONG}</p>"
    page = f'<html><body>{MENU}<article><p>{LONG}</p>{body}<div class="share"><a href="x">Share</a></div><div class="comments"><p>{LONG}</p></div></article></body></html>'
    assert HtmlExtraction().main_text(page).split("\n") == [LONG, "Related", LONG, LONG, LONG]


def test_the_threshold_decides_what_belongs_to_the_text():
    middle = "".join(f"<div><p>Some <b>words</b> of part {k} stand here.</p></div>" for k in range(3))
    page = f"<html><body>{MENU}<div><p>{LONG}</p><p>{LONG}</p></div>{MENU}<div>{middle}</div><div><p>{LONG}</p></div></body></html>"
    low, high = HtmlExtraction(threshold=0.1, sigma=0.3).main_text(page), HtmlExtraction(sigma=0.3).main_text(page)
    assert "part 1" in low and "part 1" not in high and high.split("\n") == [LONG] * 3


def test_text_beside_an_article_element_is_found_by_its_ratio():
    teaser = '<article><a href="x">Read on</a></article>'
    assert HtmlExtraction().main_text(f"<html><body>{MENU}{teaser}<div><p>{LONG}</p><p>{LONG}</p></div></body></html>").split("\n") == [LONG, LONG]


def test_forms_stay_only_around_content():
    page = f'<html><body><form>{MENU}<div><p>{LONG}</p><p>{LONG}</p></div></form></body></html>'
    assert HtmlExtraction().main_text(page).split("\n") == [LONG, LONG]
    assert HtmlExtraction().main_text(f"<article><p>{LONG}</p><p>{LONG}</p><form><p>Name</p><p>Mail</p></form></article>").split("\n") == [LONG, LONG]


def given(sf_dir):
    import duckdb

    return [x for (x,) in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet' WHERE html IS NOT NULL").fetchall()]


def plain(page):
    """An article's text by patterns, without events, ratios or elements."""
    article = re.search("<article>(.*?)</article>", page, re.S).group(1)
    lines = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|section|blockquote|pre|table|tr)\b[^>]*>", article)
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in lines]
    return "\n".join(x for x in lines if x)


def test_the_given_pages_have_the_text_of_their_articles(sf_dir):
    for page in given(sf_dir):
        assert HtmlExtraction().main_text(page) == plain(page)


def test_pages_do_not_need_article_elements(sf_dir):
    """The text of the given pages is the same with plain containers in place of articles."""
    for page in given(sf_dir):
        assert HtmlExtraction().main_text(re.sub("(</?)article>", r"\1div>", page)) == plain(page)


def test_the_clusters_decide_on_the_given_pages(sf_dir):
    """Without a threshold, or with furniture weighed like text, some pages have more than their article."""
    pages = given(sf_dir)
    for other in (HtmlExtraction(threshold=0.0, share=0.0), HtmlExtraction(doubt=1.0, share=0.0)):
        assert sum(other.main_text(x) != plain(x) for x in pages) * 3 > len(pages)
    assert all(HtmlExtraction(share=0.0).main_text(x) == plain(x) for x in pages)


def test_furniture_with_long_text_loses_and_alone_is_nothing():
    footer = f"<footer><p>{LONG}</p></footer>"
    assert HtmlExtraction().main_text(f"<html><body>{MENU}<div><p>Short text.</p><p>More of it here.</p></div>{footer}</body></html>").split("\n") == ["Short text.", "More of it here."]
    assert HtmlExtraction().main_text(f"<html><body>{MENU}{footer}</body></html>") == ""
    assert HtmlExtraction().main_text(f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside><p>End.</p></article>").split("\n") == [LONG, "End."]


@pytest.mark.parametrize("tag", ["font", "b", "span", "li", "td", "option", "p"])
def test_unclosed_tags_take_linear_time(tag):
    seconds = []
    for n in (5_000, 40_000):
        began = time.process_time()
        HtmlExtraction().main_text("<body>" + f"<{tag}>x" * n + f"<p>{LONG}" * 200)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * max(seconds[0], 0.05)


def test_deep_pages_take_linear_time():
    seconds = []
    for n in (5_000, 40_000):
        began = time.process_time()
        assert HtmlExtraction().main_text("<div>" * n + f"<p>{LONG}" + "</b></i>" * n + f"<h1>{LONG}") == f"{LONG}\n{LONG}"
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * max(seconds[0], 0.05)

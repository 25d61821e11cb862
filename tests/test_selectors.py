"""Structural selectors, chapter list parsers and failed pages."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import pages as PG, selectors as S

PAGE = "page_id long, url string, html string"
HTML = (
    '<body><div id="top" class="box wide"><section data-kind="Main list"><ul class="chapters"><li class="row"><a id="a1" href="/Chapter/1.html">1</a></li>'
    '<li><p><a id="a2" href="/chapter/2">2</a></p></li></ul></section></div><div class="lg:grid"><a id="a3" href="">3</a></div>'
    '<ul class="other"><li><a id="a4" rel="next nofollow" href="/x">4</a></li></ul></body>'
)


@pytest.fixture(scope="module")
def rows(spark):
    return PG.elements(spark.createDataFrame([(1, "https://h.com/", HTML)], PAGE)).where("tag = 'a'").cache()


@pytest.mark.parametrize("selector, expected", [
    ("a", "1234"), ("*", "1234"), ("#a1", "1"), ("ul a", "124"), ("ul.chapters a", "12"), ("div#top.wide a", "12"), (".box ul a", "12"),
    ("li > a", "14"), ("ul > a", ""), ("ul.chapters > li > a", "1"), ("div ul>li a", "12"), ("section > ul li > p > a", "2"),
    ("div > section a", "12"), ("ul div a", ""), ("[data-kind='Main list'] a", "12"), ("section[data-kind*='main'] a", ""),
    ("section[data-kind*='main' i] a", "12"), ("a[href^='/chapter']", "2"), ("a[href$='.html']", "1"), ("a[rel~='next']", "4"), ("a[rel]", "4"),
    ("a[href='']", "3"), ("a[href*='']", ""), (r".lg\:grid > a", "3"), ("div[data-x] a", ""), ("ul.chapters li.row a[href*=Chapter]", "1"),
])
def test_selector_forms(rows, selector, expected):
    got = {r["id"] for r in rows.where(S.matches(selector)).collect()}
    assert got == {f"a{n}" for n in expected}


@pytest.mark.parametrize("selector", ["", "a + b", "a ~ b", "a:first-child", "a, b", "> a", "a >", "a > > b", "a[b|='c']", "a[b='c' x]"])
def test_unsupported_selectors_raise(spark, selector):
    with pytest.raises(ValueError, match="unsupported selector"):
        S.matches(selector)


def brute(chain, path):
    """Whether the last element of a path of class names meets a chain of (combinator, name)."""
    def at(k, i):
        if path[i] != chain[k][1]:
            return False
        if k == 0:
            return True
        return any(at(k - 1, j) for j in ([i - 1] if chain[k][0] == ">" else range(i)) if j >= 0)
    return at(len(chain) - 1, len(path) - 1)


def test_chains_against_brute_force(spark):
    rng = random.Random(2)
    paths = [[rng.choice("xyz") for _ in range(rng.randint(1, 7))] for _ in range(60)]
    pages = [(i, "https://h.com/", "".join(f'<div class="{c}">' for c in p)) for i, p in enumerate(paths)]
    rows = PG.elements(spark.createDataFrame(pages, PAGE))
    last = rows.groupBy("page_id").agg(F.max_by(F.struct("tag", "id", "classes", "attrs", "above"), "pos").alias("e")).select("page_id", "e.*")
    chains = [[(" " if k == 0 else rng.choice(" >"), rng.choice("xyz")) for k in range(rng.randint(1, 4))] for _ in range(25)]
    texts = ["".join((f" {c} " if c == ">" else " ") + f".{n}" for c, n in chain) for chain in chains]
    got = last.select("page_id", F.array(*[S.matches(t) for t in texts]).alias("m")).collect()
    assert {r["page_id"]: r["m"] for r in got} == {i: [brute(c, p) for c in chains] for i, p in enumerate(paths)}


def test_ordered_list_items_and_labels(spark):
    html = (
        "<ol role='list' aria-label='List of chapters'><li role='listitem'><b>new</b><a href='/preview/1'><span class='flex-1 truncate'> Chapter 1 </span> x</a>"
        "<a href='/preview/9'>Chapter 9</a></li><li role='listitem'><a>no address</a></li><li><a href='/preview/3'>Chapter 3</a></li>"
        "<li role='listitem'><a href='/preview/1'>Ch. 1.5 again</a></li></ol>"
    )
    pages = spark.createDataFrame([(1, "https://h.com/s", html), (2, "https://h.com/s", None), (3, "https://h.com/s", "")], PAGE)
    got = PG.ordered_chapters(PG.elements(pages), pages).collect()
    assert [(r["url"], r["number"], r["title"]) for r in got] == [("https://h.com/preview/1", "1.5", "Ch. 1.5")]


def test_failed_pages_have_a_status(spark, monkeypatch):
    def feed(self, html):
        if "broken" in html:
            raise AssertionError("bad mark")
        super(PG._Elements, self).feed(html)

    monkeypatch.setattr(PG._Elements, "feed", feed)
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3], "html": ["<h1>good</h1>", "<h1>part</h1>broken", None]})
    rows = [r for b in PG._parse(iter([batch])) for r in b.to_pylist()]
    assert [(r["page_id"], r["tag"], r["text"]) for r in rows] == [(1, "h1", "good"), (2, PG.FAILED, "AssertionError: bad mark")]
    pages = spark.createDataFrame([(i, "https://h.com/", "") for i in (1, 2, 3)], PAGE)
    table = spark.createDataFrame([(r["page_id"], r["tag"], r["text"]) for r in rows], "page_id long, tag string, text string")
    status = {r["page_id"]: (r["parsed"], r["error"]) for r in PG.parse_status(table, pages).collect()}
    assert status == {1: (True, None), 2: (False, "AssertionError: bad mark"), 3: (True, None)}


def test_preview_links_of_known_hosts(spark):
    html = "<div class='chapters'><a href='/preview/77'>Chapter 7</a><a href='/series/other/chapter-2'>Chapter 2</a></div>"
    pages = spark.createDataFrame([(1, "https://manhwazone.com/series/big", html), (2, "https://h.com/series/big", html)], PAGE)
    assert [(r["page_id"], r["url"]) for r in PG.chapter_links(PG.elements(pages), pages).collect()] == [(1, "https://manhwazone.com/preview/77")]

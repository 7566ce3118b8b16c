import random

import pytest

from tamiz.llm.webpages import Page, _Ranges, extract_main_text


def text(html):
    return Page(html).main_text(set())


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("just text", "just text"),
        ("<article><h1>T &amp; t&am</h1><p><b>One  two<br><p>Three&nbsp;<i>fo</i>ur</article><footer>f", "T & t&am\nOne two\nThree four"),
        ("<nav><ul><li><a>x</a><li>y</ul></nav><div class='ad'>buy</div><article><p>a</p></article>", "a"),
        ("<body><header>h</header><main><p>a<aside>s</aside><p>b</main><footer>f</footer>", "a\nb"),
        ("<article><p>a</p><div class='comments'><article>c</article></div><form>f</form></article>", "a"),
        ("<article>a<script>var x='</p><p>no';</script>b<style>p{}</style>c</article>", "abc"),
        ("<article>a<!-- no <p> --><p>b", "a\nb"),
        ("<article><p>1 < 2 & 3 > 2</p><p>&lt;b&gt; &#233;&eacute;&#x1F600;</p></article>", "1 < 2 & 3 > 2\n<b> éé😀"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<div class='cookie-notice'>n</div><p>x</p><div id=sidebar>s</div><div role='navigation'>r</div>", "x"),
        ("<article><p>a</p></article></div></p><p", "a"),
        ("<ARTICLE><P CLASS=x>Up</P></ARTICLE>", "Up"),
        ("<div class='ad'><article>kept</article>", "kept"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<article><p>" + "long " * 50000 + "</p></article>", ("long " * 50000).strip()),
    ],
)
def test_main_text(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<main><p>Body</p><section id=comments><article class=comment>c</article></section></main>", "Body"),
        ("<div><p>Body</p></div><section class='comment-list'><article>c</article><article>d</article></section>", "Body"),
        ("<main><p>Body</p><div class='related'><article><p>teaser</p></article></div></main><footer>f</footer>", "Body"),
        ("<main><p>Body</p><article class=teaser><p>t</p></article></main>", "Body"),
        ("<article><p>a</p></article><section class=comments><article>c</article></section>", "a"),
        ("<main><article><p>a</p></article><p>b</p></main><p>out</p>", "a\nb"),
        ("<main><article><p>a</p></article></main>", "a"),
        ("<div class='has-sidebar'><article class='post has-comments'><p>a</p></article></div><p>b</p>", "a"),
        ("<div class=related><article><p>a</p></article></div>", "a"),
    ],
)
def test_articles_that_are_comments_or_teasers(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><h2 id='social-effects'>Social effects</h2><p id=share-of-votes>x</p><h3 id=notice>n</h3></article>", "Social effects\nx\nn"),
        ("<article><section id='notice-period'><p>a</p></section><div class='cookie-recipe'><p>b</p></div></article>", "a\nb"),
        ("<article><p>a</p><div class='share-buttons'>s</div><div class='x ad-slot'>t</div><div id=comment-list>u</div></article>", "a"),
        ("<article><p>a</p><ul class='x-share-strip'><li><a>one</a><li><a>two</a></ul></article>", "a"),
    ],
)
def test_names_inside_articles(html, want):
    assert text(html) == want


LONG = "A sentence of the page. " * 10


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div class='container has-sidebar'><p>whole text</p></div>", "whole text"),
        ("<div id='search-algorithms'><h2>Search</h2><p>text</p></div>", "Search\ntext"),
        ("<div><p>a</p><section id='related-work'><p>b</p></section></div>", "a\nb"),
        ("<form id=aspnetForm><div><p>The body</p></div><input></form>", "The body"),
        ("<form id=aspnetForm><nav>n</nav><div><p>The body of it</p></div><div class=site-footer>f</div></form>", "The body of it"),
        ("<p>The text</p><form><p>Mail</p><button>Send</button></form>", "The text"),
        ("<p>The text</p><form class=newsletter><p>Longer than the text of the page</p></form>", "The text"),
        ("<article><header><h1>Title</h1><p>By me</p></header><p>a</p></article>", "Title\na"),
        ("<article><header class=banner-ad><h1>Buy</h1></header><p>a</p><aside><header><h2>x</h2></header></aside></article>", "a"),
        (f"<div class=sidebar-wrapper><p>{LONG}</p><div class=cookie-notice>{LONG}</div></div>", LONG.strip()),
        ("<div class=site-header>h</div><div id=main-nav-2>n</div><div class=ad_300x250>x</div><p>a</p><div class='left-sidebar'>s</div>", "a"),
        ("<div class='search-tips'><a>one</a><a>two</a></div><p>a</p>", "a"),
        ("<div class=ad>x</div><div class=footer><p>f</p></div>", ""),
    ],
)
def test_names_outside_articles(html, want):
    assert text(html) == want


def test_many_paragraphs():
    """Linear in the elements of a page: with each paragraph in a div of its own."""
    n = 40_000
    page = Page("<article>" + "<div><p>a</p></div>" * n + "</article>" + "<article><p>b</p></article>" * 2000)
    page.template_hashes()
    assert page.main_text({1}) == "\n".join(["a"] * n + ["b"] * 2000)


def test_ranges():
    rng = random.Random(4)
    for _ in range(300):
        some = [(a, a + rng.randint(0, 8)) for a in (rng.randint(0, 20) for _ in range(rng.randint(0, 6)))]
        found = _Ranges(some)
        for _ in range(20):
            a = rng.randint(0, 20)
            b = a + rng.randint(0, 8)
            assert found.around(a, b) == any(x <= a and b <= y for x, y in some)
            assert found.within(a, b) == any(a <= x and y <= b for x, y in some)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_recurring_subtrees_go(spark):
    """A block without any telling name is template on the site that repeats
    it, and text where it does not recur; prose of articles stays."""
    page = "<div class='q'><span>Our shop sells things</span></div><article><p>Text {0}</p><p>Same words.</p><div class='z'>Tell a friend</div></article>"
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(8)]
    rows += [(100, "https://b.example/1", "<div class='q'><span>Our shop sells things</span></div><p>Body</p>")]
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    assert got == {**{i: f"Text {i}\nSame words." for i in range(8)}, 100: "Our shop sells things\nBody"}


def test_template_without_article(spark):
    rows = [(i, "http://c.example/x", f"<div><b>Menu one</b></div><div><p>Own {i}</p></div><div>End</div>") for i in range(6)]
    assert {r["text"] for r in extract_main_text(pages(spark, rows)).collect()} == {f"Own {i}" for i in range(6)}


def test_copies_of_a_page_are_no_template(spark):
    """Copies under several urls, on a host with and without other pages."""
    copy = "<link rel=canonical href='/x?{0}'><div><p>First part</p></div><div><p>Second part</p></div>"
    rows = [(i, f"http://d.example/x?from={i}", copy.format(i)) for i in range(20)]
    rows += [(100 + i, f"http://d.example/{i}", f"<div><b>Menu</b></div><div><p>Own {i}</p></div>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    assert got == {**{i: "First part\nSecond part" for i in range(20)}, **{100 + i: f"Own {i}" for i in range(8)}}


def test_template_of_a_part_of_a_large_host(spark):
    """What enough different pages have is template, however many others there are."""
    rows = [(i, f"http://e.example/{i}", f"<div><p>Own {i}</p></div>" + "<div><b>Section</b></div>" * (i < 60)) for i in range(4000)]
    assert all(r["text"] == f"Own {r['page_id']}" for r in extract_main_text(pages(spark, rows)).collect())


def test_edges(spark):
    rows = [(1, None, None), (None, None, ""), (2, "not a url", "<p>a</p>"), (2, "not a url", "<p>a</p>")]
    got = sorted(((r["page_id"], r["text"]) for r in extract_main_text(pages(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, ""), (None, ""), (2, "a"), (2, "a")], key=repr)
    assert extract_main_text(pages(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, "u", "<p>a</p>", "host", 7, "t")], "page_id long, url string, html string, host string, k int, template string")
    assert [tuple(r) for r in extract_main_text(odd).collect()] == [(1, "u", "a")]

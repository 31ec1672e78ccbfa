"""Operators over pages against plain Python and hand-made pages."""

import pytest

from pagemill.llm import html_extract, url_filter

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home comments-open">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies and other means to serve you better on all of these pages.</div><!-- <p>no</p> -->
<main><article><header><h1>Title &amp; more</h1></header><p>One  two\n<b>three</b> <a href=y>four</a> a &lt; b<br>five</p>
<script>var t = "</p><p>no";</script><p>Short.</p><div class="sidebar">Words at the side of the text</div>
<ul><li>item one<li>item two</ul><form>Name <input name=n></form><p style="display: none">hidden</p>
<section id="comments"><p>A reader wrote this and that at some length, and many words more than that.</p></section>
</article></main><aside>x</aside><div class=ad>Buy this now</div><footer>&copy; all</footer></body></html>"""
MAIN = "Title & more\nOne two three four a < b five\nShort.\nitem one\nitem two"


@pytest.fixture(scope="module")
def tree(spark):
    return html_extract.as_nodes(html_extract.train(spark))


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "<p>cut off <b>in the mid"), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = html_extract.extract_main_text(pages, name="url").orderBy("page_id").collect()
    assert [r.url for r in got][:2] == [MAIN, MAIN] and got[2].url == "" and got[3].url == ""
    assert html_extract.extract_main_text(pages.filter("false")).count() == 0


def test_page_without_article(tree):
    long = "This is a paragraph of a page without an article, with words enough to look like text."
    menu = "".join(f"<li><a href=/{i}>Menu {i}</a>" for i in range(5))
    page = f"<ul>{menu}</ul><div><p>{long}<p>Short one.<p>{long}</div><div><a href=/x>Next page</a></div>"
    assert html_extract.main_text(tree, page) == f"{long}\nShort one.\n{long}"


def test_odd_markup_is_read_in_one_pass(tree):
    words = " ".join(f"w{i}" for i in range(30))
    for page in (f"<article>{words} 1 < 2 <3 >", f"<article><p title='a > b'>{words}</p", f"<article>{words}<!-- open", f"<article>{words}<script>x"):
        assert html_extract.main_text(tree, page).startswith(words)
    assert html_extract.main_text(tree, "<div>" * 20_000 + words) == words
    assert html_extract.main_text(tree, "<" * 50_000) is not None


def test_no_text_is_lost_to_attributes_and_open_elements(tree):
    words = " ".join(f"w{i}" for i in range(30))
    more = " ".join(f"m{i}" for i in range(30))
    for attributes in ('href="/hidden-gems.html"', 'title="The hidden river"', 'aria-hidden="false"', 'href="/x?id=comments"', "href=/x?id=comments", 'data-class="ad"'):
        assert html_extract.main_text(tree, f"<article><p>{words} <a {attributes}>link</a></p></article>") == f"{words} link"
        assert html_extract.main_text(tree, f"<article><p {attributes}>{words}</p></article>") == words
    for attributes in ("hidden", 'HIDDEN=""', 'class="x" hidden', "hidden=until-found", "style='display: none'", 'id="comments"', "class=ad"):
        assert html_extract.main_text(tree, f"<article><p>{words}</p><p {attributes}>{more}</p></article>") == words
    for tag in ("svg", "canvas", "object", "audio", "video", "template", "noscript"):
        page = f"<article><p>{words}</p><div><{tag} class=ad>gone</div><p>{more}</p></article>"
        assert html_extract.main_text(tree, page) == f"{words}\n{more}"
        page = f"<article><p>{words} <{tag}><div>gone</div><p>gone</{tag}> {more}</p></article>"
        assert html_extract.main_text(tree, page) == f"{words} {more}"
    assert html_extract.main_text(tree, f"<article><div><svg><title>gone</svg></div><p>{words}</p></article>") == words
    assert html_extract.main_text(tree, f"<article><p>\u0130 {words}</p><SCRIPT>gone</SCRIPT><p>{more}</p></article>") == f"\u0130 {words}\n{more}"
    page = f"<a href=/x><article><p>{words}</p><p><a href=/y>next</a> {more}</p></article>"
    assert html_extract.main_text(tree, page) == f"{words}\nnext {more}"


def test_labelled_blocks_are_learnt(tree):
    hit = [html_extract.judge(tree, row[:-1]) == bool(row[-1]) for row in html_extract.TRAINING]
    assert sum(hit) >= 0.9 * len(hit)


URLS = [
    "http://A.Example.NET/x", "https://example.net/en/1?q#f", "http://notexample.net", "http://a.net/", "http://b.org/fr/x", "http://org/fr/",
    "http://b.org/FR/x", "https://m.example.com/de/1", "http://example.com/d", "http://ü.net/é?x", None, "", "no scheme/net/", "http://", "://net/a",
    "http://x.org?net/", "http://x.org#/fr/", "http://a.example.net/en/", "ftp://u@h:1/p", "a://b://c.net/x",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id int, url string, rule string")
    for r in url_filter.url_verdicts(pages).collect():
        host, path = plain(r.url)
        assert (r.host, r.path) == (host, path)
        fits = []
        for rule, verdict in url_filter.RULES:
            name, _, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=None)
        assert r.rule == (best[1] if best else None) and r.verdict in ("allow", "block")
        if best:
            assert r.verdict == best[2]
    assert url_filter.url_verdicts(pages.filter("false")).count() == 0


def test_trees_follow_the_labels_on_held_out_urls(spark):
    """Rules give labels by suffix; URLs of the same suffixes on other hosts get the same verdicts."""
    rows = [(i, f"http://h{i % 40}.{'net' if i % 2 else 'org/fr'}/{i}") for i in range(400)]
    urls = spark.createDataFrame(rows, "page_id int, url string")
    rules = (("net/", "block"), ("org/fr/", "allow"))
    trees, suffixes, rate = url_filter.train(urls.selectExpr("url AS _url"), rules)
    assert 0 < rate < 1 and suffixes.count() == 2
    held_out = spark.createDataFrame([(1, "http://new.net"), (2, "http://new.org/en/9")], "page_id int, url string")
    judged = url_filter._vectors(url_filter._parsed(held_out.withColumnRenamed("url", "_url"), rules), suffixes, rate)
    assert [r.prediction for r in trees.transform(judged).orderBy("page_id").collect()] == [1.0, 0.0]


def test_urls_without_labels(spark):
    urls = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/x"), (3, None)], "page_id int, url string")
    assert {r.verdict for r in url_filter.url_verdicts(urls).collect()} == {"allow"}


def test_names_that_only_hold_a_mark_lose_nothing(tree):
    words, more = "plain words of the story go on here " * 5, "second part of the same story follows now " * 5
    words, more = words.strip(), more.strip()
    names = ("post no-comments", "social-science", "layout has-sidebar", "comments-open", "related-work", "login-free", "content-with-ad")
    for name in names:
        for page in (
            f'<div class="{name}"><p>{words}</p><p>{more}</p></div>',
            f'<article><div class="{name}"><p>{words}</p><p>{more}</p></div></article>',
            f'<div id="{name}"><article><p>{words}</p><p>{more}</p></article></div>',
        ):
            assert html_extract.main_text(tree, page) == f"{words}\n{more}", page
    article = f"<article><p>{words}</p></article>"
    for name in ("modal", "overlay", "banner-wrapper"):
        assert html_extract.main_text(tree, f'<div class="{name}">{article}</div>') == words
    for name in ("comments", "comment-list", "post-comments", "ad-300x250", "sidebar-left", "cookie-banner", "ad-slot", "adSlot", "related posts", "site-footer", "newsletter"):
        assert html_extract.main_text(tree, f'{article}<div class="{name}"><p>{more}</p></div>') == words
        assert html_extract.main_text(tree, f'<article><p>{words}</p><div id="{name}"><p>{more}</p></div></article>') == words
    assert html_extract.main_text(tree, f'{article}<div class="comments"><article><p>{more}</p></article></div>') == words
    assert html_extract.main_text(tree, f'{article}<article class="comment"><p>{more}</p></article>') == words
    assert html_extract.main_text(tree, f'{article}<div class="related"><article><p>{more}</p></article></div>') == words


def test_formulas_are_text(tree):
    words = "plain words of the story go on here " * 5
    page = f"<article><p>{words}<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>gone</annotation></math> so</p></article>"
    assert html_extract.main_text(tree, page) == f"{words}x=1 so"

import urllib.robotparser

import pytest

from pagemill.operators import robots, sitemaps

BODIES = [
    "User-agent: a\nUser-agent: bot\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nAllow: /p/ok\nDisallow: /p # c\nCrawl-delay: 2\nSitemap: http://h/s.xml\n",
    "Disallow: /z\nUser-agent: *\nDisallow:\n",
    "# only\n\nUser-agent: *\n\nDisallow: /q\nUser-agent: *\n# c\nDisallow: /caf%C3%A9\nDisallow: /a b?x=1\n",
    "User-agent: *\r\nDisallow: /\r\nAllow: /p\r\nUser-agent: foo\r\nCrawl-delay: x\r\nSitemap: http://h/t.xml",
    "",
    "User-agent: *\nDisallow: /tmp?\nDisallow: /*\n\n\nUser-agent: zz\nuser-agent: *\nAllow: /\n",
]
PATHS = ["/x", "/x/y", "/p", "/p/ok/1", "/z", "/q", "/café", "/caf%C3%A9/1", "/a b?x=12", "", "/?p", "/a%20b?x=1#f", "/p;x?y", "/tmp", "/*"]


@pytest.mark.parametrize("few", [0, 1, 100])
@pytest.mark.parametrize("agent", ["*", "Bot/2.0", "foo", "zz"])
def test_can_fetch_equals_the_standard_parser(spark, agent, few):
    cases = []
    for n, body in enumerate(BODIES):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        cases += [(f"http://h{n}{p}", parser.can_fetch(agent, f"http://h{n}{p}")) for p in PATHS]
    cases.append(("http://unknown/x", True))
    files = spark.createDataFrame([(f"h{n}", b) for n, b in enumerate(BODIES)], "host string, body string")
    urls = spark.createDataFrame(cases, "url string, expected boolean")
    assert robots.robots_can_fetch(urls, files, agent, few).filter("allowed <> expected OR allowed IS NULL").collect() == []


def test_long_robots_file(spark):
    body = "User-agent: *\n" + "".join(f"Disallow: /d{n}/\n" for n in range(20_000)) + "Allow: /\n"
    files = spark.createDataFrame([("h", body)], "host string, body string")
    urls = spark.createDataFrame([("http://h/d19999/x",), ("http://h/e",)], "url string")
    assert [r.allowed for r in robots.robots_can_fetch(urls, files).collect()] == [False, True]


def test_directives(spark):
    files = spark.createDataFrame([(f"h{n}", b) for n, b in enumerate(BODIES)], "host string, body string")
    delays = {r.host: r.delay for r in robots.robots_crawl_delay(files).collect()}
    assert delays == {"h0": 2.0, "h1": 0.0, "h2": 0.0, "h3": 0.0, "h4": 0.0, "h5": 0.0}
    assert {r.sitemap_url for r in robots.robots_sitemaps(files).collect()} == {"http://h/s.xml", "http://h/t.xml"}
    assert {r.sitemap_url for r in robots.robots_sitemaps(files, strict=True).collect()} == {"http://h/s.xml"}
    assert ("h1", "/z") in {tuple(r) for r in robots.robots_disallowed_paths(files).collect()}


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


@pytest.fixture
def maps(spark):
    rows = [
        ("http://h/a.xml", f'<?xml version="1.0"?><urlset {NS}><url><loc> http://h/1?a=1&amp;b=2 </loc><priority>0.5</priority></url>'
         "<url><loc>http://h/2</loc><priority>bad</priority><lastmod>2024</lastmod></url><url><lastmod>x</lastmod></url></urlset>"),
        ("http://h/b.xml", "<urlset><url><loc>http://h/3</loc></url></urlset>"),
        ("http://h/i.xml", f"<sitemapindex {NS}><sitemap><loc>http://h/a.xml</loc></sitemap><sitemap><loc>http://h/j.xml</loc></sitemap></sitemapindex>"),
        ("http://h/j.xml", f"<sitemapindex {NS}><sitemap><loc>http://h/i.xml</loc></sitemap><sitemap><loc>http://h/b.xml</loc></sitemap></sitemapindex>"),
        ("http://h/x.xml", "<urlset><url><loc>broken"),
    ]
    return spark.createDataFrame([(u, None, b) for u, b in rows], "url string, content_type string, body string")


def test_sitemaps(spark, maps):
    assert {r.url for r in sitemaps.sitemap_urls(maps).collect()} == {"http://h/1?a=1&b=2", "http://h/2", "http://h/3"}
    entries = sitemaps.sitemap_entries(maps).orderBy("pos").collect()
    assert [(r.url, r.lastmod, r.priority) for r in entries] == [("http://h/1?a=1&b=2", None, 0.5), ("http://h/2", "2024", None)]


def test_index_cycle_ends(spark, maps):
    roots = spark.createDataFrame([("http://h/i.xml",), ("http://h/b.xml",)], "url string")
    got = {tuple(r) for r in sitemaps.expand_sitemaps(maps, roots).collect()}
    assert got == {
        ("http://h/i.xml", "http://h/1?a=1&b=2"), ("http://h/i.xml", "http://h/2"), ("http://h/i.xml", "http://h/3"),
        ("http://h/b.xml", "http://h/3"),
    }


def test_one_policy_per_host(spark):
    """Letter case of hosts and repeated captures do not multiply or change answers."""
    files = [("H", "User-agent: *\nDisallow: /x\nCrawl-delay: 3"), ("h", "User-agent: *\nDisallow: /x\nCrawl-delay: 3"), ("h", "~")]
    frame = spark.createDataFrame(files, "host string, body string")
    urls = spark.createDataFrame([("http://H/x",), ("http://h/y",)], "url string")
    got = {r.url: r.allowed for r in robots.robots_can_fetch(urls, frame).collect()}
    assert got == {"http://H/x": False, "http://h/y": True} and robots.robots_can_fetch(urls, frame).count() == 2
    assert [tuple(r) for r in robots.robots_crawl_delay(frame).collect()] == [("h", 3.0)]


def test_many_rules_of_a_host(spark):
    lines = [f"{'Allow' if n % 7 == 0 else 'Disallow'}: /x{'d' * (n % 5)}/{n % 1700}" for n in range(3000)]
    body = "User-agent: *\n" + "\n".join(lines)
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(body.splitlines())
    paths = [f"/x{'d' * (n % 6)}/{n * 3}" for n in range(600)]
    cases = [(f"http://H/{p[1:]}", parser.can_fetch("*", f"http://H{p}")) for p in paths]
    cases += [cases[0], ("http://other/d/1", True)]
    urls = spark.createDataFrame(cases, "url string, expected boolean")
    files = spark.createDataFrame([("h", body), ("small", "User-agent: *\nDisallow: /")], "host string, body string")
    got = robots.robots_can_fetch(urls, files).collect()
    assert len(got) == len(cases) and {True, False} == {r.allowed for r in got}
    assert [r for r in got if r.allowed != r.expected] == []
    # The rules do not travel with the URLs: a looked-up row has only the path.
    assert got[0].asDict().keys() == {"url", "expected", "allowed"}

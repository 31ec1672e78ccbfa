import random

import pytest

from pagemill.operators import crawl
from pagemill.operators.graph_store import Stored

GRAPH = {"a": "bd", "b": "c", "c": "a", "d": "ez", "e": "b"}


@pytest.fixture
def site(pages):
    return pages(*[(f"http://g/{n}", "".join(f'<a href="/{m}">x</a>' for m in out)) for n, out in GRAPH.items()])


@pytest.fixture
def start(spark):
    return spark.createDataFrame([("http://G/a/#x",)], "url string")


def shown(rows):
    return {r.url[-1]: (r.depth, r.status) for r in rows.collect()}


def test_bfs(site, start):
    rows = crawl.crawl_bfs(site, start)
    assert shown(rows) == {
        "a": (0, "visited"), "b": (1, "visited"), "d": (1, "visited"), "c": (2, "visited"), "e": (2, "visited"), "z": (2, "failed"),
    }
    summary = crawl.crawl_summary(rows).first()
    assert (summary.discovered, summary.visited, summary.failed, summary.max_depth) == (6, 5, 1, 2)


def test_bfs_limits(site, start):
    deep = shown(crawl.crawl_bfs(site, start, max_depth=1))
    assert deep["c"] == (2, "discovered") and deep["b"] == (1, "visited")
    few = shown(crawl.crawl_bfs(site, start, max_urls=2))
    assert few == {"a": (0, "visited"), "b": (1, "visited"), "d": (1, "discovered"), "c": (2, "discovered")}


def test_bfs_robots_and_sitemap(spark, site, start):
    robots = spark.createDataFrame([("g", "User-agent: *\nDisallow: /d")], "host string, body string")
    got = {r.url: (r.depth, r.reason) for r in crawl.crawl_bfs(site, start, robots=robots).collect()}
    assert got["http://g/d"] == (1, "Disallowed by robots.txt") and "http://g/e" not in got
    extra = spark.createDataFrame([("http://g/e",), ("http://g/x.pdf",)], "url string")
    got = {r.url: r.depth for r in crawl.crawl_bfs(site, start, robots=robots, sitemap_urls=extra).collect()}
    assert got["http://g/e"] == 1 and "http://g/x.pdf" not in got
    closed = spark.createDataFrame([("g", "User-agent: *\nDisallow: /")], "host string, body string")
    assert [(r.status, r.reason) for r in crawl.crawl_bfs(site, start, robots=closed).collect()] == [("failed", "Disallowed by robots.txt")]


def test_dfs_order(site, start):
    rows = crawl.crawl_dfs(site, start).orderBy("visit_order").collect()
    assert [r.url[-1] for r in rows] == ["a", "b", "c", "d", "e"]


def test_bfs_equals_plain_search(spark):
    dice = random.Random(2)
    edges = {(dice.randrange(200), dice.randrange(260)) for _ in range(500)}
    name = lambda n: f"http://n/{n}"
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string")
    pages = spark.createDataFrame([(n, name(n), "x") for n in range(200)], "page_id long, url string, html string")
    depth, level = {0: 0}, [0]
    while level:
        found = sorted({b for a, b in edges if a in level and a < 200} - set(depth))
        depth.update({b: depth[level[0]] + 1 for b in found})
        level = found
    start = spark.createDataFrame([(name(0),)], "url string")
    got = {r.url: (r.depth, r.status) for r in crawl.crawl_bfs(pages, start, edges=frame).collect()}
    assert got == {name(n): (d, "visited" if n < 200 else "failed") for n, d in depth.items()}


def test_long_chain(spark):
    name = lambda n: f"http://n/{n}"
    edges = spark.createDataFrame([(name(n), name(n + 1)) for n in range(25)], "src string, dst string")
    pages = spark.createDataFrame([(n, name(n), "x") for n in range(26)], "page_id long, url string, html string")
    start = spark.createDataFrame([(name(0),)], "url string")
    got = {r.url: r.depth for r in crawl.crawl_bfs(pages, start, edges=edges).collect()}
    assert got == {name(n): n for n in range(26)}
    order = crawl.crawl_dfs(pages, start, edges=edges).orderBy("visit_order").collect()
    assert [r.url for r in order] == [name(n) for n in range(26)]


def plain_crawl(edges, captured, start):
    depth, level = {start: 0}, [start]
    while level:
        here = {n for n in level if n in captured}
        found = sorted({b for a, b in edges if a in here} - set(depth))
        depth.update({b: depth[level[0]] + 1 for b in found})
        level = found
    return depth


def test_pages_with_many_links_are_stored_in_several_buckets(spark):
    dice = random.Random(4)
    edges = {(dice.choice([0, 1, 2, dice.randrange(60)]), dice.randrange(80)) for _ in range(400)}
    name = lambda n: f"http://n/{n}"
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string")
    pages = spark.createDataFrame([(n, name(n), "x") for n in range(60)], "page_id long, url string, html string")
    start = spark.createDataFrame([(name(0),)], "url string")
    got = {r.url: r.depth for r in crawl.crawl_bfs(pages, start, edges=frame, most_links=7).collect()}
    assert got == {name(n): d for n, d in plain_crawl(edges, set(range(60)), 0).items()}


def test_a_level_shuffles_no_stored_links(spark):
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}", None) for i in range(50)], "src string, dst string, reason string")
    links = crawl.LinkStore(edges)
    seen = Stored(spark, ["url"], by=["depth"])
    for depth, urls in enumerate([["a0"], ["a1", "a0"]]):
        rows = spark.createDataFrame([(u, None, depth) for u in urls], "url string, reason string, depth int")
        seen.append(rows)
    parts = seen.folders(depth=1)
    level = crawl.new_of(seen, 1, parts)
    found = links.found(level.select(level.url.alias("src")), parts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(dst" in plan.replace("url#", "dst#")
    assert [(r.url, r.parent) for r in found.collect()] == [("a2", "a1")]
    # A level reads the buckets that it wrote to, of what was found before as well.
    assert len(parts) <= 2 and all(f"part={p}" in str(seen.read(parts).inputFiles()) for p in parts)
    assert len(seen.read(parts).inputFiles()) <= 3


def test_preorder_of_a_chain_has_small_rows(spark):
    chain = [(f"{n:05}", f"{n - 1:05}" if n else None) for n in range(2000)]
    rows = crawl.preorder(spark.createDataFrame(chain, "url string, parent string"))
    assert rows.columns == ["url", "visit_order"]
    assert {r.url: r.visit_order for r in rows.collect()} == {url: n for n, (url, _) in enumerate(chain, 1)}


def test_preorder_equals_plain_recursion(spark):
    dice = random.Random(6)
    parent = {n: dice.randrange(n) if n > 2 and dice.random() < 0.95 else None for n in range(150)}
    name = lambda n: f"u{n:03}"
    order, todo = [], sorted((n for n in parent if parent[n] is None), reverse=True)
    while todo:
        n = todo.pop()
        order.append(name(n))
        todo += sorted((c for c in parent if parent[c] == n), reverse=True)
    rows = [(name(n), None if p is None else name(p)) for n, p in parent.items()]
    got = crawl.preorder(spark.createDataFrame(rows, "url string, parent string")).orderBy("visit_order").collect()
    assert [r.url for r in got] == order and [r.visit_order for r in got] == list(range(1, 151))

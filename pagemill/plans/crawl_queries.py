"""Queries on robots files, sitemaps and the crawl of a captured site."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.text import map_json
from pagemill.functions.urls import normalize_url
from pagemill.operators import crawl, links, robots, sitemaps
from pagemill.operators.ordered import first_rows
from pagemill.operators.sitemaps import sitemap_kind
from pagemill.plans.derived import derived, given, with_derived

QUERIES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function

    return register


_LINES = "string_split(body, chr(10))"


@query(
    "src_robots",
    with_derived(
        ["robots"],
        f"""SELECT host, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT host, {_LINES} AS l FROM robots),
        unnest(range(1, len(l) + 1)) AS t(i)""",
    ),
)
def src_robots(spark, sf):
    return robots.robots_lines(derived(spark, sf, "robots"))


# Expected directives of the four kinds of robots files, written down by hand.
_HOST = "'c' || c_custkey || '.example.edu'"
_GROUPS = f"""SELECT {_HOST} AS host, g.* FROM customer, LATERAL (VALUES
    (0, 'badbot', 'user-agent', 'badbot'), (1, 'worsebot', 'user-agent', 'worsebot'), (1, 'worsebot', 'disallow', '/'),
    (1, 'worsebot', 'sitemap', 'http://c' || c_custkey || '.example.edu/other.xml'),
    (2, '*', 'user-agent', '*'), (2, '*', 'allow', '/a/ok # fine'), (2, '*', 'disallow', '/a'),
    (2, '*', 'crawl-delay', '' || c_custkey % 7), (2, '*', 'crawl-delay', 'soon'),
    (2, '*', 'sitemap', 'http://c' || c_custkey || '.example.edu/sitemap.xml')) AS g(group_no, agent, directive, value)
    WHERE c_custkey % 4 = 0
    UNION ALL SELECT {_HOST}, g.* FROM customer, LATERAL (VALUES (1, '*', 'user-agent', '*'),
    (1, '*', 'disallow', ''), (1, '*', 'sitemap', '/relative.xml')) AS g(group_no, agent, directive, value)
    WHERE c_custkey % 4 = 1
    UNION ALL SELECT {_HOST}, g.* FROM customer, LATERAL (VALUES (0, '*', 'user-agent', '*'), (0, '*', 'disallow', '/a'),
    (0, '*', 'allow', '/a/ok'), (0, '*', 'disallow', '/d'), (0, '*', 'crawl-delay', '2.5'))
    AS g(group_no, agent, directive, value) WHERE c_custkey % 4 = 2
    UNION ALL SELECT {_HOST}, g.* FROM customer, LATERAL (VALUES (0, NULL, 'disallow', '/early'), (1, '*', 'user-agent', '*'),
    (1, '*', 'disallow', '/caf%C3%A9'), (1, '*', 'disallow', '/b?x=1'), (1, '*', 'allow', '/b'))
    AS g(group_no, agent, directive, value) WHERE c_custkey % 4 = 3"""


@query("robots_groups", _GROUPS)
def robots_groups(spark, sf):
    return robots.robots_groups(derived(spark, sf, "robots")).drop("pos")


def _captured_twice(files):
    """Every third file again, under its host in capitals and with a later text."""
    again = files.filter(F.length("host") % 3 == 0)
    return files.unionByName(again.select(F.upper("host").alias("host"), F.concat(F.lit("~"), "body").alias("body")))


@query(
    "robots_crawl_delay",
    f"""SELECT {_HOST} AS host, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 7 AS DOUBLE) WHEN 2 THEN 2.5 ELSE 0.0 END AS delay
    FROM customer""".replace("2.5 ELSE 0.0", "CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"),
)
def robots_crawl_delay(spark, sf):
    return robots.robots_crawl_delay(_captured_twice(derived(spark, sf, "robots")))


@query(
    "robots_sitemaps",
    f"""SELECT host, value AS sitemap_url, agent = '*' AS strict FROM ({_GROUPS})
    WHERE directive = 'sitemap' AND value LIKE 'http%'""",
)
def robots_sitemaps(spark, sf):
    files = derived(spark, sf, "robots")
    every = robots.robots_sitemaps(files).select("host", "sitemap_url")
    strict = robots.robots_sitemaps(files, strict=True).select("host", "sitemap_url", F.lit(True).alias("s"))
    return every.join(strict, ["host", "sitemap_url"], "left").select(
        "host", "sitemap_url", F.coalesce("s", F.lit(False)).alias("strict")
    )


def _path_sql(directive: str) -> str:
    return f"""SELECT DISTINCT host, value AS path FROM ({_GROUPS}) WHERE directive = '{directive}' AND value <> ''
    AND (agent IS NULL OR agent IN ('*', 'worsebot'))"""


@query("robots_allowed_paths", _path_sql("allow"))
def robots_allowed_paths(spark, sf):
    return robots.robots_allowed_paths(derived(spark, sf, "robots"), "worsebot")


@query("robots_disallowed_paths", _path_sql("disallow"))
def robots_disallowed_paths(spark, sf):
    return robots.robots_disallowed_paths(derived(spark, sf, "robots"), "worsebot")


# Path kinds by o_orderkey % 6: /a/ok/1, /a/no, /b?x=12, /café/x, /d/N, none.
_ALLOWED = """CASE o_custkey % 4
    WHEN 0 THEN o_orderkey % 6 <> 1
    WHEN 1 THEN true
    WHEN 2 THEN o_orderkey % 6 NOT IN (0, 1)
    ELSE o_orderkey % 6 NOT IN (2, 3) END"""


@query("robots_can_fetch", f"SELECT o_orderkey AS url_id, {_ALLOWED} AS allowed FROM orders")
def robots_can_fetch(spark, sf):
    urls = derived(spark, sf, "robots_urls")
    return robots.robots_can_fetch(urls, _captured_twice(derived(spark, sf, "robots"))).select("url_id", "allowed")


@query(
    "robots_prefix_join",
    f"""SELECT o_custkey % 4 = 0 AS named, count(*) AS urls,
    count(*) FILTER (WHERE CASE WHEN o_custkey % 4 = 0 THEN false ELSE {_ALLOWED} END) AS allowed FROM orders GROUP BY 1""",
)
def robots_prefix_join(spark, sf):
    checked = robots.robots_can_fetch(derived(spark, sf, "robots_urls"), _captured_twice(derived(spark, sf, "robots")), "WorseBot/1.0")
    number = F.regexp_extract("url", r"//[cC]([0-9]+)\.", 1).cast("long")
    return checked.groupBy((number % 4 == 0).alias("named")).agg(
        F.count("*").alias("urls"), F.count_if("allowed").alias("allowed")
    )


@query(
    "sitemap_kind",
    """SELECT url || ending AS url, CASE ending WHEN '.html' THEN 'html' WHEN '.xml.gz' THEN 'xml'
    ELSE CASE WHEN n % 3 = 0 THEN 'html' ELSE 'xml' END END AS kind FROM
    (SELECT 'http://c' || c_custkey || '.example.edu/map' AS url, c_custkey AS n FROM customer),
    (VALUES (''), ('.html'), ('.xml.gz')) AS e(ending)""",
)
def kind(spark, sf):
    endings = F.array(F.lit(""), F.lit(".html"), F.lit(".xml.gz"))
    number = F.regexp_extract("url", r"//[cC]([0-9]+)\.", 1).cast("long")
    rows = derived(spark, sf, "sitemaps").withColumns(
        {
            "body": F.when(number % 3 == 0, F.concat(F.lit("  <!doctype html><HTML>"), "body"))
            .when(number % 3 == 1, F.concat(F.lit(" <?xml "), "body"))
            .otherwise("none"),
            "content_type": F.when(number % 3 == 0, F.lit(None)).otherwise("text/plain"),
            "ending": F.explode(endings),
        }
    )
    rows = rows.withColumn("url", F.concat("url", "ending"))
    return rows.select("url", sitemap_kind(F.col("url"), F.col("content_type"), F.col("body")).alias("kind"))


_MAP = "'http://c' || c_custkey || '.example.edu/map'"
_C = "'http://c' || c_custkey || '.example.edu"


@query(
    "src_sitemap_xml",
    f"""SELECT {_MAP} AS sitemap, {_C}/p?a=1&b=2' AS url FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT {_MAP}, {_C}/q' FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT {_MAP}, {_C}/r' FROM customer WHERE c_custkey % 4 = 1""",
)
def sitemap_xml(spark, sf):
    return sitemaps.sitemap_urls(derived(spark, sf, "sitemaps"))


@query(
    "src_sitemap_meta",
    f"""SELECT {_MAP} AS sitemap, {_C}/p?a=1&b=2' AS url, '2024-01-0' || (1 + c_nationkey % 9) AS lastmod,
    'daily' AS changefreq, CAST(0.5 AS DOUBLE) AS priority FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT {_MAP}, {_C}/q', NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0""",
)
def sitemap_meta(spark, sf):
    return sitemaps.sitemap_entries(derived(spark, sf, "sitemaps")).drop("pos")


_CHILDREN = """children AS (SELECT c_custkey AS k, unnest([c_custkey + 1, c_custkey - 2, c_custkey - 1]) AS child
    FROM customer WHERE c_custkey % 4 = 2
    UNION ALL SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 4 = 3)"""


@query(
    "src_sitemap_index",
    f"""WITH RECURSIVE {_CHILDREN}, reach(root, k) AS (
    SELECT c_custkey, c_custkey FROM customer UNION SELECT root, child FROM reach JOIN children USING (k)),
    pages_of AS (SELECT c_custkey AS k, unnest(CASE c_custkey % 4 WHEN 0 THEN ['p?a=1&b=2', 'q'] ELSE ['r'] END) AS path
    FROM customer WHERE c_custkey % 4 < 2)
    SELECT DISTINCT 'http://c' || root || '.example.edu/map' AS root, 'http://c' || k || '.example.edu/' || path AS url
    FROM reach JOIN pages_of USING (k)""",
)
def sitemap_index(spark, sf):
    maps = derived(spark, sf, "sitemaps")
    return sitemaps.expand_sitemaps(maps, maps.select("url"))


@query(
    "sitemap_candidates",
    """SELECT 'https://c' || c_custkey || '.example.edu/home?x=1' AS url, CASE c_custkey % 3 WHEN 0 THEN 0 ELSE 5 END AS place,
    'https://c' || c_custkey || '.example.edu' || CASE c_custkey % 3 WHEN 0 THEN '/sitemap.xml' ELSE '/sitemap/' END AS sitemap_url
    FROM customer WHERE c_custkey % 3 < 2""",
)
def sitemap_candidates(spark, sf):
    return sitemaps.sitemap_candidates(derived(spark, sf, "secure_sites"), derived(spark, sf, "captured_maps"))


# The captured site: order n links to 2n+1, 2n+2, n/2, (31n+17) % 1000 and a closed part.
SITE = "'http://shop.example.com/o/'"
EDGES = """edges AS (SELECT o_orderkey AS k, unnest([o_orderkey * 2 + 1, o_orderkey * 2 + 2,
    CAST(floor(o_orderkey / 2) AS BIGINT), (o_orderkey * 31 + 17) % 1000]) AS t FROM orders),
    last AS (SELECT max(o_orderkey) AS m FROM orders)"""
# No page of the site is deeper than the longest chain of left links, 2 ** n.
FULL, DEPTH = 24, 6


def reach(depth: int) -> str:
    return f"""{EDGES}, reach(k, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT t, d + 1 FROM reach JOIN edges USING (k) WHERE d <= {depth}),
    best AS (SELECT k, min(d) AS depth FROM reach GROUP BY k),
    closed AS (SELECT k % 3 AS p, min(depth) + 1 AS depth FROM best WHERE k <= (SELECT m FROM last) AND depth <= {depth} GROUP BY 1)"""




def _site(spark, sf):
    return derived(spark, sf, "site_pages")


def _start(spark, sf):
    first = _site(spark, sf).filter(F.col("page_id") == 0)
    return first.select(F.concat(F.upper("url"), F.lit("/")).alias("url"))


def _closed(spark, sf):
    """Robots file of the site: the staff part is closed."""
    return _start(spark, sf).select(
        F.lit("shop.example.com").alias("host"), F.lit("User-agent: *\nDisallow: /private/").alias("body")
    )


def crawled(depth: int) -> str:
    return f"""SELECT {SITE} || k AS url, depth, CASE WHEN depth > {depth} THEN 'discovered' WHEN k <= (SELECT m FROM last)
    THEN 'visited' ELSE 'failed' END AS status, CASE WHEN depth <= {depth} AND k > (SELECT m FROM last)
    THEN 'Failed to fetch' END AS reason FROM best
    UNION ALL SELECT 'http://shop.example.com/private/' || p, depth, CASE WHEN depth > {depth} THEN 'discovered' ELSE 'failed' END,
    CASE WHEN depth <= {depth} THEN 'Disallowed by robots.txt' END FROM closed"""


def _crawl(spark, sf, **limits):
    return crawl.crawl_bfs(_site(spark, sf), _start(spark, sf), robots=_closed(spark, sf), **limits)


@query("crawl_bfs", f"WITH RECURSIVE {reach(FULL)} {crawled(FULL)}")
def crawl_bfs(spark, sf):
    return _crawl(spark, sf)


@query("crawl_depth_limit", f"WITH RECURSIVE {reach(DEPTH)} {crawled(DEPTH)}")
def crawl_depth_limit(spark, sf):
    """The limit is the feature."""
    return _crawl(spark, sf, max_depth=DEPTH)


@query(
    "crawl_url_filter",
    f"""WITH RECURSIVE {EDGES}, reach(k, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT t, d + 1 FROM reach JOIN edges USING (k)
    WHERE t % 2 = 1 AND d <= {FULL}) SELECT {SITE} || k AS url, min(d) AS depth FROM reach WHERE k <= (SELECT m FROM last) GROUP BY k""",
)
def crawl_url_filter(spark, sf):
    """Only links to odd orders are followed."""
    rows = _crawl(spark, sf, url_filter=lambda url: url.rlike("/o/[0-9]*[13579]$"))
    return rows.filter("status = 'visited'").select("url", "depth")


@query(
    "crawl_summary",
    f"""WITH RECURSIVE {reach(FULL)}, crawl AS ({crawled(FULL)}) SELECT count(*) AS discovered, count(*) FILTER (status = 'visited') AS visited,
    count(*) FILTER (status = 'failed') AS failed, max(depth) FILTER (status <> 'discovered') AS max_depth,
    count(*) FILTER (status = 'visited') / count(*) FILTER (status <> 'discovered') AS success_rate FROM crawl""",
)
def crawl_summary(spark, sf):
    return crawl.crawl_summary(_crawl(spark, sf))


LIMIT = 100


@query(
    "max_urls_limit",
    f"""WITH RECURSIVE {reach(DEPTH)}, crawl AS ({crawled(DEPTH)}) SELECT url, depth FROM crawl WHERE status = 'visited'
    ORDER BY depth, url LIMIT {LIMIT}""",
)
def max_urls_limit(spark, sf):
    rows = _crawl(spark, sf, max_urls=LIMIT)
    return rows.filter("status = 'visited'").select("url", "depth")


@query(
    "first_rows",
    f"SELECT url FROM pages ORDER BY url, page_id LIMIT {LIMIT}",
)
def first(spark, sf):
    return first_rows(given(spark, sf, "pages").select("url", "page_id"), ["url", "page_id"], LIMIT).select("url")


@query(
    "crawl_dfs",
    f"""WITH RECURSIVE {EDGES}, inside AS (SELECT k, t FROM edges WHERE t <= (SELECT m FROM last)),
    reach(k, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT t, d + 1 FROM reach JOIN inside USING (k) WHERE d < 16),
    best AS (SELECT k, min(d) AS depth FROM reach GROUP BY k),
    parent AS (SELECT b.k, b.depth, arg_min(p.k, {SITE} || p.k) AS up FROM best b JOIN inside e ON e.t = b.k
    JOIN best p ON p.k = e.k AND p.depth = b.depth - 1 GROUP BY ALL),
    tree(k, depth, path) AS (SELECT CAST(0 AS BIGINT), 0, [{SITE} || 0]
    UNION ALL SELECT p.k, p.depth, list_append(t.path, {SITE} || p.k) FROM parent p JOIN tree t ON t.k = p.up)
    SELECT {SITE} || k AS url, depth, row_number() OVER (ORDER BY path) AS visit_order FROM tree""",
)
def crawl_dfs(spark, sf):
    return crawl.crawl_dfs(_site(spark, sf), _start(spark, sf))


@query(
    "crawl_frontier_join",
    f"""SELECT DISTINCT {SITE} || t AS url FROM (WITH {EDGES} SELECT t FROM edges WHERE k % 5 = 0)
    UNION SELECT 'http://shop.example.com/private/' || (o_orderkey % 3) FROM orders WHERE o_orderkey % 5 = 0""",
)
def frontier_join(spark, sf):
    site = _site(spark, sf)
    frontier = site.filter("page_id % 5 = 0").select(normalize_url(F.col("url")).alias("url"))
    return crawl.crawl_frontier_join(frontier, links.extract_edges(site))


@query(
    "visited_anti",
    f"""WITH {EDGES} SELECT DISTINCT {SITE} || t AS url FROM edges WHERE t > (SELECT m FROM last)
    UNION SELECT DISTINCT 'http://shop.example.com/private/' || (o_orderkey % 3) FROM orders""",
)
def visited_anti(spark, sf):
    site = _site(spark, sf)
    found = links.extract_edges(site).select(F.col("dst").alias("url")).distinct()
    return links.visited_anti(found, crawl.page_keys(site))


@query(
    "crawl_and_extract",
    f"""WITH RECURSIVE {reach(FULL)} SELECT k AS page_id, {SITE} || k AS url, depth, 'Order ' || k AS title,
    '{{"keywords":"o' || k || '"}}' AS meta, 'en' AS language FROM best
    WHERE depth <= {FULL} AND k <= (SELECT m FROM last)""",
)
def crawl_and_extract(spark, sf):
    rows = crawl.crawl_and_extract(_site(spark, sf), _crawl(spark, sf))
    return rows.select(
        "page_id", "url", "depth", "title", map_json(F.col("meta")).alias("meta"), "language"
    )


# A second graph: suppliers and parts of line items.
@query(
    "graph_reach",
    """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
    g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(v, d) AS (SELECT 's0', 0 UNION SELECT b, d + 1 FROM r JOIN g ON a = v WHERE d < 10)
    SELECT 'http://' || v || '.example/' AS url, min(d) AS depth FROM r GROUP BY v""",
)
def graph_reach(spark, sf):
    """Depths of suppliers and parts joined by line items, as a crawl."""
    items = given(spark, sf, "lineitem")
    a = F.concat(F.lit("http://s"), F.col("l_suppkey"), F.lit(".example/"))
    b = F.concat(F.lit("http://p"), F.col("l_partkey"), F.lit(".example/"))
    pairs = items.select(a.alias("src"), b.alias("dst")).distinct()
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = edges.select(F.col("src").alias("url")).distinct()
    pages = nodes.select(F.xxhash64("url").alias("page_id"), "url", F.lit("x").alias("html"))
    start = given(spark, sf, "supplier").filter("s_suppkey = 0").select(F.lit("http://s0.example/").alias("url"))
    return crawl.crawl_bfs(pages, start, edges=edges).select("url", "depth")

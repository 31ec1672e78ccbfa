"""Crawl of a captured link graph, level by level.

Links and what was found are stored by URL (``graph_store``). A level is one job: what the last one found, less what
was found before, is read in the buckets that the last one wrote to; its links are read where they lie; only the
links found move, to the buckets of their targets. The driver learns which buckets a level has. A page with very many
links is stored in several buckets; a URL with very many mentions is combined before it moves."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import is_crawlable_url, normalize_url
from pagemill.operators.graph_store import Stored
from pagemill.operators.links import extract_edges, in_domains
from pagemill.operators.ordered import BLOCK, ordered_blocks, running_over
from pagemill.operators.pages import extract_metadata, usable_pages
from pagemill.operators.robots import robots_can_fetch
from pagemill.session import cut

REFUSED = "Disallowed by robots.txt"
MISSING = "Failed to fetch"


def page_keys(pages: DataFrame, content_type: str | None = None) -> DataFrame:
    """(url): normalised URLs that have a usable page."""
    return usable_pages(pages, content_type).select(normalize_url(F.col("url")).alias("url")).distinct()


def crawl_frontier_join(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(url): distinct links of the pages in ``frontier(url)``."""
    return edges.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()


def _outcomes(urls: DataFrame, known_pages: DataFrame, robots: DataFrame | None) -> DataFrame:
    """(url, reason): why a visit of each URL would fail; NULL when it would succeed."""
    checked = robots_can_fetch(urls, robots) if robots is not None else urls.withColumn("allowed", F.lit(True))
    present = known_pages.withColumn("_page", F.lit(True))
    return checked.join(present, "url", "left").select(
        "url",
        F.when(~F.col("allowed"), REFUSED).when(F.col("_page").isNull(), MISSING).alias("reason"),
    )


#: Links of a page that lie in one bucket at most; more are spread over several.
MOST_LINKS = 100_000


class LinkStore:
    """``links(src, dst, reason)`` stored by ``src``. A page with more than ``MOST_LINKS`` links is stored under
    several numbers, and is looked up under all of them."""

    def __init__(self, links: DataFrame, most_links: int = MOST_LINKS):
        counts = links.groupBy("src").agg(F.count("*").alias("_n")).filter(F.col("_n") > most_links)
        large = counts.select("src", F.ceil(F.col("_n") / most_links).cast("int").alias("_fans"))
        self.large = None if large.isEmpty() else cut(large)
        self.keys = ["src"] if self.large is None else ["src", "_fan"]
        if self.large is not None:
            fan = F.pmod(F.hash("dst"), F.coalesce("_fans", F.lit(1)))
            links = links.join(self.large, "src", "left").withColumn("_fan", fan).drop("_fans")
        self.table = Stored(links.sparkSession, self.keys)
        self.table.append(links.repartition(self.table.buckets, *self.keys))

    def found(self, pages: DataFrame, parts: Sequence[int]) -> DataFrame:
        """(url, reason, parent): what ``pages(src)``, which lie in these buckets, link to; the parent is the first
        page in URL order that does. The links are not shuffled before they are combined."""
        if self.large is not None:
            fans = F.sequence(F.lit(0), F.coalesce("_fans", F.lit(1)) - 1)
            pages = pages.join(self.large, "src", "left").select("src", F.explode(fans).alias("_fan"))
            parts = None
        links = self.table.read(parts).select(*self.keys, "dst", "reason")
        met = links.join(pages.hint("shuffle_hash"), self.keys)
        return met.groupBy(F.col("dst").alias("url")).agg(F.first("reason").alias("reason"), F.min("src").alias("parent"))


def crawl_bfs(
    pages: DataFrame,
    start: DataFrame,
    robots: DataFrame | None = None,
    sitemap_urls: DataFrame | None = None,
    max_depth: int = -1,
    max_urls: int = -1,
    allowed_domains: Sequence[str] | DataFrame | None = None,
    edges: DataFrame | None = None,
    url_filter: Callable[[Column], Column] | None = None,
    content_type: str | None = None,
    most_links: int = MOST_LINKS,
) -> DataFrame:
    """(url, depth, status, reason): breadth first from ``start(url)`` over captured pages.

    ``visited`` pages were found and read, ``failed`` ones refused by robots or not
    captured, ``discovered`` ones lie past ``max_depth`` or came after ``max_urls``
    visits, counted in (depth, url) order. ``url_filter`` is a test of link URLs; those that
    fail it are not followed. ``content_type`` names the column that tells which pages are
    HTML (see ``usable_pages``). Sitemap URLs enter at depth 1 as written. A
    start that robots refuse ends with that failure alone.

    Whether a visit succeeds does not depend on the way to the URL, so it is decided for
    all URLs at once before the first level."""
    edges = edges if edges is not None else extract_edges(pages, allowed_domains)
    edges = cut(edges.filter(url_filter(F.col("dst"))) if url_filter else edges)
    first = start.select(normalize_url(F.col("url")).alias("url")).distinct()
    targets = edges.select(F.col("dst").alias("url")).unionByName(first)
    extra = None
    if sitemap_urls is not None:
        listed = isinstance(allowed_domains, DataFrame)
        extra = sitemap_urls.select("url").filter(is_crawlable_url(F.col("url"), None if listed else allowed_domains)).distinct()
        extra = in_domains(extra, allowed_domains) if listed else extra
        targets = targets.unionByName(extra)
    nodes = cut(_outcomes(targets.distinct(), page_keys(pages, content_type), robots))
    links = LinkStore(edges.join(nodes.withColumnRenamed("url", "dst"), "dst"), most_links)
    first = cut(first.join(nodes, "url"))
    if extra is not None:
        # Sitemaps are read only if robots allow some start.
        refused = first.filter(F.col("reason").isNull() | (F.col("reason") != REFUSED)).isEmpty()
        extra = None if refused else extra.join(nodes, "url")
    return _crawled(first, links, extra, max_depth, max_urls).select("url", "depth", "status", "reason")


def _crawled(
    first: DataFrame, links: LinkStore, extra: DataFrame | None = None, max_depth: int = -1, max_urls: int = -1
) -> DataFrame:
    """(url, parent, status, reason, depth): the levels from ``first(url, reason)`` on.

    Each level's finds are stored, also those found before; the least depth of a URL is its level."""
    null = F.lit(None).cast("string")
    seen = Stored(first.sparkSession, ["url"], by=["depth"])
    seen.append(first.select("url", "reason", null.alias("parent"), F.lit(0).alias("depth")))
    depth, visits, last, cuts = 0, 0, None, []
    try:
        while parts := seen.folders(depth=depth):
            ended = (max_depth >= 0 and depth > max_depth) or (0 < max_urls <= visits)
            if ended:
                last = depth
                break
            level = new_of(seen, depth, parts)
            if max_urls > 0:
                level = cut(_before_limit(level, max_urls - visits))
                cuts.append(level.filter(~F.col("_in")).select("url"))
                level = level.filter("_in")
                visits += level.filter("reason IS NULL").count()
            rows = links.found(level.filter("reason IS NULL").select(F.col("url").alias("src")), parts)
            if depth == 0 and extra is not None:
                rows = rows.unionByName(extra.select("url", "reason", null.alias("parent")))
                rows = rows.groupBy("url").agg(F.first("reason").alias("reason"), F.min("parent").alias("parent"))
            depth += 1
            seen.append(rows.withColumn("depth", F.lit(depth)))
        once = seen.read().groupBy("url").agg(F.min_by(F.struct("depth", "reason", "parent"), "depth").alias("f"))
        status = F.when(F.lit(last).isNotNull() & (F.col("depth") >= F.lit(last)), "discovered")
        if cuts:
            # Limits on visits are small, and so is what lies past one in the level that reaches it.
            past = reduce(DataFrame.unionByName, cuts).withColumn("_past", F.lit(True))
            once = once.join(past, "url", "left")
            status = status.when(F.col("_past"), "discovered")
        status = status.when(F.col("reason").isNull(), "visited").otherwise("failed")
        told = once.select("url", "f.*", *[c for c in once.columns if c == "_past"]).withColumn("status", status)
        # Without a shuffle: the table is stored by URL.
        return cut(told.withColumn("reason", F.when(F.col("status") != "discovered", F.col("reason"))).drop("_past"))
    finally:
        seen.drop()
        links.table.drop()


def new_of(seen: Stored, depth: int, parts: Sequence[int]) -> DataFrame:
    """(url, reason): what was found at a depth and not before, from the buckets that the depth wrote to."""
    rows = seen.read(parts)
    found = rows.filter(F.col("depth") == depth).select("url", "reason")
    return found.join(rows.filter(F.col("depth") < depth).select("url"), "url", "left_anti") if depth else found


def _before_limit(rows: DataFrame, room: int) -> DataFrame:
    """Mark rows handled before the visit limit is reached, in URL order."""
    blocks = ordered_blocks(rows, [], ["url"])
    visit = F.col("reason").isNull().cast("long")
    counted = running_over(blocks, [], ["url"], {"_n": ("sum", visit)}).drop(BLOCK)
    return counted.withColumn("_in", F.col("_n") - F.col("reason").isNull().cast("long") < room).drop("_n")


def crawl_dfs(pages: DataFrame, start: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(url, depth, visit_order): every captured page reachable from the start, in the
    preorder of the discovery tree. The parent of a page is its smallest neighbour one
    level up, siblings go in URL order. Without caps the visited set is reachability, so
    no depth is cut."""
    edges = edges if edges is not None else extract_edges(pages)
    known_pages = cut(page_keys(pages))
    null = F.lit(None).cast("string")
    inside = edges.join(known_pages.withColumnRenamed("url", "dst"), "dst", "left_semi").withColumn("reason", null)
    first = start.select(normalize_url(F.col("url")).alias("url")).distinct().join(known_pages, "url", "left_semi")
    tree = _crawled(first.withColumn("reason", null), LinkStore(inside))
    ordered = preorder(tree.select("url", "parent"))
    return tree.select("url", "depth").join(ordered, "url")


def preorder(tree: DataFrame) -> DataFrame:
    """(url, visit_order) of ``tree(url, parent)``, from 1: a page comes before its children, siblings and roots in
    URL order.

    Rows stay small at any depth. A page's subtree is counted by doubling: its pages less than 2 ** k steps down,
    and those of the pages 2 ** k steps down, are its pages less than 2 ** (k + 1) steps down. What precedes a page
    below its parent, the page itself included, is then summed up along its ancestors the same way."""
    rows = cut(tree.select("url", "parent", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size")))

    def hops(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.select(F.col("url").alias("jump"), F.col("jump").alias("_next"), *more)

    while not rows.filter("jump IS NOT NULL").isEmpty():
        below = rows.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("url")).agg(F.sum("size").alias("_below"))
        rows = cut(
            rows.join(below, "url", "left")
            .join(hops(rows), "jump", "left")
            .select("url", "parent", F.col("_next").alias("jump"), (F.col("size") + F.coalesce("_below", F.lit(0))).alias("size"))
        )
    blocks = ordered_blocks(rows.drop("jump"), ["parent"], ["url"])
    upto = running_over(blocks, ["parent"], ["url"], {"_upto": ("sum", F.col("size"))})
    rows = cut(upto.select("url", F.col("parent").alias("jump"), (F.col("_upto") - F.col("size") + 1).alias("visit_order")))
    while not rows.filter("jump IS NOT NULL").isEmpty():
        above = hops(rows, F.col("visit_order").alias("_above"))
        place = F.col("visit_order") + F.coalesce("_above", F.lit(0))
        rows = cut(rows.join(above, "jump", "left").select("url", F.col("_next").alias("jump"), place.alias("visit_order")))
    return rows.select("url", "visit_order")


def crawl_summary(crawl: DataFrame) -> DataFrame:
    """One row: URLs discovered, visited and failed, depth reached, share of successes."""
    counts = crawl.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("status") == "visited").alias("visited"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.max(F.when(F.col("status") != "discovered", F.col("depth"))), F.lit(0)).alias("max_depth"),
    )
    tried = F.col("visited") + F.col("failed")
    return counts.withColumn("success_rate", F.when(tried > 0, F.col("visited") / tried).otherwise(0.0))


def crawl_and_extract(pages: DataFrame, crawl: DataFrame) -> DataFrame:
    """Metadata of every visited page with its depth, which travels with the page."""
    visited = crawl.filter(F.col("status") == "visited").select(F.col("url").alias("_u"), "depth")
    kept = pages.withColumn("_u", normalize_url(F.col("url"))).join(visited, "_u")
    return extract_metadata(kept, keep=["depth"])


def filter_urls(urls: DataFrame, pattern: str, column: str = "url") -> DataFrame:
    """URLs in which the pattern is found."""
    return urls.filter(F.col(column).rlike(pattern))

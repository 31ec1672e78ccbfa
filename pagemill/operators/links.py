"""Links and edges: element rows from one scan of ``pages``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.html import ANCHOR, attr, element_text, find_all, has_attr, inner, void_pattern, without_code
from pagemill.functions.text import strip, strip_markup
from pagemill.functions.urls import (
    crawlable_targets,
    host_of,
    is_crawlable_url,
    is_navigation_url,
    normalize_url,
    resolve_url,
)
from pagemill.session import cut


def keep_rows(rows: DataFrame, test) -> DataFrame:
    """Rows that pass ``test``, a function of the row as a struct. A plain filter would be
    pushed below the projection and work out its costly columns a second time; so would the size
    test that the planner infers for ``inline``, but not for its outer form."""
    row = F.struct(*rows.columns, F.lit(True).alias("_kept"))
    return rows.select(F.inline_outer(F.filter(F.array(row), test))).filter("_kept").drop("_kept")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, base, pos, element): one row per ``a`` element with an href."""
    staged = pages.select("page_id", "url", without_code(F.col("html")).alias("_doc"))
    base = attr(F.regexp_extract("_doc", void_pattern("base"), 0), "href")
    return staged.select(
        "page_id", "url", base.alias("base"), F.posexplode_outer(find_all(F.col("_doc"), ANCHOR)).alias("pos", "element")
    ).filter(F.col("pos").isNotNull() & has_attr(F.col("element"), "href"))


def extract_links(pages: DataFrame, use_base: bool = True) -> DataFrame:
    """(page_id, url, pos, href, text, link_url, title, download, css_class, has_text). ``has_text`` also
    counts white space. ``use_base`` resolves
    against the ``base`` element of the page when there is one."""
    el = F.col("element")
    rows = anchors(pages).select(
        "page_id",
        "url",
        "base",
        "pos",
        F.coalesce(attr(el, "href"), F.lit("")).alias("href"),
        element_text(el).alias("text"),
        F.coalesce(attr(el, "title"), F.lit("")).alias("title"),
        F.when(has_attr(el, "download"), F.coalesce(attr(el, "download"), F.lit(""))).alias("download"),
        F.coalesce(attr(el, "class"), F.lit("")).alias("css_class"),
        (strip_markup(inner(el)) != "").alias("has_text"),
    )
    target = strip(F.col("href"))
    if use_base:
        target = F.when(F.col("base").isNotNull(), resolve_url(F.col("base"), target)).otherwise(target)
    return rows.withColumn("link_url", resolve_url(F.col("url"), target)).drop("base")


def followed_hrefs(doc: Column) -> Column:
    """Distinct hrefs of ``a`` elements, and of ``link`` elements whose rel is alternate
    or canonical."""
    tags = F.filter(
        find_all(doc, void_pattern("link")), lambda t: attr(t, "rel").rlike("^(?:alternate|canonical)$")
    )
    hrefs = F.transform(F.concat(find_all(doc, ANCHOR), tags), lambda e: attr(e, "href"))
    return F.filter(F.array_distinct(hrefs), lambda h: h != "")


def extract_edges(
    pages: DataFrame, allowed_domains: Sequence[str] | DataFrame | None = None, url_filter=None, strict: bool = False
) -> DataFrame:
    """(src, dst): normalised page URL to normalised crawlable link, each pair of a page
    once. Pairs are made unique inside the page row, so nothing is shuffled. A table of allowed domains
    (``domain``) may have any number of rows; its hosts are joined."""
    if isinstance(allowed_domains, DataFrame):
        return in_domains(extract_edges(pages, None, url_filter, strict), allowed_domains, "dst")
    staged = pages.select("url", without_code(F.col("html")).alias("_doc"))
    staged = staged.select("url", followed_hrefs(F.col("_doc")).alias("_hrefs"))
    found = crawlable_targets(F.col("url"), F.col("_hrefs"), allowed_domains, url_filter, strict)
    # The outer form infers no filter on the array, which would find all links again at the scan.
    pairs = staged.select(normalize_url(F.col("url")).alias("src"), F.explode_outer(found).alias("dst"))
    return pairs.filter("dst IS NOT NULL")


#: Hosts that meet one ending in one place at most; an ending that more of them have is looked up where they lie.
MOST_HOSTS = 100_000


def in_domains(rows: DataFrame, domains: DataFrame, column: str = "url", most_hosts: int = MOST_HOSTS) -> DataFrame:
    """Rows whose URL lies in one of ``domains(domain)`` or below it: ``is_crawlable_url`` for lists of any length.

    Each distinct host is cut at its dots, and the endings are looked up in the list; hosts then meet the rows, so
    neither the list nor the rows are multiplied. Endings such as ``com``, which very many hosts have, are few: they
    are looked up first, and the hosts that have them do not meet in one task. A URL without a host is in no domain; a
    null or empty domain names none."""
    listed = domains.select(F.ltrim(F.col("domain"), F.lit(".")).alias("_ending")).filter("_ending <> ''").distinct()
    keyed = rows.withColumn("_netloc", F.lower(host_of(F.col(column))))
    hosts = cut(keyed.select("_netloc").filter("_netloc <> ''").distinct())
    labels = F.split("_netloc", r"\.")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    pairs = hosts.select("_netloc", F.explode(endings).alias("_ending"))
    common = cut(pairs.groupBy("_ending").agg(F.count("*").alias("_n")).filter(F.col("_n") > most_hosts).select("_ending"))
    found = pairs.join(common, "_ending", "left_anti").join(listed, "_ending", "left_semi")
    found = found.unionByName(pairs.join(cut(common.join(listed, "_ending", "left_semi")), "_ending", "left_semi"))
    return keyed.join(found.select("_netloc").distinct(), "_netloc", "left_semi").select(*rows.columns)


def sitemap_html(pages: DataFrame) -> DataFrame:
    """(page_id, link_url): distinct links of HTML sitemaps that are not navigation."""
    links = extract_links(pages, use_base=False).select("page_id", "href", "link_url")
    kept = keep_rows(links, lambda l: (l["href"] != "") & ~is_navigation_url(l["link_url"]))
    return kept.select("page_id", "link_url").distinct()


def urls_union(*urls: DataFrame) -> DataFrame:
    """Distinct URLs of several one-column frames."""
    out = urls[0].toDF("url")
    for more in urls[1:]:
        out = out.unionByName(more.toDF("url"))
    return out.distinct()


def visited_anti(found: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``found`` whose key is not in ``known``."""
    return found.join(known.select(key), key, "left_anti")


def should_crawl(found: DataFrame, visited: DataFrame, failed: DataFrame, **limits) -> DataFrame:
    """Crawlable URLs that were neither visited nor failed."""
    open_urls = found.withColumn("url", normalize_url(F.col("url"))).distinct()
    open_urls = open_urls.filter(is_crawlable_url(F.col("url"), **limits))
    return visited_anti(visited_anti(open_urls, visited), failed)

"""Sitemaps as rows: ``sitemaps(url, content_type, body)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.functions.urls import resolve_url, url_parts
from pagemill.session import cut, gather

# The sitemap namespace and the places a site may keep its sitemap.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
LOCATIONS = [
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemap.xml.gz",
    "/sitemap.html",
    "/sitemap.htm",
    "/sitemap/",
    "/sitemaps.xml",
    "/sitemap/sitemap.xml",
    "/sitemap_index.xml.gz",
]

_ENTRY = "ARRAY<STRUCT<loc: STRING, lastmod: STRING, changefreq: STRING, priority: STRING>>"


def sitemap_kind(url: Column, content_type: Column, body: Column) -> Column:
    """How to read a sitemap: ``xml`` or ``html``. The URL's ending decides, then the
    content type or the start of the body; unknown bodies are tried as XML first."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(url.endswith(".xml") | url.endswith(".xml.gz"), "xml")
        .when(url.endswith(".html") | url.endswith(".htm"), "html")
        .when(F.contains(kind, F.lit("xml")) | strip(body).startswith("<?xml"), "xml")
        .when(
            F.contains(kind, F.lit("html"))
            | F.contains(F.lower(F.substring(body, 1, 1000)), F.lit("<html")),
            "html",
        )
        .otherwise("xml")
    )


def _parsed(sitemaps: DataFrame) -> DataFrame:
    schema = f"url {_ENTRY}, sitemap {_ENTRY}"
    root = F.regexp_extract("body", r"(?s)<(?![?!])([^\s>/]+)[^>]*>", 0)
    read = F.from_xml("body", schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return sitemaps.withColumns({"_root": root, "_x": read})


def _namespaced() -> Column:
    return F.contains(F.col("_root"), F.lit(NAMESPACE))


def _is_index() -> Column:
    return F.contains(F.regexp_extract("_root", r"<([^\s>/]+)", 1), F.lit("sitemapindex"))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, url): distinct page URLs of XML sitemaps, with or without namespace."""
    plain = ~F.contains(F.col("_root"), F.lit("xmlns"))
    rows = _parsed(sitemaps).filter(~_is_index() & (_namespaced() | plain))
    locs = F.array_distinct(
        F.filter(F.transform("_x.url", lambda e: strip(e["loc"])), lambda l: l.isNotNull() & (l != ""))
    )
    return rows.select(F.col("url").alias("sitemap"), F.explode(locs).alias("url"))


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, pos, url, lastmod, changefreq, priority) of namespaced sitemaps. An entry
    without location is dropped, a priority that is no number is NULL."""
    rows = _parsed(sitemaps).filter(~_is_index() & _namespaced())

    def text(c: Column) -> Column:
        return F.when(c != "", strip(c))

    return (
        rows.select(F.col("url").alias("sitemap"), F.posexplode_outer("_x.url").alias("pos", "e"))
        .filter(F.col("e.loc").isNotNull() & (F.col("e.loc") != ""))
        .select(
            "sitemap",
            "pos",
            strip(F.col("e.loc")).alias("url"),
            text(F.col("e.lastmod")).alias("lastmod"),
            text(F.col("e.changefreq")).alias("changefreq"),
            strip(F.col("e.priority")).try_cast("double").alias("priority"),
        )
    )


def sitemap_children(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, child): sitemaps named by namespaced index files."""
    rows = _parsed(sitemaps).filter(_is_index() & _namespaced())
    locs = F.array_distinct(
        F.filter(F.transform("_x.sitemap", lambda e: strip(e["loc"])), lambda l: l.isNotNull() & (l != ""))
    )
    return rows.select(F.col("url").alias("sitemap"), F.explode(locs).alias("child"))


def expand_sitemaps(sitemaps: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, url): page URLs reached from each root sitemap through index files; a
    sitemap is read once per root, so cycles end. One step per level of nesting."""
    children = cut(sitemap_children(sitemaps))
    level = cut(roots.select(F.col("url").alias("root"), F.col("url").alias("sitemap")).distinct())
    seen = [level]
    while not level.isEmpty():
        found = level.join(children, "sitemap").select("root", F.col("child").alias("sitemap")).distinct()
        known = reduce(DataFrame.unionByName, seen)
        level = cut(found.join(known, ["root", "sitemap"], "left_anti"))
        seen = gather(seen, level)
    reached = reduce(DataFrame.unionByName, seen)
    return reached.join(sitemap_urls(sitemaps), "sitemap").select("root", "url").distinct()


def sitemap_candidates(hosts: DataFrame, captured: DataFrame) -> DataFrame:
    """(url, place, sitemap_url): well-known sitemap locations of each site that exist
    in the capture. Locations are made inside the site row."""
    root = F.concat(url_parts(F.col("url"))["scheme"], F.lit("://"), url_parts(F.col("url"))["netloc"])
    tries = hosts.select(
        "url", root.alias("_root"), F.posexplode(F.array(*[F.lit(l) for l in LOCATIONS])).alias("place", "_l")
    ).select("url", "place", resolve_url(F.col("_root"), F.col("_l")).alias("sitemap_url"))
    return tries.join(captured.select(F.col("url").alias("sitemap_url")), "sitemap_url", "left_semi")

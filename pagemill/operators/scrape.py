"""Everything known about a page in one row: one scan, one projection, no join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import js
from pagemill.functions.html import ANCHOR, attr, element_text, find_all, has_attr, void_pattern
from pagemill.functions.rules import Page, select, select_all, staged
from pagemill.functions.text import strip
from pagemill.functions.urls import resolve_url
from pagemill.operators.pages import meta_tags, metadata_columns
from pagemill.operators.tables import form_structs, table_structs


def link_structs(doc: Column, url: Column) -> Column:
    """ARRAY<STRUCT<text, url, title>> of the links of a page in document order."""
    found = F.filter(find_all(doc, ANCHOR), lambda a: has_attr(a, "href"))
    return F.transform(
        found,
        lambda a: F.struct(
            element_text(a).alias("text"),
            resolve_url(url, strip(F.coalesce(attr(a, "href"), F.lit("")))).alias("url"),
            F.coalesce(attr(a, "title"), F.lit("")).alias("title"),
        ),
    )


def _staged(pages: DataFrame) -> tuple[DataFrame, Page]:
    return staged(pages, "page_id", "url", "html", F.regexp_extract("html", void_pattern("html"), 0).alias("_html"))


def scrape_page(pages: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    """(page_id, url, metadata fields, one column per rule, structured_data, forms, links,
    error); a page without body has only the error."""
    rows, page = _staged(pages)
    doc = page.doc
    rows = rows.withColumn("_tags", meta_tags(doc))
    facts = {
        **metadata_columns(doc, F.col("_html"), F.col("_tags")),
        **{field: select(page, rule) for field, rule in (rules or {}).items()},
        "structured_data": js.jsonld(F.col("html")),
        "forms": form_structs(doc),
        "links": link_structs(doc, F.col("url")),
    }
    has_body = F.col("html").isNotNull() & (F.col("html") != "")
    return rows.select(
        "page_id",
        "url",
        *[F.when(has_body, c).alias(n) for n, c in facts.items()],
        F.when(~has_body, "empty page").alias("error"),
    )


def analyze_pages(pages: DataFrame, rules: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """(page_id, url, javascript, extracted_data, found, tables, forms, links)."""
    rows, page = _staged(pages)
    doc, html = page.doc, F.col("html")
    found = (
        F.map_from_arrays(
            F.array(*[F.lit(r) for r in rules]), F.array(*[select_all(page, r) for r in rules])
        )
        if rules
        else F.lit(None)
    )
    return rows.select(
        "page_id",
        "url",
        js.js_detect(html, strict).alias("javascript"),
        F.struct(js.jsonld(html).alias("json_ld"), js.window_vars(html).alias("window_vars")).alias("extracted_data"),
        found.alias("found"),
        F.flatten(table_structs(page)).alias("tables"),
        form_structs(doc).alias("forms"),
        link_structs(doc, F.col("url")).alias("links"),
    )

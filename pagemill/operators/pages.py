"""Facts of one page: one scan of ``pages(page_id, url, html)``, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import js
from pagemill.functions.html import attr, find_all, first_text, void_pattern, without_code
from pagemill.functions.rules import first, has_path, select, select_all, staged, with_paths
from pagemill.functions.text import last_wins_map, meta_prefix_map, page_text, text_content


def usable_pages(pages: DataFrame, content_type: str | None = None) -> DataFrame:
    """Pages with a body; with a content type column, web pages only."""
    kept = pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))
    if content_type:
        kept = kept.filter(
            F.col(content_type).isNull() | F.contains(F.lower(F.col(content_type)), F.lit("text/html"))
        )
    return kept


def meta_tags(doc: Column) -> Column:
    """ARRAY<STRUCT<name, property, content>> of the ``meta`` tags of a page, read once."""
    return F.transform(
        find_all(doc, void_pattern("meta")),
        lambda t: F.struct(
            attr(t, "name").alias("name"),
            attr(t, "property").alias("property"),
            attr(t, "content").alias("content"),
        ),
    )


def _meta_entries(tags: Column, key) -> Column:
    return F.filter(
        F.transform(
            tags,
            lambda m: F.struct(
                F.coalesce(key(m), F.lit("")).alias("key"), F.coalesce(m["content"], F.lit("")).alias("value")
            ),
        ),
        lambda e: (e["key"] != "") & (e["value"] != ""),
    )


def metadata_columns(doc: Column, html_tag: Column, tags: Column) -> dict[str, Column]:
    """Name -> column of what a page says about itself; ``tags`` is a column of its ``meta_tags``."""

    def either(m: Column) -> Column:
        return F.when(m["name"] != "", m["name"]).otherwise(m["property"])

    canonical = F.filter(
        F.transform(
            find_all(doc, void_pattern("link")),
            lambda t: F.struct(attr(t, "rel").alias("rel"), attr(t, "href").alias("href")),
        ),
        lambda l: (l["rel"] == "canonical") & l["href"].isNotNull(),
    )
    title = first_text(doc, "title")
    return {
        "title": F.when(title != "", title),
        "meta": last_wins_map(_meta_entries(tags, either)),
        "open_graph": meta_prefix_map(_meta_entries(tags, lambda m: m["property"]), "og:"),
        "twitter_card": meta_prefix_map(_meta_entries(tags, lambda m: m["name"]), "twitter:"),
        "canonical_url": F.get(canonical, F.lit(0))["href"],
        "language": F.when(attr(html_tag, "lang") != "", attr(html_tag, "lang")),
    }


def extract_metadata(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Title, meta map, Open Graph and Twitter maps, canonical link, language, and the columns ``keep``."""
    staged_pages = pages.select(
        "page_id",
        "url",
        *keep,
        without_code(F.col("html")).alias("_doc"),
        F.regexp_extract("html", void_pattern("html"), 0).alias("_html"),
    )
    staged_pages = staged_pages.withColumn("_tags", meta_tags(F.col("_doc")))
    facts = metadata_columns(F.col("_doc"), F.col("_html"), F.col("_tags"))
    return staged_pages.select("page_id", "url", *keep, *[c.alias(n) for n, c in facts.items()])


def extract_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", text_content(F.col("html")).alias("text"))


def _found(text: Column, pattern: str, group: int | None) -> Column:
    """What a search for all matches gives: the whole match without groups, the group if there is one, else the
    groups as a JSON array."""
    flags = f"(?iU){pattern}"
    groups = re.compile(pattern).groups
    if group is not None or groups < 2:
        return F.regexp_extract_all(text, F.lit(flags), F.lit(min(groups, 1) if group is None else group))
    each = [F.regexp_extract_all(text, F.lit(flags), F.lit(n)) for n in range(1, groups + 1)]
    return F.transform(each[0], lambda m, i: F.to_json(F.array(*[F.get(e, i) for e in each])))


def extract_patterns(pages: DataFrame, patterns: Mapping[str, str], group: int | None = None) -> DataFrame:
    """(page_id, field, pos, value): every match of every named pattern in the page text, letter case ignored in any
    script. A pattern with one group gives that group, one with several a JSON array of them; ``group`` picks one."""
    staged_pages = pages.select("page_id", page_text(F.col("html")).alias("_text"))
    found = F.map_from_arrays(
        F.array(*[F.lit(f) for f in patterns]), F.array(*[_found(F.col("_text"), p, group) for p in patterns.values()])
    )
    fields = staged_pages.select("page_id", F.explode_outer(found).alias("field", "values")).filter("field IS NOT NULL")
    return fields.select("page_id", "field", F.posexplode_outer("values").alias("pos", "value")).filter("pos IS NOT NULL")


def extract_rules(pages: DataFrame, rules: Mapping[str, str], kind: str = "text") -> DataFrame:
    """One column per rule: ARRAY<STRING> for the kinds ``text`` and ``html``, ARRAY<STRUCT<text, html,
    attributes>> for ``all``."""
    rows, page = staged(pages, "page_id", "url")
    read = select_all if kind == "all" else lambda p, rule: select(p, rule, kind)
    late = [rule for rule in rules.values() if has_path(rule)]
    # Rules without a path of several steps are read first, so that no page waits for the others with all its elements.
    found = {rule: read(page, rule) for rule in rules.values() if rule not in late}
    if late:
        rows, page = with_paths(rows, page, late, "page_id", "url", *[c.alias(f"_value{i}") for i, c in enumerate(found.values())], kind=kind)
        found = {rule: F.col(f"_value{i}") for i, rule in enumerate(found)} | {rule: read(page, rule) for rule in late}
    return rows.select("page_id", "url", *[found[rule].alias(f) for f, rule in rules.items()])


def extract_single(
    pages: DataFrame, rules: Mapping[str, str], defaults: Mapping[str, str] | None = None, kind: str = "text"
) -> DataFrame:
    """One STRING column per rule: the first value found, else the field's default (NULL if none is given)."""
    found = extract_rules(pages, rules, kind)
    return found.withColumns({f: first(F.col(f), (defaults or {}).get(f)) for f in rules})


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """(page_id, pos, json) of every JSON-LD block that parses."""
    return pages.select("page_id", F.posexplode_outer(js.jsonld(F.col("html"))).alias("pos", "json")).filter("pos IS NOT NULL")


def extract_window_vars(pages: DataFrame) -> DataFrame:
    """(page_id, name, json) of data assigned to ``window``; the last of equal names counts."""
    found = last_wins_map(js.window_vars(F.col("html")))
    return pages.select("page_id", F.explode_outer(found).alias("name", "json")).filter("name IS NOT NULL")


def detect_javascript(pages: DataFrame, strict: bool = True) -> DataFrame:
    return pages.select("page_id", js.js_detect(F.col("html"), strict).alias("js")).select("page_id", "js.*")


def ajax_endpoints(pages: DataFrame, strict: bool = True) -> DataFrame:
    found = js.ajax_endpoints(F.col("html"), strict)
    return pages.select("page_id", F.explode_outer(found).alias("endpoint")).filter("endpoint IS NOT NULL")


def spa_routing(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", js.spa_routing(F.col("html")).alias("r")).select("page_id", "r.*")

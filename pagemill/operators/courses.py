"""Course pages, their files and catalogs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.elements import attribute, inner_html
from pagemill.functions.files import file_type, file_type_simple, filename_link, filename_url, stable_number
from pagemill.functions.html import (
    attr,
    element_pattern,
    find_all,
    inner,
    void_pattern,
    without_code,
)
from pagemill.functions.rules import (
    ACADEMIC_RULES,
    CATALOG_RULES,
    DESCRIPTION_RULES,
    INSTRUCTOR_RULES,
    MATERIAL_RULES,
    NAME_RULES,
    SEMESTER_RULES,
    Page,
    element_value,
    firsts_inside,
    has_path,
    no_elements,
    select,
    select_elements,
    staged,
    with_paths,
)
from pagemill.functions.text import collapse_space, find_date, first_semester, let, strip, text_content, text_nodes
from pagemill.functions.urls import course_id, is_downloadable, resolve_url
from pagemill.operators.links import extract_links, keep_rows
from pagemill.operators.ordered import dedup_first_by_url
from pagemill.operators.pages import extract_rules

# Hosts whose frames are videos.
VIDEO_HOSTS = ["youtube.com", "vimeo.com", "dailymotion.com"]

# Paths under which a site may list its courses, tried in this order.
CATALOG_PATHS = ["", "/courses", "/catalog", "/academics/courses", "/course-list"]


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, strip), " ")


def _first_passing(page: Page, rules: Sequence[str], read, passes) -> Column:
    return F.coalesce(
        *[let(read(select(page, rule)), lambda v: F.when(passes(v), v)) for rule in rules]
    )


def sanity_filters(name: Column, instructor: Column, semester: Column, description: Column) -> dict[str, Column]:
    """Length bounds a candidate must keep to count."""
    return {
        "name": F.when((name != "") & (F.length(name) < 200), name),
        "instructor": F.when((instructor != "") & (F.length(instructor) < 100), instructor),
        "semester": F.when((semester != "") & (F.length(semester) < 50), semester),
        "description": F.when(F.length(description) > 20, F.substring(description, 1, 500)),
    }


def course_page(pages: DataFrame) -> DataFrame:
    """(page_id, url, name, instructor, semester, description); the first rule whose
    result passes its length bound counts."""
    rows, page = staged(pages, "page_id", "url", "html")

    def head(values: Column) -> Column:
        return strip(F.get(values, F.lit(0)))

    def name_of(page: Page, rules: Sequence[str]) -> Column:
        return _first_passing(page, rules, lambda v: collapse_space(head(v)), lambda v: (v != "") & (F.length(v) < 200))

    instructor = _first_passing(
        page, INSTRUCTOR_RULES, _joined, lambda v: (v != "") & (F.length(v) < 100)
    )
    semester = _first_passing(page, SEMESTER_RULES, head, lambda v: (v != "") & (F.length(v) < 50))
    description = _first_passing(page, DESCRIPTION_RULES, _joined, lambda v: F.length(v) > 20)
    rows = rows.withColumns(
        {
            "instructor": instructor,
            "semester": F.coalesce(semester, first_semester(text_content(F.col("html")))),
            "description": F.substring(description, 1, 500),
        }
    )
    # Everything but the path of several steps is read first, so that no page waits for that path with all its elements.
    at = next(i for i, rule in enumerate(NAME_RULES) if has_path(rule))
    rows = rows.withColumn("_before", name_of(page, NAME_RULES[:at]))
    after = F.when(F.col("_before").isNull(), name_of(page, NAME_RULES[at + 1 :]))
    found = ["page_id", "url", "instructor", "semester", "description"]
    rows, page = with_paths(rows, page, [NAME_RULES[at]], *found, "_before", after.alias("_after"))
    name = F.coalesce("_before", name_of(page, [NAME_RULES[at]]), "_after", F.lit("Unknown Course"))
    return rows.select("page_id", "url", name.alias("name"), "instructor", "semester", "description")


def media_files(pages: DataFrame) -> DataFrame:
    """(page_id, pos, name, file_url, type, description, source) of embedded media."""

    def sources(doc: Column, tag: str) -> Column:
        def one(el: Column) -> Column:
            opened = F.regexp_extract(el, void_pattern(tag), 0)
            return F.concat(F.array(opened), find_all(inner(el), void_pattern("source")))

        tags = F.flatten(F.transform(find_all(doc, element_pattern(tag)), one))
        found = F.transform(tags, lambda t: attr(t, "src"))
        return F.filter(found, lambda s: s.isNotNull() & (s != ""))

    def tagged(urls: Column, source: str) -> Column:
        return F.transform(urls, lambda u: F.struct(F.lit(source).alias("source"), u.alias("src")))

    doc = F.col("_doc")
    frames = F.filter(
        F.transform(find_all(doc, void_pattern("iframe")), lambda t: attr(t, "src")),
        lambda s: s.rlike("|".join(h.replace(".", r"\.") for h in VIDEO_HOSTS)),
    )
    staged = pages.select("page_id", "url", without_code(F.col("html")).alias("_doc"))
    rows = staged.select(
        "page_id",
        "url",
        F.posexplode_outer(
            F.concat(tagged(sources(doc, "video"), "video"), tagged(sources(doc, "audio"), "audio"), tagged(frames, "iframe"))
        ).alias("pos", "m"),
    )
    rows = rows.filter("pos IS NOT NULL").select("page_id", "url", "pos", "m.*")
    frame = F.col("source") == "iframe"
    rows = rows.withColumn(
        "file_url", F.when(frame, F.col("src")).otherwise(resolve_url(F.col("url"), F.col("src")))
    )
    null = F.lit(None).cast("string")
    return rows.select(
        "page_id",
        "pos",
        F.when(frame, F.concat(F.lit("video_embed_"), stable_number(F.col("src"))))
        .otherwise(filename_link(F.col("file_url"), null, null))
        .alias("name"),
        "file_url",
        F.when(F.col("source") == "audio", "resource").otherwise("lecture_video").alias("type"),
        F.when(frame, "Embedded video (external)")
        .when(F.col("source") == "audio", "Embedded audio")
        .otherwise("Embedded video")
        .alias("description"),
        "source",
    )


def _links_in_context(pages: DataFrame) -> DataFrame:
    """The columns of ``extract_links`` that files need, from the elements of the page, and ``file_date``: the first
    date in the text of the element around the link. A date is looked for once per such element."""
    rows, page = staged(pages, "page_id", "url")
    found = F.filter(page.all, lambda e: e["tag"] == "a")
    around = F.array_distinct(F.transform(found, lambda e: e["parent"]))
    dates = F.map_from_arrays(
        around,
        F.transform(around, lambda i: F.when(i >= 0, find_date(element_value(page, F.get(page.all, F.greatest(i, F.lit(0))), "text")))),
    )
    rows = rows.withColumn("_dates", dates)

    def link(e: Column) -> Column:
        return F.struct(
            attribute(e, "href").alias("href"),
            element_value(page, e, "text").alias("text"),
            F.coalesce(attribute(e, "title"), F.lit("")).alias("title"),
            attribute(e, "download").alias("download"),
            (F.array_join(_raw_texts(page, e), "") != "").alias("has_text"),
            F.try_element_at(F.col("_dates"), e["parent"]).alias("file_date"),
        )

    links = rows.select("page_id", "url", F.posexplode_outer(F.transform(found, link)).alias("pos", "l"))
    links = links.select("page_id", "url", "pos", "l.*").filter("href IS NOT NULL")
    return links.withColumn("link_url", resolve_url(F.col("url"), strip(F.col("href"))))


def linked_files(pages: DataFrame, strict: bool = True) -> DataFrame:
    """(page_id, pos, name, file_url, type, description, file_date) of links to files. ``strict`` gives no dates;
    otherwise the date is the first one in the text of the link's parent."""

    def wanted(link: Column) -> Column:
        return (
            (link["href"] != "")
            & ~F.lower(link["link_url"]).rlike("^(?:mailto|javascript):")
            & is_downloadable(link["link_url"], link["text"], link["download"].isNotNull())
        )

    found = extract_links(pages, use_base=False) if strict else _links_in_context(pages)
    if strict:
        found = found.withColumn("file_date", F.lit(None).cast("date"))
    links = keep_rows(found, wanted)
    # A text of white space only names a file by that, which leaves no name, so the link gives no file.
    text = F.when((F.col("text") == "") & F.col("has_text"), " ").otherwise(F.col("text"))
    links = links.withColumn("name", filename_link(F.col("link_url"), text, F.col("download")))
    named = keep_rows(links, lambda link: link["name"] != "")
    described = F.when(F.col("text") != "", F.col("text")).when(F.col("title") != "", strip(F.col("title")))
    return named.select(
        "page_id",
        "pos",
        "name",
        F.col("link_url").alias("file_url"),
        file_type(F.col("link_url"), F.col("name"), F.col("text"), strict).alias("type"),
        described.alias("description"),
        "file_date",
    )


def course_files(pages: DataFrame, strict: bool = True) -> DataFrame:
    """Linked files, then embedded media; ``source`` tells which."""
    linked = linked_files(pages, strict).withColumn("source", F.lit("link"))
    media = media_files(pages).withColumn("file_date", F.lit(None).cast("date"))
    return linked.unionByName(media)


def course_materials(pages: DataFrame, custom_rules: Mapping[str, str] | None = None) -> DataFrame:
    """(page_id, rule_no, pos, name, file_url, type, description): links that match a
    rule, each URL of a page once, in rule order."""
    rules = {**MATERIAL_RULES, **(custom_rules or {})}
    base, page = staged(pages, "page_id", "url")

    def link(number: int):
        return lambda e, i: F.struct(
            F.lit(number).alias("rule_no"),
            i.alias("pos"),
            F.coalesce(attribute(e, "href"), F.lit("")).alias("href"),
            element_value(page, e, "text").alias("text"),
            F.coalesce(attribute(e, "title"), F.lit("")).alias("description"),
        )

    found = [F.transform(select_elements(page, rule), link(n)) for n, rule in enumerate(rules.values())]
    rows = base.select("page_id", "url", F.explode_outer(F.concat(*found)).alias("f")).select("page_id", "url", "f.*")
    rows = rows.filter(F.col("href") != "").withColumn("file_url", resolve_url(F.col("url"), F.col("href")))
    rows = dedup_first_by_url(rows.drop("url", "href"), ["page_id", "file_url"], ["rule_no", "pos"])
    name = F.when(F.col("text") != "", F.col("text")).otherwise(filename_url(F.col("file_url")))
    return rows.withColumn("name", name).select(
        "page_id",
        "rule_no",
        "pos",
        "name",
        "file_url",
        file_type_simple(F.col("file_url"), F.col("name")).alias("type"),
        "description",
    )


def _course(page: Page, item: Column, link: Column, person: Column, term: Column, url: Column) -> Column:
    """struct(id, name, url, instructor, semester) of a catalog item and the numbers of what is found inside it; NULL
    without link. A link of blank text names the course by that, so its name is empty."""

    def text_of(number: Column) -> Column:
        return F.when(number >= 0, element_value(page, F.get(page.all, number), "text"))

    def build(v: Column) -> Column:
        target = resolve_url(url, F.coalesce(attribute(v["link"], "href"), F.lit("")))
        raw = F.array_join(_raw_texts(page, v["link"]), "")
        text = F.when(raw != "", raw).otherwise(element_value(page, v["item"], "text"))
        return let(
            F.struct(target.alias("url"), strip(collapse_space(text)).alias("name")),
            lambda c: F.struct(
                course_id(c["url"], c["name"]).alias("id"),
                c["name"].alias("name"),
                c["url"].alias("url"),
                text_of(person).alias("instructor"),
                text_of(term).alias("semester"),
            ),
        )

    whole = F.struct(F.get(page.all, F.greatest(link, F.lit(0))).alias("link"), item.alias("item"))
    return F.when(link >= 0, let(whole, build))


def _raw_texts(page: Page, e: Column) -> Column:
    """The text nodes of an element as they stand."""
    return text_nodes(inner_html(page.chunks, e))


def _catalogs(pages: DataFrame, *keep: str) -> DataFrame:
    """(page_id, url, courses ARRAY<STRUCT<...>>) and the columns ``keep``, read in one scan."""
    url = F.col("url")
    rows, page = staged(pages, "page_id", "url", *keep)
    items = F.coalesce(
        *[let(select_elements(page, rule), lambda v: F.when(F.size(v) > 0, v)) for rule in CATALOG_RULES], no_elements()
    )
    rows = rows.withColumn("_items", items)
    # What is looked for inside a container.
    inside = [
        "//a[@href]",
        '//*[contains(@class, "instructor")]',
        '//*[contains(@class, "term") or contains(@class, "semester")]',
    ]
    rows = rows.withColumn("_inside", firsts_inside(page, F.col("_items"), inside))
    parts = lambda i: [F.get(F.get(F.col("_inside"), F.lit(n)), i) for n in range(len(inside))]
    listed = F.filter(F.transform("_items", lambda e, i: _course(page, e, *parts(i), url)), lambda c: c.isNotNull())
    rows = rows.withColumn("_listed", listed)
    null = F.lit(None).cast("string")

    def plain(a: Column) -> Column:
        raw = F.array_join(_raw_texts(page, a), "")
        name = F.when(raw != "", strip(raw)).otherwise("Unknown Course")
        return let(
            F.struct(resolve_url(url, attribute(a, "href")).alias("url"), name.alias("name")),
            lambda c: F.struct(
                course_id(c["url"], c["name"]).alias("id"),
                c["name"].alias("name"),
                c["url"].alias("url"),
                null.alias("instructor"),
                null.alias("semester"),
            ),
        )

    fallback = F.transform(select_elements(page, '//a[contains(@href, "course") or contains(@href, "class")]'), plain)
    courses = let(F.col("_listed"), lambda c: F.when(F.size(c) > 0, c).otherwise(fallback))
    return rows.select("page_id", "url", *keep, courses.alias("courses"))


def course_catalog(pages: DataFrame) -> DataFrame:
    """(page_id, pos, id, name, course_url, instructor, semester): items of the first
    container rule that matches, else links whose href speaks of courses or classes."""
    return _course_rows(_catalogs(pages), "page_id")


def _course_rows(catalogs: DataFrame, *keys: str) -> DataFrame:
    # The outer form infers no filter on the array; pushed to the scan, such a filter would
    # work out the whole array a second time.
    rows = catalogs.select(*keys, F.posexplode_outer("courses").alias("pos", "c")).filter("pos IS NOT NULL")
    return rows.select(
        *keys, "pos", "c.id", "c.name", F.col("c.url").alias("course_url"), "c.instructor", "c.semester"
    )


def list_courses(pages: DataFrame) -> DataFrame:
    """(id, name, url) of the courses of catalog pages."""
    return course_catalog(pages).select("id", "name", F.col("course_url").alias("url"))


def academic_fields(pages: DataFrame) -> DataFrame:
    return extract_rules(pages, ACADEMIC_RULES)


def catalog_candidates(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Courses of the first catalog location of each site (one ``url`` per row) whose
    page lists any. Locations are made per site row and joined to pages on the URL."""
    tries = sites.select(
        F.col("url").alias("site"),
        F.posexplode(F.array(*[F.lit(p) for p in CATALOG_PATHS])).alias("place", "path"),
    ).select("site", "place", resolve_url(F.col("site"), F.col("path")).alias("catalog_url"))
    # Only pages at such a location are cut into elements.
    captured = tries.join(pages.select("page_id", F.col("url").alias("catalog_url"), "html"), "catalog_url")
    listing = _catalogs(captured.withColumnRenamed("catalog_url", "url"), "site", "place").withColumnRenamed("url", "catalog_url")
    best = (
        listing.filter(F.size("courses") > 0)
        .groupBy("site")
        .agg(F.min_by(F.struct("catalog_url", "page_id", "courses"), "place").alias("b"))
        .select("site", "b.*")
    )
    return _course_rows(best, "site", "catalog_url", "page_id")

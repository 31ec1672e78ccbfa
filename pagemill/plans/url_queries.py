"""Queries on URLs, names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import files, js, text, urls
from pagemill.operators.courses import sanity_filters
from pagemill.operators.links import extract_links, in_domains, should_crawl, urls_union
from pagemill.operators.pages import extract_patterns, extract_text
from pagemill.plans.derived import choose, derived, given, with_derived
from pagemill.sources import readers

# SQL pieces for the checking database.
SPLIT = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"
LINK = """'<a href="([^"]*)">(.*?)</a>'"""
ENTITIES = ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&amp;", "&")


def part(url: str, number: int) -> str:
    return f"regexp_extract({url}, {SPLIT}, {number})"


def netloc(url: str) -> str:
    return part(url, 2)


def path(url: str) -> str:
    return f"regexp_replace({part(url, 3)}, ';[^/]*$', '')"


def normalized(url: str) -> str:
    u = f"lower({url})"
    whole = f"{part(u, 1)} || '://' || {part(u, 2)} || {path(u)} || CASE WHEN {part(u, 4)} <> '' THEN '?' || {part(u, 4)} ELSE '' END"
    return f"CASE WHEN ({whole}) LIKE '%/' AND length({path(u)}) > 1 THEN regexp_replace({whole}, '/$', '') ELSE {whole} END"


def unescaped(expr: str) -> str:
    for entity, char in ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


def numbered(arrays: str, source: str, first: str) -> str:
    """FROM clause that unnests parallel arrays with their position."""
    return f"(SELECT *, {arrays} FROM {source}), unnest(range(1, len({first}) + 1)) AS t(i)"


PAGE_LINKS = (
    "links AS (SELECT page_id, url, i - 1 AS pos, hrefs[i] AS href, texts[i] AS label FROM "
    + numbered(
        f"regexp_extract_all(html, {LINK}, 1) AS hrefs, regexp_extract_all(html, {LINK}, 2) AS texts", "pages", "hrefs"
    )
    + ")"
)
# Links of the given pages are all rooted paths.
ROOTED = f"{part('url', 1)} || '://' || {netloc('url')} || href"

QUERIES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function

    return register


@query(
    "url_parts",
    f"""SELECT page_id, {part('url', 1)} AS scheme, {netloc('url')} AS netloc, {path('url')} AS path,
    '' AS params, {part('url', 4)} AS query, {part('url', 5)} AS fragment FROM pages""",
)
def url_parts(spark, sf):
    return given(spark, sf, "pages").select("page_id", urls.url_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query("normalize_url", f"SELECT page_id, url, {normalized('url')} AS normalized FROM pages")
def normalize_url(spark, sf):
    return given(spark, sf, "pages").select("page_id", "url", urls.normalize_url(F.col("url")).alias("normalized"))


_H = "'http://h' || o_custkey || '.example.com"
_RESOLVED = choose(
    "o_orderkey",
    f"{_H}/a/b' || o_orderkey % 10 || '/x' || o_orderkey",
    f"{_H}/a/x' || o_orderkey || '?y=1'",
    f"{_H}/r/' || o_orderkey",
    "'http://o.example/' || o_orderkey",
    f"{_H}/a/b' || o_orderkey % 10 || '/c;p?k=' || o_orderkey",
    f"{_H}/a/b' || o_orderkey % 10 || '/c;p?q=1#s' || o_orderkey",
    "'HTTP://h' || o_custkey || '.example.com/a/b' || o_orderkey % 10 || '/c;p?q=1#f'",
    "'mailto:m' || o_orderkey || '@x.y'",
    "'https://z.example/' || o_orderkey || '/../w#'",
    f"{_H}/up' || o_orderkey",
    f"{_H}/a/b' || o_orderkey % 10 || '/'",
    f"{_H}/a/b' || o_orderkey % 10 || '/t' || o_orderkey || ';v'",
)


@query("resolve_url", f"SELECT o_orderkey AS ref_id, {_RESOLVED} AS resolved FROM orders")
def resolve_url(spark, sf):
    refs = derived(spark, sf, "references")
    return refs.select("ref_id", urls.resolve_url(F.col("base"), F.col("href")).alias("resolved"))


_COURSE_ID = choose(
    "o_orderkey",
    "'CS' || (100 + o_orderkey % 900)",
    "'course-' || o_orderkey",
    "'' || o_orderkey",
    "'c' || o_orderkey",
    "NULL",
    "NULL",
    "NULL",
)
_COURSE_PATH = choose(
    "o_orderkey",
    "'/x/CS' || (100 + o_orderkey % 900) || '/home'",
    "'/course-' || o_orderkey || '/'",
    "'/list'",
    "'/p/'",
    "'/Some-Thing/' || o_orderkey",
    "'/9lives'",
    "''",
)
_COURSE_QUERY = choose(
    "o_orderkey", "'id=7'", "''", "'id=' || o_orderkey || ',2;name=a b c'", "'cid=c' || o_orderkey", "''", "''", "''"
)


@query(
    "parse_course_url",
    f"""SELECT o_orderkey AS url_id, 'u' || o_custkey || '.example.edu' AS domain, {_COURSE_PATH} AS path,
    {_COURSE_ID} AS course_id, {_COURSE_QUERY} AS query FROM orders""",
)
def parse_course_url(spark, sf):
    rows = derived(spark, sf, "course_urls").select("url_id", urls.parse_course_url(F.col("url")).alias("c"))
    entries = F.array_sort(F.map_entries("c.query"))
    shown = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";"
    )
    return rows.select("url_id", "c.domain", "c.path", "c.course_id", shown.alias("query"))


_FROM_NAME = choose(
    "o_orderkey", "'CS101'", "replace('Ünïon & co ' || o_orderkey, ' ', '_')", "'MATH2001'"
)
_ID = choose(
    "o_orderkey",
    "@",
    "'course-' || o_orderkey",
    "@",
    "@",
    "'Some-Thing'",
    "'9lives'",
    "@",
).replace("@", f"replace({_FROM_NAME}, '&', '_')")


@query("course_id", f"SELECT o_orderkey AS url_id, {_ID} AS course_id FROM orders")
def course_id(spark, sf):
    rows = derived(spark, sf, "course_urls")
    return rows.select("url_id", urls.course_id(F.col("url"), F.col("name")).alias("course_id"))


@query(
    "robots_url",
    f"SELECT page_id, {part('url', 1)} || '://' || {netloc('url')} || '/robots.txt' AS robots FROM pages",
)
def robots_url(spark, sf):
    return given(spark, sf, "pages").select("page_id", urls.robots_url(F.col("url")).alias("robots"))


@query(
    "is_valid_url_basic",
    with_derived(
        ["references"],
        f"SELECT ref_id, {part('href', 1)} <> '' AND {part('href', 2)} <> '' AS valid FROM \"references\"",
    ).replace("WITH references AS", 'WITH "references" AS'),
)
def is_valid_url_basic(spark, sf):
    return derived(spark, sf, "references").select("ref_id", urls.is_valid_url_basic(F.col("href")).alias("valid"))


_SKIP = "'[.](jpg|jpeg|png|gif|pdf|zip|exe|dmg|mp3|mp4|avi|mov)$'"


@query(
    "is_crawlable_url",
    with_derived(
        ["file_urls"],
        f"""SELECT orderkey, line, url,
        regexp_matches({netloc('url')}, '(^|[.])(s1[.]example[.]com|s2[.]example[.]com)$')
        AND NOT regexp_matches(lower({path('url')}), {_SKIP}) AS dotted,
        regexp_matches({netloc('url')}, '(1[.]example[.]com|s2[.]example[.]com)$')
        AND NOT regexp_matches(lower({path('url')}), {_SKIP}) AND contains(url, 'e') AS strict FROM file_urls""",
    ),
)
def is_crawlable_url(spark, sf):
    url = F.col("url")
    dotted = urls.is_crawlable_url(url, ["s1.example.com", "s2.example.com"])
    strict = urls.is_crawlable_url(
        url, ["1.example.com", "s2.example.com"], url_filter=lambda u: u.contains("e"), strict=True
    )
    return derived(spark, sf, "file_urls").select("orderkey", "line", "url", dotted.alias("dotted"), strict.alias("strict"))


@query(
    "crawlable_in_domains",
    """SELECT l_orderkey AS orderkey, l_linenumber AS line, l_linenumber % 3 <> 2 AND l_orderkey IN
    (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) AS allowed FROM lineitem WHERE l_linenumber % 5 <> 4""",
)
def crawlable_in_domains(spark, sf):
    """As many allowed domains as there are even orders; URLs on them, below them, and on hosts that only end alike."""
    domains = given(spark, sf, "orders").filter("o_orderkey % 2 = 0").selectExpr("'.o' || o_orderkey || '.example.com' AS domain")
    start = "CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'Www.x.' ELSE 'x' END"
    rows = given(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS orderkey",
        "l_linenumber AS line",
        f"'http://' || {start} || 'O' || l_orderkey || '.example.com/l' || IF(l_linenumber % 5 = 4, '.pdf', '') AS url",
    )
    crawlable = rows.filter(urls.is_crawlable_url(F.col("url")))
    inside = in_domains(crawlable, domains).select("orderkey", "line", F.lit(True).alias("_in"))
    marked = crawlable.join(inside.distinct(), ["orderkey", "line"], "left")
    return marked.select("orderkey", "line", F.coalesce("_in", F.lit(False)).alias("allowed"))


_NAV = "'/(contact|about|privacy|terms|login|logout|register|signup|search|help|faq|sitemap)'"


@query(
    "is_navigation_url",
    f"""WITH {PAGE_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_matches(lower({path(ROOTED)}), {_NAV}) AS navigation FROM links""",
)
def is_navigation_url(spark, sf):
    links = extract_links(given(spark, sf, "pages"))
    return links.select("page_id", "pos", urls.is_navigation_url(F.col("link_url")).alias("navigation"))


_DOWNLOAD = (
    "'[.](pdf|doc|docx|ppt|pptx|xls|xlsx|zip|rar|tar|gz|7z|mp4|avi|mov|wmv|webm|mp3|wav|ogg|txt|md|csv|json|xml|jpg|jpeg|png|gif|svg)$'"
)


@query(
    "is_downloadable",
    with_derived(
        ["file_urls"],
        f"""SELECT orderkey, line, url, regexp_matches(lower({path('url')}), {_DOWNLOAD}) OR download IS NOT NULL
        OR regexp_matches(lower(text), 'download|pdf|slides|homework|assignment|lecture')
        OR regexp_matches(lower({path('url')}), '/(download|files|documents|media)/') AS downloadable FROM file_urls""",
    ),
)
def is_downloadable(spark, sf):
    test = urls.is_downloadable(F.col("url"), F.col("text"), F.col("download").isNotNull())
    return derived(spark, sf, "file_urls").select("orderkey", "line", "url", test.alias("downloadable"))


@query(
    "filter_urls_regex",
    r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]+(\.html)?$')",
)
def filter_urls_regex(spark, sf):
    from pagemill.operators.crawl import filter_urls

    return filter_urls(given(spark, sf, "pages").select("page_id", "url"), r"/(en|fr)/[0-9]+(\.html)?$")


@query(
    "skip_static_endpoints",
    with_derived(
        ["file_urls"],
        """SELECT orderkey, line, url, regexp_matches(lower(url), '[.](css|js|jpg|png|gif)') AS strict,
        regexp_matches(lower(url), '[.](css|js|jpg|png|gif)([^a-z0-9]|$)') AS plain FROM
        (SELECT orderkey, line, url || CASE line % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.CSS?v=1' ELSE '' END AS url FROM file_urls)""",
    ),
)
def skip_static_endpoints(spark, sf):
    ending = F.when(F.col("line") % 3 == 0, ".json").when(F.col("line") % 3 == 1, ".CSS?v=1").otherwise("")
    rows = derived(spark, sf, "file_urls").withColumn("url", F.concat("url", ending))
    return rows.select(
        "orderkey",
        "line",
        "url",
        js.skip_static_endpoint(F.col("url")).alias("strict"),
        js.skip_static_endpoint(F.col("url"), strict=False).alias("plain"),
    )


@query(
    "sanity_filters",
    """SELECT doc_id, CASE WHEN length(text) BETWEEN 1 AND 199 THEN text END AS name,
    CASE WHEN length(text) BETWEEN 1 AND 99 THEN text END AS instructor,
    CASE WHEN length(text) BETWEEN 1 AND 49 THEN text END AS semester,
    CASE WHEN length(text) > 20 THEN substr(text, 1, 500) END AS description FROM documents""",
)
def sanity(spark, sf):
    t = F.col("text")
    kept = sanity_filters(t, t, t, t)
    return given(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in kept.items()])


@query(
    "file_visible",
    with_derived(
        ["catalog_files"],
        "SELECT seq, name NOT LIKE '.%' AS shown, name NOT LIKE '.%' AND name <> 'README.md' AS recent FROM catalog_files",
    ),
)
def file_visible(spark, sf):
    name = F.col("name")
    return derived(spark, sf, "catalog_files").select(
        "seq", files.file_visible(name).alias("shown"), files.file_visible(name, recent=True).alias("recent")
    )


_TYPES = """CASE
    WHEN regexp_matches(@, '[.](mp4|avi|mov|wmv|flv|webm|m4v)$') THEN 'lecture_video'
    WHEN regexp_matches(@, '[.](ppt|pptx|pdf|odp)$') THEN 'lecture_slide'
    WHEN regexp_matches(@, '[.](docx|doc|txt|md)$') THEN 'assignment'
    WHEN regexp_matches(@, '[.](zip|tar|gz|rar|7z)$') THEN 'resource'
    WHEN regexp_matches(@, '[.](epub|mobi)$') THEN 'reading'
    WHEN regexp_matches(@, '[.]html$') THEN 'syllabus'
    WHEN regexp_matches(@, 'lecture|slides?|presentation|week[0-9]|module[0-9]') THEN 'lecture_slide'
    WHEN regexp_matches(@, 'assignment|homework|hw|problem|pset|quiz|exam') THEN 'assignment'
    WHEN regexp_matches(@, 'resource|material|download|file|document') THEN 'resource'
    WHEN regexp_matches(@, 'video|recording|stream|media') THEN 'lecture_video'
    WHEN regexp_matches(@, 'syllabus|schedule|calendar|outline') THEN 'syllabus'
    WHEN regexp_matches(lower(text), 'video|recording') THEN 'lecture_video'
    WHEN regexp_matches(lower(text), 'slide|presentation') THEN 'lecture_slide'
    WHEN regexp_matches(lower(text), 'assignment|homework') THEN 'assignment'
    WHEN contains(lower(text), 'syllabus') THEN 'syllabus'
    WHEN contains(lower(text), 'reading') THEN 'reading' ELSE 'other' END"""


@query(
    "file_type",
    with_derived(
        ["file_urls"],
        f"""SELECT orderkey, line, url, {_TYPES.replace('@', "lower(replace(url, 'example.com', 'site.org') || text)")} AS type FROM file_urls""",
    ),
)
def file_type(spark, sf):
    rows = derived(spark, sf, "file_urls")
    site = F.replace(F.col("url"), F.lit("example.com"), F.lit("site.org"))
    return rows.select(
        "orderkey", "line", "url", files.file_type(site, F.col("text"), F.col("text")).alias("type")
    )


_SIMPLE = """CASE
    WHEN regexp_matches(@, '[.](mp4|avi|mov|webm)') THEN 'lecture_video'
    WHEN contains(@, '.ppt') THEN 'lecture_slide'
    WHEN contains(@, '.pdf') AND contains(@, 'slide') THEN 'lecture_slide'
    WHEN contains(@, '.doc') AND regexp_matches(@, 'assignment|homework|hw') THEN 'assignment'
    WHEN contains(@, 'syllabus') THEN 'syllabus'
    WHEN regexp_matches(@, '[.](zip|tar|gz|rar)') THEN 'resource'
    WHEN regexp_matches(@, '[.](pdf|epub)') THEN 'reading' ELSE 'other' END"""


@query(
    "file_type_simple",
    with_derived(
        ["file_urls"], f"SELECT orderkey, line, url, {_SIMPLE.replace('@', 'lower(url || text)')} AS type FROM file_urls"
    ),
)
def file_type_simple(spark, sf):
    rows = derived(spark, sf, "file_urls")
    return rows.select("orderkey", "line", "url", files.file_type_simple(F.col("url"), F.col("text")).alias("type"))


# The last part of each derived file URL, percent decoding done by hand.
_LAST = choose(
    "l_partkey",
    "'p' || l_partkey || '.pdf'",
    "'rec ' || l_partkey || '.MP4'",
    "'notes-' || l_partkey",
    "'hw' || l_partkey || '.docx'",
    "l_partkey || '.tar.gz'",
    "''",
    "'' || l_partkey",
    "l_partkey || '.epub'",
    "l_partkey || '.html'",
)
_SLUG = choose("l_linenumber", "'Lecture-slides'", "'Watch-the-recording'", "NULL", "'Reading-list'", "'Go-here'")
_GIVEN = choose("l_orderkey", "NULL", "'my file.zip'", "NULL", "NULL", "NULL")


@query(
    "filename_link",
    f"""SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey % 9 AS kind,
    coalesce({_GIVEN}, CASE WHEN contains({_LAST}, '.') THEN {_LAST} END, {_SLUG}, 'file_') AS name FROM lineitem""",
)
def filename_link(spark, sf):
    rows = derived(spark, sf, "file_urls").withColumn(
        "name", files.filename_link(F.col("url"), F.col("text"), F.col("download"))
    )
    return rows.select("orderkey", "line", _kind_of_url().alias("kind"), _without_number(F.col("name")).alias("name"))


def _kind_of_url():
    url = F.col("url")
    marks = ["/files/", "/v/", "/week", "/docs/", "/a+b/", "/syllabus/", "/media/", "/read/"]
    out = F.when(url.contains(marks[0]), 0)
    for number, mark in enumerate(marks[1:], 1):
        out = out.when(url.contains(mark), number)
    return out.otherwise(8).cast("long")


@query(
    "filename_download",
    f"""SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey % 9 AS kind,
    {_LAST} || CASE WHEN contains({_LAST}, '.') THEN '' ELSE '.bin' END AS name FROM lineitem""",
)
def filename_download(spark, sf):
    rows = derived(spark, sf, "file_urls")
    return rows.select(
        "orderkey", "line", _kind_of_url().alias("kind"), files.filename_download(F.col("url")).alias("name")
    )


def _without_number(name):
    """The number in a made-up name depends on the hash function and is cut off."""
    return F.regexp_replace(name, r"^file_[0-9]+", "file_")


@query(
    "filename_url",
    f"""SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey % 9 AS kind,
    CASE WHEN {_LAST} = '' THEN 'file_' ELSE replace({_LAST}, ' ', '%20') END AS name FROM lineitem""",
)
def filename_url(spark, sf):
    name = _without_number(files.filename_url(F.col("url")))
    return derived(spark, sf, "file_urls").select("orderkey", "line", _kind_of_url().alias("kind"), name.alias("name"))


@query(
    "filename_async",
    f"""SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey % 9 AS kind,
    CASE WHEN contains({_LAST}, '.') THEN replace({_LAST}, ' ', '%20') ELSE 'file_.bin' END AS name FROM lineitem""",
)
def filename_async(spark, sf):
    name = _without_number(files.filename_async(F.col("url")))
    return derived(spark, sf, "file_urls").select("orderkey", "line", _kind_of_url().alias("kind"), name.alias("name"))


_KEPT = choose(
    "l_partkey",
    "'a_b_c_' || l_partkey || '.pdf'",
    "'_my_notes_' || l_partkey || '_. '",
    "'x_y' || l_partkey || '.tar.gz'",
    "substr(repeat('long_', 60) || l_partkey, 1, 200) || '.txt'",
    "'unnamed'",
    "'' || l_partkey",
    "'20240131_' || l_partkey || '.md'",
)
_WHOLE = choose(
    "l_partkey",
    "'a_b_c_' || l_partkey || '.pdf'",
    "'_my_notes_' || l_partkey || '_._'",
    "'x_y' || l_partkey || '.tar.gz'",
    "substr(repeat('long_', 60) || l_partkey || '.txt', 1, 250)",
    "'unnamed'",
    "'' || l_partkey",
    "'20240131_' || l_partkey || '.md'",
)


@query(
    "sanitize_filename",
    f"SELECT l_orderkey AS orderkey, l_linenumber AS line, {_KEPT} AS kept, {_WHOLE} AS whole FROM lineitem",
)
def sanitize_filename(spark, sf):
    name = F.col("name")
    return derived(spark, sf, "names").select(
        "orderkey",
        "line",
        files.sanitize_filename(name, preserve_extension=True).alias("kept"),
        files.sanitize_filename(name).alias("whole"),
    )




@query(
    "prepare_filename",
    f"""SELECT l_orderkey AS orderkey, l_linenumber AS line,
    '20240501_' || substr(regexp_replace('Course_ ' || l_suppkey || '_advanced_topics', '[ _]+', '_', 'g'), 1, 20) || '_' || {_KEPT} AS full_name,
    CASE WHEN l_partkey % 7 = 6 THEN '' ELSE '20240501_' END || {_KEPT} AS dated FROM lineitem""",
)
def prepare_filename(spark, sf):
    name, course = F.col("name"), F.col("course")
    return derived(spark, sf, "names").select(
        "orderkey",
        "line",
        files.prepare_filename(name, course, course_prefix=True, date_prefix="20240501").alias("full_name"),
        files.prepare_filename(name, course, date_prefix="20240501").alias("dated"),
    )


_SAFE_PATH = choose(
    "l_partkey",
    "'/data/a_b_/' || l_partkey || '_.pdf'",
    "'rel/x_y/' || l_partkey",
    "'C:/in_out/' || l_partkey",
    "substr(repeat('n', 300) || l_partkey, 1, 251) || '.txt'",
    "'.'",
)


@query("sanitize_path", f"SELECT l_orderkey AS orderkey, l_linenumber AS line, {_SAFE_PATH} AS safe FROM lineitem")
def sanitize_path(spark, sf):
    return derived(spark, sf, "paths").select("orderkey", "line", files.sanitize_path(F.col("path")).alias("safe"))


_FOLDER = """CASE type WHEN 'lecture_video' THEN '/lectures/videos' WHEN 'lecture_slide' THEN '/lectures/slides'
    WHEN 'assignment' THEN '/assignments' WHEN 'reading' THEN '/readings' WHEN 'syllabus' THEN '' ELSE '/misc' END"""


@query(
    "target_dir",
    with_derived(
        ["catalog_files"],
        f"""SELECT seq, 'out/' || replace(course, ' ', '_') || {_FOLDER} AS full_dir, 'out' || {_FOLDER} AS by_type,
        'out/' || replace(course, ' ', '_') AS by_course, 'out' AS flat FROM catalog_files""",
    ),
)
def target_dir(spark, sf):
    out, kind, course = F.lit("out"), F.coalesce("type", F.lit("other")), F.col("course")
    return derived(spark, sf, "catalog_files").select(
        "seq",
        files.target_dir(out, kind, course).alias("full_dir"),
        files.target_dir(out, kind, course, by_course=False).alias("by_type"),
        files.target_dir(out, kind, course, by_type=False).alias("by_course"),
        files.target_dir(out, kind, course, flatten=True).alias("flat"),
    )


def _bytes_sql() -> str:
    cases = []
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB", "PB"]):
        step = f"CAST({1024**power} AS HUGEINT)"
        twice = f"((n % {step}) * 20)"
        tenth = f"(({twice}) // (2 * {step}))"
        left = f"({twice} - {tenth} * 2 * {step})"
        up = f"CASE WHEN {left} > {step} OR ({left} = {step} AND {tenth} % 2 = 1) THEN 1 ELSE 0 END"
        total = f"((n // {step}) * 10 + {tenth} + {up})"
        shown = f"CAST({total} // 10 AS VARCHAR) || '.' || CAST({total} % 10 AS VARCHAR) || ' {unit}'"
        cases.append(f"WHEN n < CAST({1024 ** (power + 1)} AS HUGEINT) THEN {shown}" if unit != "PB" else f"ELSE {shown}")
    return "CASE " + " ".join(cases) + " END"


@query("format_bytes", with_derived(["part_sizes"], f"SELECT id, n, {_bytes_sql()} AS shown FROM part_sizes"))
def format_bytes(spark, sf):
    return derived(spark, sf, "part_sizes").select("id", "n", text.format_bytes(F.col("n")).alias("shown"))


@query(
    "format_duration",
    with_derived(
        ["part_sizes"],
        """SELECT id, CASE WHEN s = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s >= 3600 THEN (s // 3600) || 'h' END,
        CASE WHEN (s % 3600) >= 60 THEN ((s % 3600) // 60) || 'm' END,
        CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) END AS shown
        FROM (SELECT id, CAST(floor(seconds) AS BIGINT) AS s FROM part_sizes)""",
    ),
)
def format_duration(spark, sf):
    return derived(spark, sf, "part_sizes").select("id", text.format_duration(F.col("seconds")).alias("shown"))


@query(
    "first_semester",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL
    ELSE CASE WHEN o_orderkey % 3 = 1 THEN 'SPRING' ELSE 'fall' END || '  ' || (2000 + o_orderkey % 50) END AS semester FROM orders""",
)
def first_semester(spark, sf):
    season = F.when(F.col("id") % 3 == 1, "in SPRING  ").when(F.col("id") % 3 == 2, "off fall  ").otherwise("spring of ")
    rows = derived(spark, sf, "part_sizes").select("id", F.concat(season, (F.col("id") % 50 + 2000).cast("string"), F.lit("/x")).alias("t"))
    return rows.select("id", text.first_semester(F.col("t")).alias("semester"))


_DATE = choose(
    "o_orderkey",
    "make_date(2023, 1 + o_orderkey % 12, 1 + o_orderkey % 28)",
    "make_date(2022, 1 + o_orderkey % 12, 1 + o_orderkey % 28)",
    "make_date(2021, 3, 1 + o_orderkey % 28)",
    "make_date(2020, 9, 1 + o_orderkey % 28)",
    "NULL",
    "NULL",
)


@query("find_date", f"SELECT o_orderkey AS id, strftime({_DATE}, '%Y-%m-%d') AS found FROM orders")
def find_date(spark, sf):
    found = F.date_format(text.find_date(F.col("text")), "yyyy-MM-dd")
    return derived(spark, sf, "dated_texts").select("id", found.alias("found"))


@query(
    "clean_js_object",
    """SELECT p_partkey AS id, '{"id": ' || p_partkey || ', "tags": ["x", "' || p_name || '"]}' AS cleaned,
    'x' AS first_tag FROM part""",
)
def clean_js_object(spark, sf):
    raw = F.concat(
        F.lit("{'id': "), F.col("p_partkey").cast("string"), F.lit(", tags: ['x', '"), F.col("p_name"), F.lit("', ],}")
    )
    raw = F.replace(raw, F.lit("'id'"), F.lit("id"))
    rows = given(spark, sf, "part").select(F.col("p_partkey").alias("id"), js.clean_js_object(raw).alias("cleaned"))
    tag = F.try_variant_get(F.try_parse_json("cleaned"), "$.tags[0]", "string")
    return rows.select("id", "cleaned", tag.alias("first_tag"))


@query("checksum_match", "SELECT doc_id, doc_id % 3 = 0 AS matches FROM documents")
def checksum_match(spark, sf):
    return derived(spark, sf, "contents").select(
        "doc_id", files.checksum_match(F.col("content"), F.col("etag")).alias("matches")
    )


@query("page_text", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def page_text(spark, sf):
    return given(spark, sf, "pages").select("page_id", text.page_text(F.col("html")).alias("text"))


_NO_TAGS = (
    """regexp_replace(html, '(?is)<!--.*?-->|<script(?:\\s[^>]*)?>(.*?)</script>|<style(?:\\s[^>]*)?>(.*?)</style>|<[a-z/!][^>]*>', '\\1\\2', 'g')"""
)


@query("text_content", f"SELECT page_id, trim({unescaped(_NO_TAGS)}) AS text FROM pages")
def text_content(spark, sf):
    return extract_text(given(spark, sf, "pages"))




@query(
    "extract_patterns",
    """WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages),
    m AS (SELECT page_id, 'the_words' AS field, regexp_extract_all(text, '(?i)(?:^|[^\\pL\\pN_])(the [a-z]+)', 1) AS vals FROM t
    UNION ALL SELECT page_id, 'capitals', regexp_extract_all(text, '(?i)(?:^|[^\\pL\\pN_])(of|in), [a-z]+', 1) FROM t)
    SELECT page_id, field, CAST(i - 1 AS INTEGER) AS pos, vals[i] AS value FROM m, unnest(range(1, len(vals) + 1)) AS u(i)""",
)
def patterns(spark, sf):
    return extract_patterns(
        given(spark, sf, "pages"), {"the_words": r"\bthe [a-z]+", "capitals": r"\b(of|in), [a-z]+"}
    )


_FOUND = r"""regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`\[\]]+')"""


@query(
    "src_urls_harvest",
    with_derived(
        ["linked_texts"], f"SELECT url, count(*) AS n FROM (SELECT unnest({_FOUND}) AS url FROM linked_texts) GROUP BY url"
    ),
)
def harvest(spark, sf):
    return readers.urls_harvest(derived(spark, sf, "linked_texts")).groupBy("url").agg(F.count("*").alias("n"))


@query("distinct_urls", f"SELECT DISTINCT {normalized('url')} AS url FROM pages")
def distinct_urls(spark, sf):
    return given(spark, sf, "pages").select(urls.normalize_url(F.col("url")).alias("url")).distinct()


@query(
    "urls_union",
    f"""WITH {PAGE_LINKS} SELECT {normalized('url')} AS url FROM pages UNION SELECT {normalized(ROOTED)} FROM links
    UNION SELECT {part('url', 1)} || '://' || {netloc('url')} || '/robots.txt' FROM pages""",
)
def union(spark, sf):
    pages = given(spark, sf, "pages")
    links = extract_links(pages).select(urls.normalize_url(F.col("link_url")))
    return urls_union(pages.select(urls.normalize_url(F.col("url"))), links, pages.select(urls.robots_url(F.col("url"))))


@query(
    "should_crawl",
    with_derived(
        ["file_urls"],
        f"""WITH n AS (SELECT DISTINCT {normalized('url')} AS url FROM file_urls
        WHERE NOT regexp_matches(lower({path('url')}), {_SKIP}))
        SELECT url FROM n WHERE url NOT IN (SELECT {normalized('url')} FROM file_urls WHERE orderkey % 3 = 0)
        AND url NOT IN (SELECT {normalized('url')} FROM file_urls WHERE orderkey % 3 = 1 AND line = 2)""",
    ),
)
def should(spark, sf):
    rows = derived(spark, sf, "file_urls")
    keyed = rows.select("orderkey", "line", urls.normalize_url(F.col("url")).alias("url"))
    return should_crawl(rows.select("url"), keyed.filter("orderkey % 3 = 0"), keyed.filter("orderkey % 3 = 1 AND line = 2"))

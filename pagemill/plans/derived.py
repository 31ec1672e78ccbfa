"""Inputs that the given tables lack, derived from them row by row.

The pages table holds no tables, forms, media, robots files or sitemaps. Each derived
input is a projection of one given table, so it grows with it. The expressions are plain
SQL that Spark and the checking database read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import spread

NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"


def template(text: str) -> str:
    """SQL expression for a text with ``[[expression]]`` parts."""
    parts = []
    for piece in re.split(r"(\[\[.*?\]\])", text, flags=re.S):
        if piece.startswith("[["):
            parts.append(f"CAST({piece[2:-2]} AS STRING)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def lines(*texts: str) -> str:
    """SQL expression for several template lines."""
    return "(" + " || chr(10) || ".join(template(t) if t else "''" for t in texts) + ")"


def choose(number: str, *options: str) -> str:
    """CASE over the remainder of a number; options are SQL expressions."""
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"CASE {number} % {len(options)} {cases} ELSE {options[-1]} END"


_COURSE_HTML = (
    "("
    + template(
        '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title> [[p_name]] &amp; notes </title>'
        '<meta name="description" content="All about [[p_name]] of type [[p_type]] for everyone">'
        '<meta name="keywords" content="">'
        '<meta property="og:title" content="old [[p_brand]]"><meta content=\'[[p_name]]\' property=\'og:title\'>'
        '<meta property="og:type" content="course"><meta name=twitter:card content=c[[p_partkey]]>'
        '<link rel="canonical" href="/courses/[[p_partkey]]"><link rel=alternate href="feed.xml?c=[[p_partkey]]#top">'
        '<link rel="stylesheet" href="/s.css">'
        '<script type="application/ld+json">{"id":[[p_partkey]],"name":"[[p_name]]"}</script>'
    )
    + " || CASE WHEN p_partkey % 3 = 0 THEN '<script type=\"application/ld+json\">{\"id\":</script>' ELSE '' END || "
    + template(
        "<script>window.__STATE__ = {'id': [[p_partkey]], 'tags': ['x', 'y',],};"
        'window.conf={"size":[[p_size]]};window.conf={"size":[[p_size + 1]]};window.bad={oops oops};'
        'fetch("/api/parts/[[p_partkey]]");load("/v1/list/[[p_partkey]].json");axios.get("/q/[[p_partkey]]");'
        'routes=[{path: "/r/[[p_partkey]]"},{"path": "/s"}];</script>'
    )
    + " || CASE WHEN p_partkey % 5 = 0 THEN '<noscript>Please enable JavaScript</noscript>' ELSE '' END"
    + " || '</head><body><!-- <a href=\"/hidden.pdf\">no</a> -->' || "
    + "CASE WHEN p_partkey % 4 <> 0 THEN "
    + template('<h1 class="course-title">  [[p_name]]   [[p_type]] </h1>')
    + " ELSE '' END || "
    + "CASE WHEN p_partkey % 2 = 0 THEN "
    + template('<span class="instructor">' + "<span>" * 12 + "[[p_brand]]" + "</span>" * 12 + "</span>")
    + " ELSE "
    + template("<strong>Instructor:</strong> <em>[[p_brand]]</em>")
    + " END || CASE WHEN p_partkey % 3 = 0 THEN "
    + template('<div class="term">Fall [[2000 + p_size]]</div>')
    + " ELSE "
    + template("<p>Offered in spring [[2000 + p_size]] again</p>")
    + " END || "
    + template(
        '<p class="description">short</p>'
        "<table><thead><tr><th>Week</th><th>Topic</th></tr></thead>"
        "<tbody><tr><td>1</td><td>[[p_type]]</td></tr><tr><td>[[p_size]]</td><td>a &lt; b</td></tr></tbody></table>"
        "<table><tr><th>Item<th>Price<th>Item</tr><tr><td>[[p_name]]<td>[[p_size]]<td>[[p_type]]<td> x </tr></table>"
        '<form action="/enrol/[[p_partkey]]" method=post id=f[[p_partkey]]><input name=q required value="[[p_size]]">'
        "<select name=s><option value=a>[[p_brand]]</option><option>Two</select><textarea name='t'>x</textarea></form>"
        '<ul><li><a href="/files/hw[[p_partkey]].pdf" title="Homework">Homework [[p_partkey]]</a></li>'
        '<li><a href="lec-[[p_partkey]].ppt" class="btn download">Lecture slides</a></li>'
        '<li><a download href="/x/y[[p_partkey]]">Data, set! [[p_size]]</a></li>'
        "<li><a href='mailto:a@b.c'>pdf by mail</a></li>"
        '<li><a href="../[[p_partkey + 1]]/index.html">Next</a></li>'
        '<li><a href="/files/hw[[p_partkey]].pdf">again</a></li></ul>'
        '<video src="/v/[[p_partkey]].mp4"></video><video><source src="alt.webm"></video>'
        '<audio src=/a/[[p_partkey]].mp3></audio><iframe src="https://www.youtube.com/embed/[[p_partkey]]"></iframe>'
        '<iframe src="https://maps.example/[[p_partkey]]"></iframe>'
        "<p><i></i>Office &#0072;ours: day [[p_size]]</p></body></html>"
    )
    + ")"
)

# What stands inside an item: the same tag many times over, as on real pages.
_DEEP = {
    "div": ("<div>" * 12, "</div>" * 12),
    "li": ("<ul><li>" * 12, "</li></ul>" * 12),
    "tr": ("<td>" + "<table><tr><td>" * 12, "</td></tr></table>" * 12 + "</td>"),
}

_ITEM = (
    '<{open}>{before}<b><a href="/courses/[[c_custkey]]{n}">{title} [[c_mktsegment]]</a></b>'
    '<span class="instructor">[[c_name]]</span><span class="term">Fall {year}</span>{behind}</{tag}>'
)


def _items(tag: str, cls: str) -> str:
    opened = f'{tag} class="{cls}"'
    before, behind = _DEEP[tag]
    return template(
        f"<html><body><nav><a href=\"/class\">All</a></nav><{ 'table' if tag == 'tr' else 'section' }>"
        + _ITEM.format(open=opened, tag=tag, n="-a", title="CS101", year=2024, before=before, behind=behind)
        + _ITEM.format(open=opened, tag=tag, n="", title="CS 102:", year=2025, before=before, behind=behind)
        + f"<{opened}>none</{tag}></{ 'table' if tag == 'tr' else 'section' }></body></html>"
    )


_CATALOG_HTML = choose(
    "c_custkey",
    _items("div", "course-item"),
    _items("li", "course"),
    _items("tr", "course-row"),
    template(
        '<html><body><a href="/courses/x[[c_custkey]]">MATH 2001 [[c_mktsegment]]</a>'
        '<a href="/contact">Contact</a><a href="/class/7">  </a></body></html>'
    ),
)

_ROBOTS = choose(
    "c_custkey",
    lines(
        "User-agent: badbot",
        "User-agent: worsebot",
        "Disallow: /",
        "Sitemap: http://c[[c_custkey]].example.edu/other.xml",
        "",
        "User-agent: *",
        "Allow: /a/ok # fine",
        "Disallow: /a",
        "Crawl-delay: [[c_custkey % 7]]",
        "Crawl-delay: soon",
        "Sitemap: http://c[[c_custkey]].example.edu/sitemap.xml",
    ),
    lines("# nothing here", "User-agent: *", "Disallow:", "Sitemap: /relative.xml"),
    lines("User-agent: *", "Disallow: /a", "Allow: /a/ok", "", "Disallow: /d", "crawl-delay: 2.5"),
    lines("Disallow: /early", "User-Agent: *", "Disallow: /caf%C3%A9", "Disallow: /b?x=1", "Allow: /b"),
)

_ROBOTS_PATH = choose(
    "o_orderkey", "'/a/ok/1'", "'/a/no'", "'/b?x=12'", "'/café/x'", "'/d/' || CAST(o_orderkey AS STRING)", "''"
)

_SITEMAP_BODY = choose(
    "c_custkey",
    template(
        f'<?xml version="1.0"?><urlset xmlns="{NAMESPACE}">'
        "<url><loc> http://c[[c_custkey]].example.edu/p?a=1&amp;b=2 </loc><lastmod>2024-01-0[[1 + c_nationkey % 9]]</lastmod>"
        "<changefreq>daily</changefreq><priority>0.5</priority></url>"
        "<url><loc>http://c[[c_custkey]].example.edu/q</loc><priority>high</priority></url>"
        "<url><lastmod>2024</lastmod></url></urlset>"
    ),
    template("<urlset><url><loc>http://c[[c_custkey]].example.edu/r</loc></url></urlset>"),
    template(
        f'<sitemapindex xmlns="{NAMESPACE}"><sitemap><loc>http://c[[c_custkey + 1]].example.edu/map</loc></sitemap>'
        "<sitemap><loc>http://c[[c_custkey - 2]].example.edu/map</loc></sitemap>"
        "<sitemap><loc>http://c[[c_custkey - 1]].example.edu/map</loc></sitemap></sitemapindex>"
    ),
    template(
        f'<sitemapindex xmlns="{NAMESPACE}"><sitemap><loc>http://c[[c_custkey - 1]].example.edu/map</loc></sitemap>'
        "</sitemapindex>"
    ),
)

_SITE_HTML = template(
    '<html lang="en"><head><title>Order [[o_orderkey]]</title><meta name="keywords" content="o[[o_orderkey]]">'
    '</head><body><a href="/o/[[o_orderkey * 2 + 1]]">left</a><a href="/o/[[o_orderkey * 2 + 2]]/">right</a>'
    '<a href="../o/[[CAST(floor(o_orderkey / 2) AS BIGINT)]]#up">up</a><a href="/O/[[(o_orderkey * 31 + 17) % 1000]]">side</a>'
    '<a href="/f[[o_orderkey]].pdf">file</a><a href="/private/[[o_orderkey % 3]]">staff</a></body></html>'
)

# name -> (given table, {column: SQL expression})
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "course_pages": (
        "part",
        {
            "page_id": "p_partkey",
            "url": template("http://www.b[[replace(p_brand, 'Brand#', '')]].example.edu/courses/[[p_partkey]]/index.html"),
            "html": _COURSE_HTML,
        },
    ),
    "catalog_pages": (
        "customer",
        {
            "page_id": "c_custkey",
            "url": template("http://c[[c_custkey]].example.edu")
            + " || "
            + choose("c_custkey", "'/courses'", "'/catalog'", "''", "'/course-list'"),
            "html": _CATALOG_HTML,
        },
    ),
    "robots": ("customer", {"host": template("c[[c_custkey]].example.edu"), "body": _ROBOTS}),
    "robots_urls": (
        "orders",
        {
            "url_id": "o_orderkey",
            "url": "CASE WHEN o_orderkey % 3 = 0 THEN "
            + template("http://C[[o_custkey]].Example.EDU")
            + " ELSE "
            + template("http://c[[o_custkey]].example.edu")
            + f" END || {_ROBOTS_PATH}",
        },
    ),
    "sitemaps": (
        "customer",
        {
            "url": template("http://c[[c_custkey]].example.edu/map"),
            "content_type": choose("c_custkey", "'application/xml'", "NULL", "'text/xml'", "'text/plain'"),
            "body": _SITEMAP_BODY,
        },
    ),
    "captured_maps": (
        "customer",
        {
            "url": template("https://c[[c_custkey]].example.edu")
            + " || "
            + choose("c_custkey", "'/sitemap.xml'", "'/sitemap/'", "'/map.xml'"),
        },
    ),
    "sites": ("customer", {"url": template("http://c[[c_custkey]].example.edu")}),
    "secure_sites": ("customer", {"url": template("https://c[[c_custkey]].example.edu/home?x=1")}),
    "site_pages": (
        "orders",
        {
            "page_id": "o_orderkey",
            "url": template("http://shop.example.com/o/[[o_orderkey]]"),
            "html": _SITE_HTML,
        },
    ),
    "references": (
        "orders",
        {
            "ref_id": "o_orderkey",
            "base": template("HTTP://h[[o_custkey]].example.com/a/b[[o_orderkey % 10]]/c;p?q=1#f"),
            "href": choose(
                "o_orderkey",
                template("x[[o_orderkey]]"),
                template("../x[[o_orderkey]]?y=1"),
                template("/r/./s/../[[o_orderkey]]"),
                template("//o.example/[[o_orderkey]]"),
                template("?k=[[o_orderkey]]"),
                template("#s[[o_orderkey]]"),
                "''",
                template("mailto:m[[o_orderkey]]@x.y"),
                template("https://z.example/[[o_orderkey]]/../w#"),
                template("../../../up[[o_orderkey]]"),
                template("./"),
                template(" t[[o_orderkey]];v"),
            ),
        },
    ),
    "course_urls": (
        "orders",
        {
            "url_id": "o_orderkey",
            "url": template("https://u[[o_custkey]].example.edu")
            + " || "
            + choose(
                "o_orderkey",
                template("/x/CS[[100 + o_orderkey % 900]]/home?b=&id=7"),
                template("/course-[[o_orderkey]]/"),
                template("/list?id=[[o_orderkey]]&id=2&name=a%20b+c"),
                template("/p/?cid=c[[o_orderkey]]&course="),
                template("/Some-Thing/[[o_orderkey]]"),
                template("/9lives;x=[[o_orderkey]]"),
                "''",
            ),
            "name": choose("o_orderkey", template("CS 101: no [[o_orderkey]]"), template("Ünïon & co [[o_orderkey]]"), template("MATH2001 x")),
        },
    ),
    "file_urls": (
        "lineitem",
        {
            "orderkey": "l_orderkey",
            "line": "l_linenumber",
            "url": template("http://s[[l_suppkey]].example.com")
            + " || "
            + choose(
                "l_partkey",
                template("/files/p[[l_partkey]].pdf"),
                template("/v/rec%20[[l_partkey]].MP4"),
                template("/week[[l_linenumber]]/notes-[[l_partkey]]"),
                template("/docs/hw[[l_partkey]].docx?x=1"),
                template("/a+b/[[l_partkey]].tar.gz"),
                template("/syllabus/[[l_partkey]]/"),
                template("/media/[[l_partkey]]"),
                template("/read/[[l_partkey]].epub"),
                template("/p/[[l_partkey]].html"),
            ),
            "text": choose(
                "l_linenumber", "'Lecture slides!'", "'Watch the recording'", "''", "'Reading  list'", "'Go – here'"
            ),
            "download": choose("l_orderkey", "NULL", "'my file.zip'", "NULL", "''", "NULL"),
        },
    ),
    "names": (
        "lineitem",
        {
            "orderkey": "l_orderkey",
            "line": "l_linenumber",
            "name": choose(
                "l_partkey",
                template('a<b>:c?[[l_partkey]].pdf'),
                template("  my  notes__[[l_partkey]] . "),
                template("..x/y[[l_partkey]].tar.gz"),
                template("[[repeat('long ', 60)]][[l_partkey]].txt"),
                "''",
                template("[[l_partkey]]."),
                template("20240131_[[l_partkey]].md"),
            ),
            "course": template("Course: [[l_suppkey]]/advanced topics in things"),
        },
    ),
    "paths": (
        "lineitem",
        {
            "orderkey": "l_orderkey",
            "line": "l_linenumber",
            "path": choose(
                "l_partkey",
                template("/data/a<b>/[[l_partkey]]?.pdf"),
                template("rel//x|y/./[[l_partkey]]"),
                template("C:/in:out/[[l_partkey]]"),
                template("[[repeat('n', 300)]][[l_partkey]].txt"),
                "''",
            ),
        },
    ),
    "fetch_log": (
        "events",
        {
            "request_id": "event_id",
            "domain": template("u[[user_id]]"),
            "ts": "ts",
            "ok": "event_type <> 'error'",
            "latency": "value",
            "bytes": "CAST(floor(value * 100) AS BIGINT)",
        },
    ),
    "heartbeats": (
        "events",
        {
            "worker_id": "user_id",
            "ts": "ts",
            "status": "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'busy' WHEN 'view' THEN 'busy' ELSE 'idle' END",
        },
    ),
    "tasks": (
        "orders",
        {
            "task_id": "o_orderkey",
            "batch_id": "o_custkey % 10",
            "url": template("http://c[[o_custkey]].example.edu/t/[[o_orderkey]]"),
            "priority": "6 - CAST(substr(o_orderpriority, 1, 1) AS INT)",
            "seq": "o_orderkey",
            "status": "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'failed' "
            "WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'pending' END",
            "error": "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 <> 0 THEN "
            + template("HTTP [[400 + o_orderkey % 9]]")
            + " END",
            "files": "o_orderkey % 7",
            "bytes": "CAST(floor(o_totalprice) AS BIGINT)",
            "started_at": "o_orderdate",
            "completed_at": "CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + INTERVAL '90' SECOND END",
        },
    ),
    "course_links": (
        "orders",
        {
            "course_url": template("http://c[[o_custkey]].example.edu/"),
            "url": template("http://c[[o_custkey]].example.edu/f/[[o_orderkey]].pdf"),
        },
    ),
    "outcomes": (
        "orders",
        {
            "url": template("http://c[[o_custkey]].example.edu/f/[[o_orderkey]].pdf"),
            "success": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus <> 'F' END",
            "error": "CASE WHEN o_orderkey % 5 <> 0 AND o_orderstatus = 'F' THEN "
            + template("HTTP [[500 + o_orderkey % 3]]")
            + " END",
            "download_time": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 64 AS DOUBLE) / 8 END",
        },
    ),
    "downloads": (
        "lineitem",
        {
            "name": template("f[[l_orderkey]]-[[l_linenumber]]-[[l_partkey]].pdf"),
            "success": "l_returnflag <> 'R'",
            "error": "CASE WHEN l_returnflag = 'R' THEN " + template("HTTP [[400 + l_linenumber]]") + " END",
            "bytes": "CAST(floor(l_extendedprice) AS BIGINT)",
            "download_time": "l_quantity / 8.0",
        },
    ),
    "catalog_files": (
        "orders",
        {
            "seq": "o_orderkey",
            "course": template("Course [[o_custkey % 50]]"),
            "dir": template("d[[o_custkey % 20]]"),
            "type": choose("o_custkey", "'lecture_video'", "'lecture_slide'", "'assignment'", "'syllabus'", "'other'", "'reading'", "NULL"),
            "name": choose(
                "o_orderkey",
                "'index.html'",
                template("notes-[[o_orderkey % 40]].PDF"),
                "'.hidden'",
                "'README.md'",
                template("notes-[[o_orderkey % 40]]_[[1 + o_orderkey % 3]].PDF"),
                template("x[[o_orderkey % 30]]"),
                "'index_2.html'",
            ),
            "mtime": "o_orderdate",
        },
    ),
    "part_sizes": (
        "orders",
        {
            "id": "o_orderkey",
            "n": choose(
                "o_orderkey",
                "o_orderkey",
                "1024 * (o_orderkey % 999) + 256",
                "CAST(floor(o_totalprice * 1000) AS BIGINT)",
                "CAST(floor(o_totalprice) AS BIGINT) * 1048576",
                "(o_orderkey % 4000) * 1125899906842624",
            ),
            "seconds": "floor(o_totalprice) / 4",
        },
    ),
    "dated_texts": (
        "orders",
        {
            "id": "o_orderkey",
            "text": choose(
                "o_orderkey",
                template("Due [[1 + o_orderkey % 12]]/[[1 + o_orderkey % 28]]/2023 at noon"),
                template("posted 2022-[[lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0')]]-[[lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')]]"),
                template("from [[1 + o_orderkey % 28]] mar 2021 on"),
                template("since Sep [[1 + o_orderkey % 28]], 2020"),
                template("no date [[o_orderkey]]"),
                template("bad 2022-13-45"),
            ),
        },
    ),
    "contents": (
        "documents",
        {
            "doc_id": "doc_id",
            "content": "text",
            "etag": "CASE WHEN doc_id % 3 = 0 THEN chr(34) || upper(md5(text)) || chr(34) ELSE md5(lang) END",
        },
    ),
    "linked_texts": (
        "documents",
        {
            "doc_id": "doc_id",
            "text": "text || "
            + template(" see https://d[[doc_id]].example.org/[[lang]]?q=1 (or http://x.example/[[n_chars]]) <http://y.example/a|b> ")
            + " || text",
        },
    ),
    "dated_pages": (
        "orders",
        {
            "page_id": "o_orderkey",
            "url": "'http://d.example.edu/'",
            "html": template(
                '<p>Since 1 Jan 2020</p><ul><li>Due 2022-03-0[[1 + o_orderkey % 9]] <b></b><a href="/f/[[o_orderkey]].pdf">Notes</a></li>'
                '<li><p>Week 3/14/2023: <a href="x.zip" download>zip</a></p> 1 Feb 2020</li>'
                '<li><a href="/g/[[o_orderkey]].doc">no date</a></li>'
                '<li><a href="/h/[[o_orderkey]].ppt">Slides</a> of <i>Nov&#32;5, 2021</i></li></ul>'
            ),
        },
    ),
    "js_pages": (
        "orders",
        {
            "page_id": "o_orderkey",
            "html": choose(
                "o_orderkey",
                template("<div id=\"root\"></div><script src=\"/bundle.js\"></script><script>ReactDOM.render([[o_orderkey]])</script>"),
                template("<p onclick=\"f()\">[[repeat('word ', 40)]]</p>"),
                template("<script>new Vue({el: '#app'}); route: '/o/[[o_orderkey]]'; new VueRouter({path: \"/v\"})</script>"),
                template("<script>var x = new XMLHttpRequest(); x.open('GET', '/data/[[o_orderkey]]'); window.__INITIAL_DATA__ = 1</script>"),
            ),
        },
    ),
}


def derived_sql(name: str) -> str:
    """The SELECT statement of a derived input."""
    table, columns = DERIVED[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table}"


def with_derived(names: list[str], query: str) -> str:
    """``query`` with derived inputs put before it."""
    ctes = ", ".join(f"{n} AS ({derived_sql(n)})" for n in names)
    body = query.strip()
    for start in ("WITH RECURSIVE", "WITH"):
        if body.startswith(start):
            return f"{start} {ctes}, {body[len(start):].strip()}"
    return f"WITH {ctes} {body}"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("pages", "documents") else rows


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = DERIVED[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    # Only the columns in use are dealt out, the text is made afterwards.
    rows = spread(rows, narrow=table != "documents")
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

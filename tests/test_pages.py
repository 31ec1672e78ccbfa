import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions.rules import css_rule, numbers_inside, select, select_all, select_elements, staged
from pagemill.operators import courses, links, pages as page_ops, scrape, tables

PAGE = """<html lang="en"><head><title> A &amp; B </title><meta name="description" content="A long description of the course">
<meta property="og:title" content="T1"><meta property="og:title" content='T2'><meta name=twitter:card content=sum>
<link rel="canonical" href="/c/1"><link rel=alternate href=/f.xml></head>
<body><!-- <a href="/no.pdf">x</a> --><script>var a='<a href="/no2.pdf">';</script>
<h1 class="course-title"> CS101   Intro </h1><span class="instructor">Dr X</span><strong>Semester:</strong> <em>Fall 2024</em>
<table><tr><th>Week<th>Topic</tr><tr><td>1<td>Intro<td>extra</tr></table>
<table><thead><tr><th>A</th><th>A</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>
<form action=/s method=post id=f><input name=q required><select name=k><option value=1>One<option value=2 selected>Two</select><textarea name=t>hi</textarea></form>
<a href="/files/hw1.pdf" title="HW">Homework 1</a><a href=lec.ppt class="download"></a><a download href="/x/y">z</a><a href="mailto:a@b">pdf mail</a><a href="/courses/cs-1">C</a>
<video src=/v/a.mp4></video><video><source src="b.webm"></video><audio src=c.mp3></audio><iframe src="https://www.youtube.com/embed/1"></iframe>
<div class="course-item"><div><a href="/courses/cs-102">CS102 Data</a></div><span class="instructor">Y</span><span class=term>Fall</span></div><div class="course-item">none</div>
</body></html>"""
URL = "http://u.edu/c/index.html"


def test_metadata(pages):
    row = page_ops.extract_metadata(pages((URL, PAGE))).first()
    assert row.title == "A & B" and row.language == "en" and row.canonical_url == "/c/1"
    assert row.meta == {"description": "A long description of the course", "og:title": "T2", "twitter:card": "sum"}
    assert row.open_graph == {"title": "T2"} and row.twitter_card == {"card": "sum"}


def test_links_and_edges(pages):
    rows = links.extract_links(pages((URL, PAGE))).orderBy("pos").collect()
    assert [r.link_url for r in rows] == [
        "http://u.edu/files/hw1.pdf", "http://u.edu/c/lec.ppt", "http://u.edu/x/y", "mailto:a@b",
        "http://u.edu/courses/cs-1", "http://u.edu/courses/cs-102",
    ]
    assert (rows[0].text, rows[0].title, rows[2].download) == ("Homework 1", "HW", "")
    edges = {r.dst for r in links.extract_edges(pages((URL, PAGE))).collect()}
    assert edges == {
        "http://u.edu/c/lec.ppt", "http://u.edu/x/y", "http://u.edu/courses/cs-1", "http://u.edu/courses/cs-102",
        "http://u.edu/c/1", "http://u.edu/f.xml",
    }


def test_base_element(pages):
    page = '<base href="/deep/"><a href="x">1</a>'
    got = links.extract_links(pages((URL, page))).first()
    plain = links.extract_links(pages((URL, page)), use_base=False).first()
    assert (got.link_url, plain.link_url) == ("http://u.edu/deep/x", "http://u.edu/c/x")


def test_tables(pages):
    rows = tables.extract_tables(pages((URL, PAGE))).orderBy("table_no", "row_no").collect()
    assert [r.cells for r in rows] == [{"Week": "1", "Topic": "Intro", "column_2": "extra"}, {"A": "2"}, {"A": "3"}]


def test_forms(pages):
    row = tables.extract_forms(pages((URL, PAGE))).first()
    assert (row.action, row.method, row.id) == ("/s", "POST", "f")
    assert [(f.name, f.type, f.required) for f in row.fields] == [("q", "text", True), ("k", "text", False), ("t", "text", False)]
    assert [tuple(o) for o in row.fields[1].options] == [("1", "One"), ("2", "Two")]


def test_course_page(pages):
    row = courses.course_page(pages((URL, PAGE))).first()
    assert (row.name, row.instructor, row.semester) == ("CS101 Intro", "Dr X Y", "Fall")
    assert row.description == "A long description of the course"
    bare = courses.course_page(pages((URL, "<p>Given in Summer 2021</p>"))).first()
    assert (bare.name, bare.instructor, bare.semester) == ("Unknown Course", None, "Summer 2021")


def test_course_files(pages):
    rows = courses.course_files(pages((URL, PAGE))).collect()
    linked = [(r.name, r.type) for r in rows if r.source == "link"]
    assert linked == [("hw1.pdf", "lecture_slide"), ("lec.ppt", "lecture_slide"), ("z", "other")]
    media = [(r.source, r.file_url) for r in rows if r.source != "link"]
    assert media == [
        ("video", "http://u.edu/v/a.mp4"), ("video", "http://u.edu/c/b.webm"),
        ("audio", "http://u.edu/c/c.mp3"), ("iframe", "https://www.youtube.com/embed/1"),
    ]


def test_course_materials_and_catalog(pages):
    rows = courses.course_materials(pages((URL, PAGE)), {"extra": '//a[contains(@href, "courses")]'}).collect()
    assert sorted((r.rule_no, r.name) for r in rows) == [(0, "Homework 1"), (2, "lec.ppt"), (4, "z"), (5, "C"), (5, "CS102 Data")]
    row = courses.course_catalog(pages((URL, PAGE))).collect()
    assert [(r.id, r.name, r.instructor, r.semester) for r in row] == [("cs-102", "CS102 Data", "Y", "Fall")]


def test_rules(pages, spark):
    page = (
        '<title>T</title><h1 class="course-title">A</h1><p class="x office">B</p><h1>A</h1><p>Office Hours: 9</p>'
        "<section><div>Instructor:</div><b>Q<i>no</i></b><br><u>R</u></section><s>out</s>"
    )
    df, one = staged(spark.createDataFrame([(page,)], "html string"))
    found = lambda rule, kind="text": df.select(select(one, rule, kind)).first()[0]
    assert found('//h1[@class="course-title"] | //h1 | //title') == ["T", "A", "A"]
    assert found('//*[contains(text(), "Office Hours")] | //*[contains(@class, "office")]') == ["B", "Office Hours: 9"]
    assert found('//*[contains(text(), "Instructor:")]/following-sibling::*/text()') == ["Q", "R"]
    assert found("//h1[2]/text()") == ["A"]
    assert found("//h1/@class") == ["course-title"]
    assert found("//b", "html") == ["<b>Q<i>no</i>"]


def test_rule_steps(spark):
    page = (
        "<ul><li>a</li><li>b</li></ul><ul><li>c<li>d</ul><div><a href='1'>1</a><p><a href='2'>2</a></p></div>"
        "<p><b>x</b>Professor Y</p><p>Q&amp;A</p><a href='x&#46;pdf' Class=k>f</a>"
    )
    df, one = staged(spark.createDataFrame([(page,)], "html string"))
    found = lambda rule, kind="text": df.select(select(one, rule, kind)).first()[0]
    assert found("//li[1]") == ["a", "c"]
    assert found("//div/a") == ["1"] and found("//div//a") == ["1", "2"]
    assert found('//*[contains(text(), "Professor")]') == ["xProfessor Y"]
    assert found('//p[contains(text(), "Q&A")]') == ["Q&A"]
    assert found('//a[contains(@href, ".pdf")]/@class') == ["k"]
    assert found('//a[@href][2]') == [] and found('//li[@x or contains(text(), "")][2][1]') == ["b", "d"]
    everything = df.select(select_all(one, '//a[@class]')).first()[0][0]
    assert everything.attributes == {"href": "x.pdf", "class": "k"} and everything.text == "f"
    single = page_ops.extract_single(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"),
                                     {"one": "//li", "none": "//h6"}, {"none": "-"}).first()
    assert (single.one, single.none) == ("a", "-")


@pytest.mark.parametrize("depth", [4, 200])
def test_any_depth(pages, depth):
    inner = "<div>" * depth + "a long enough description text here" + "</div>" * depth
    row = courses.course_page(pages((URL, f'<div class="course-description">a {inner}</div><div>no</div>'))).first()
    assert row.description is None or "long enough" in row.description
    deep = f'<div class="course-item">{"<div>" * depth}<a href="/c/CS1">CS1</a><i class="instructor">I</i>{"</div>" * depth}</div>'
    (course,) = courses.course_catalog(pages((URL, deep))).collect()
    assert (course.name, course.instructor) == ("CS1", "I")
    table = "<table>" + "<tr><td><table>" * depth + "<tr><td>i</td></tr>" + "</table></td></tr>" * depth + "<tr><td>last</td></tr></table>"
    rows = tables.extract_tables(pages((URL, table))).filter("table_no = 0").collect()
    assert "last" in str(rows[-1].cells)


def test_tables_by_rules(pages):
    page = "<div class=t><p class=h>A</p><p class=h>B</p><section><td>1</td><td>2</td></section></div>"
    rows = tables.extract_tables(pages((URL, page)), "//div[@class='t']", "//p[@class='h']", "//section").collect()
    assert [r.cells for r in rows] == [{"A": "1", "B": "2"}]


def test_css_rules():
    assert css_rule("div.course-item > a") == '//div[contains(@class, "course-item")]/a'
    assert css_rule("#f input") == '//*[@id="f"]//input'


def test_scrape_keeps_failures(pages):
    rows = scrape.scrape_page(pages((URL, PAGE), (URL, "")), {"heading": "//h1"}).orderBy("page_id").collect()
    assert rows[0].heading == ["CS101   Intro"] and len(rows[0].links) == 6 and rows[0].error is None
    assert rows[1].error == "empty page" and rows[1].links is None


def test_patterns(pages):
    rows = page_ops.extract_patterns(pages((URL, "<b>Room</b>1 room2")), {"room": r"room\s*(\d)"}, group=1).collect()
    assert [r.value for r in rows] == ["1", "2"]
    page = pages((URL, "<b>Room 12 was ÉTÉ</b>"))
    rows = page_ops.extract_patterns(page, {"one": r"room (\d+)", "none": "été", "two": r"(room) (\d)"}).collect()
    assert {r.field: r.value for r in rows} == {"one": "12", "none": "ÉTÉ", "two": '["Room","1"]'}


def test_blank_link_text_gives_no_file(pages):
    rows = courses.linked_files(pages((URL, '<a href="/f" download> </a><a href="/g" download></a><a href="/h.pdf"> </a>'))).collect()
    assert [r.file_url for r in rows] == ["http://u.edu/g", "http://u.edu/h.pdf"]


def test_long_pages_do_not_overflow(pages):
    page = "<div>" + "<p>x" * 50_000 + "<a href='/last'>l</a>" + " a=b" * 50_000
    assert links.extract_links(pages((URL, page))).first().link_url == "http://u.edu/last"
    rows = "<table>" + "<tr><td>1<td>2" * 5_000 + "</table>"
    assert tables.extract_tables(pages((URL, rows))).count() == 4_999


def test_link_plan_reads_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = links.extract_edges(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dates_of_the_links_parent(pages):
    page = (
        "<p>1 Jan 2020</p><ul><li>Due 2022-03-04 <a href='/a.pdf'>A</a> <a href='/b.pdf'>B</a></li>"
        "<li><b><a href='/c.pdf'>C 2021-01-02</a></b> 2019-09-09</li><li><a href='/d.pdf'>D</a></li></ul><a href='/e.pdf'>E</a>"
    )
    rows = courses.course_files(pages((URL, page), (URL, None)), strict=False).orderBy("pos").collect()
    assert [(r.name, str(r.file_date)) for r in rows] == [
        ("a.pdf", "2022-03-04"), ("b.pdf", "2022-03-04"), ("c.pdf", "2021-01-02"), ("d.pdf", "None"), ("e.pdf", "None"),
    ]
    assert {r.file_date for r in courses.course_files(pages((URL, page))).collect()} == {None}


def plain_inside(rows, steps):
    """What path steps find, by looking at every pair of elements."""
    now = None
    for axis, test in steps:
        here = [e for e in rows if test(e)]
        if now is None:
            now = here if axis == "//" else [e for e in here if e["parent"] == -1]
            continue
        near = (lambda e, a: a["no"] < e["no"] <= a["last"]) if axis == "//" else (lambda e, a: e["parent"] == a["no"])
        now = [e for e in here if any(near(e, a) for a in now)]
    return [e["no"] for e in now]


def test_steps_equal_plain_pairs(spark):
    dice = random.Random(3)
    bits = ["<div>", "</div>", "<p>", "</p>", "<ul><li>", "</li>", "</ul>", "<a class=k href=x>", "</a>", "<b>t</b>", "<table><tr><td>", "</table>"]
    made = ["".join(dice.choice(bits) for _ in range(dice.randint(0, 40))) for _ in range(60)] + [None, ""]
    df, page = staged(spark.createDataFrame([(n, h) for n, h in enumerate(made)], "n int, html string"), "n")
    paths = ["//div//a", "//div/a", "/div//p/b", "//ul//li//a[@href]", "//div//div//div", "/p", "//li/a[@class][1]"]
    outers = select_elements(page, "//ul")
    found = df.select(
        "_all",
        *[F.transform(select_elements(page, r), lambda e: e["no"]).alias(f"p{i}") for i, r in enumerate(paths[:-1])],
        F.transform(outers, lambda e: e["no"]).alias("outers"),
        numbers_inside(page, outers, "//div//a | //b").alias("each"),
        numbers_inside(page, outers, "//a", first=True).alias("first"),
    ).collect()
    tag = lambda *names: lambda e: e["tag"] in names
    plain = [
        [("//", tag("div")), ("//", tag("a"))], [("//", tag("div")), ("/", tag("a"))], [("/", tag("div")), ("//", tag("p")), ("/", tag("b"))],
        [("//", tag("ul")), ("//", tag("li")), ("//", tag("a"))], [("//", tag("div"))] * 3, [("/", tag("p"))],
    ]
    for row in found:
        rows = [e.asDict() for e in row["_all"]]
        for i, steps in enumerate(plain):
            assert row[f"p{i}"] == plain_inside(rows, steps)
        for no, each, first in zip(row.outers, row.each, row.first):
            inner = [e for e in rows if no < e["no"] <= rows[no]["last"]]
            both = plain_inside(inner, [("//", tag("div")), ("//", tag("a"))]) + plain_inside(inner, [("//", tag("b"))])
            assert each == sorted(both)
            assert first == next((e["no"] for e in inner if e["tag"] == "a"), -1)


def test_rules_are_linear_in_the_page(pages):
    def seconds(n):
        page = "<div class=course-item>" + "".join(f"<p>é</p><div><a class=download href='/{i}.pdf'>{i}</a></div>" for i in range(n)) + "</div>"
        rows = pages((URL, page))
        started = time.perf_counter()
        assert len(page_ops.extract_rules(rows, {"x": "//div//a"}).first().x) == n
        assert courses.course_materials(rows).count() == n
        return time.perf_counter() - started

    seconds(100)
    few = seconds(1000)
    assert seconds(16_000) < 20 * few


def test_nested_tables_count_on_their_own_and_for_the_outer_one(pages):
    page = "<table><tr><th>A<tr><td>1 <table><tr><th>B<tr><td>2</table></table>"
    rows = tables.extract_tables(pages((URL, page))).orderBy("table_no", "row_no").collect()
    assert [r.cells for r in rows if r.table_no == 1] == [{"B": "2"}]
    assert {"A", "B"} & set(rows[0].cells) and rows[0].table_no == 0


def test_what_is_exploded_is_found_once(spark, pages):
    """No size test on the exploded array is inferred: at the scan it would find links and tags a second time."""
    from pagemill.operators import courses, links, tables
    from pagemill.operators import pages as page_facts
    from pagemill.plans import page_queries

    frame = pages(("http://a.example/", '<a href="/x.pdf">x</a><script>fetch("/q")</script>'), ("http://b.example/", None))
    rows = [links.extract_edges(frame), links.extract_links(frame), courses.linked_files(frame), courses.media_files(frame)]
    rows += [page_facts.ajax_endpoints(frame), page_facts.extract_jsonld(frame), page_facts.extract_window_vars(frame)]
    rows += [tables.extract_tables(frame), page_queries.meta_prefix(spark, "/root/testdata/sf0.001")]
    for found in rows:
        assert "Filter ((size(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.link_url for r in rows[1].collect()] == ["http://a.example/x.pdf"]
    assert [r.name for r in rows[2].collect()] == ["x.pdf"]


def test_paths_of_a_page_are_followed_at_once(pages):
    """Pages wait with all their elements for every Python function, so there is one for all paths of all rules."""
    from pagemill.operators import courses
    from pagemill.operators.pages import extract_rules

    html = '<ul><li><a href="/a">A</a></li></ul><div><p>x</p></div><div class="course-item"><a href="/courses/1">B</a></div>'
    frame = pages(("http://a.example/", html), ("http://b.example/", None))
    rules = {"links": "//li/a", "texts": "//div/p | //ul//a", "none": "//p//a", "single": "//p"}
    found, listed = extract_rules(frame, rules), courses.course_catalog(frame)
    for rows in (found, listed):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2
    assert [tuple(r)[2:] for r in found.orderBy("page_id").collect()] == [(["A"], ["A", "x"], [], ["x"]), ([], [], [], [])]
    assert [(r.name, r.instructor) for r in listed.collect()] == [("B", None)]


PATHS = {
    "links": "//li/a",
    "again": "//li/a",
    "both": "//div/p | //title | //ul//a | //li/a",
    "attributes": "//ul//a/@href | //title/text()",
    "own": "//ul/li/text()",
    "texts": "//ul//li//text()",
    "after": "//ul/li[1]/following-sibling::*/text()",
    "top": "/ul/li",
    "none": "//p//a",
    "url": "//p",
}


def _waiting(rows) -> str:
    """The schema of what waits for the last Python function of a plan."""
    nodes = [rows._jdf.queryExecution().optimizedPlan()]
    while "ArrowEvalPython" not in nodes[0].nodeName():
        nodes = [*[nodes[0].children().apply(i) for i in range(nodes[0].children().size())], *nodes[1:]]
    return nodes[0].children().apply(0).schema().json()


@pytest.mark.parametrize("kind", ["text", "html", "all"])
def test_paths_of_slim_pages_find_what_whole_pages_have(pages, kind):
    html = '<title>T &amp; t</title><ul><li>1<li><a href="/a">A<b>c</b></a> 2<li>x &lt; y<ul><li><a>B</a></ul></ul><div><p>x</p><p>z</div>'
    frame = pages((URL, html), (URL, None), (URL, "<ul><li><a href=/q>Q</a></ul>"))
    rows, page = staged(frame, "page_id")
    read = select_all if kind == "all" else lambda p, rule: select(p, rule, kind)
    expected = rows.select("page_id", *[read(page, rule).alias(f"x{i}") for i, rule in enumerate(PATHS.values())])
    found = page_ops.extract_rules(frame, PATHS, kind)
    plain = [[r[0], *r[2:]] for r in found.orderBy("page_id").collect()]
    assert plain == [list(r) for r in expected.orderBy("page_id").collect()]
    assert len(plain[0][3]) == 5 and plain[2][1] and not plain[1][1]


def test_pages_wait_for_paths_without_their_elements(pages):
    """What waits for a Python function is on disk if memory is short, so it is not the whole page with all its elements."""
    frame = pages((URL, "<ul><li><a href=/a>A</a></ul>"))
    for field in ("nth_any", "attrs", "html"):
        assert f'"{field}"' not in _waiting(page_ops.extract_rules(frame, {"heading": "//h1", "third": "//ul/li[3]/a", "p": "//p/@id"}))


def test_course_pages_wait_for_the_path_of_a_name_without_their_elements(pages):
    frame = pages((URL, "<div class=course-header><b><h1> N </h1></b></div><title>T</title>"), (URL, "<title>T</title>"), (URL, None))
    found = courses.course_page(frame)
    for field in ("nth_any", "attrs", "html", "_chunks"):
        assert f'"{field}"' not in _waiting(found)
    assert [r.name for r in found.orderBy("page_id").collect()] == ["N", "T", "Unknown Course"]

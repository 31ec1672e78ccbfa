from pyspark.sql import functions as F

from pagemill.functions import html, js, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def shown(size):
    for unit in ["B", "KB", "MB", "GB", "TB"]:
        if size < 1024.0:
            return f"{size:.1f} {unit}"
        size /= 1024.0
    return f"{size:.1f} PB"


def test_format_bytes(spark):
    sizes = [0, 1023, 1024, 1280, 1536, 1792, 1048575, 1048576, 1310720, 10**9, 10**12, 10**15, 2**60, 5 * 10**17]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(text.format_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == [shown(n) for n in sizes]


def test_format_duration(spark):
    cases = {0.0: "0s", 45.9: "45s", 3600.0: "1h", 5445.0: "1h 30m 45s", 3601.5: "1h 1s", 120.0: "2m"}
    got = spark.createDataFrame([(s,) for s in cases], "s double").select(text.format_duration(F.col("s"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_find_date(spark):
    cases = {"x 3/14/2024": "2024-03-14", "2024-02-30 or 5 mar 2023": "2023-03-05", "Jan 5, 2022": "2022-01-05", "none": None}
    got = spark.createDataFrame([(s,) for s in cases], "s string").select(text.find_date(F.col("s")).cast("string")).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_text_content(spark):
    page = 'a &amp; b &lt;&#8211;&#x2014; &nope; &copy;<script>var t="</p>";</script><!-- c --> <p title="a>b">z</p> 1 < 2 &#0;'
    assert one(spark, page, text.text_content) == 'a & b <–— &nope; ©var t="</p>"; z 1 < 2 &#0;'


def test_attributes(spark):
    cases = [
        ('<a href="x&amp;y" class=k>T <b>b</b>', "x&y", False, "T b"),
        ("<a title=\"see href=no\" href='q'>", "q", False, ""),
        ("<a HREF=/a/b download>x", "/a/b", True, "x"),
        ('<a href="">', "", False, ""),
        ("<a href>", None, False, ""),
        ('<a x=1 data-href=no href = "y">', "y", False, ""),
    ]
    e = F.col("e")
    got = spark.createDataFrame([(c[0],) for c in cases], "e string").select(
        html.attr(e, "href"), html.has_attr(e, "download"), html.element_text(e)
    ).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_embedded_data(spark):
    page = (
        "<script>window.A = {'id': 5, 'tags':['a',],};window.B={\"x\":1};window.C={bad bad};"
        "fetch('/api/x');axios.get(\"/q/1\")</script>"
        '<script type="application/ld+json">{"a":1}</script><script type=\'application/ld+json\'>{"a":</script>'
    )
    assert [r.key for r in one(spark, page, js.window_vars)] == ["window.A", "window.B"]
    assert one(spark, page, js.jsonld) == ['{"a":1}']
    assert one(spark, page, js.ajax_endpoints) == ["/api/x"]
    assert sorted(one(spark, page, lambda c: js.ajax_endpoints(c, strict=False))) == ["/api/x", "/q/1"]


def test_detection(spark):
    page = "<noscript>Please enable JavaScript</noscript><p>" + "word " * 40 + "</p>"
    found = one(spark, page, js.js_detect)
    assert found.indicators == ["<noscript>"] and found.frameworks == []
    assert found.requires_js_rendering and found.dynamic_content_score == 0
    assert "vue" in one(spark, "<nav-x>", js.js_frameworks)
    assert one(spark, "<nav-x>", lambda c: js.js_frameworks(c, strict=False)) == []


def test_last_of_equal_keys_counts(spark):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in [("a", "1"), ("b", "2"), ("a", "3")]])
    assert spark.range(1).select(text.last_wins_map(entries)).first()[0] == {"a": "3", "b": "2"}

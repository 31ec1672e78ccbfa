import random
import time
from urllib.parse import parse_qs, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pagemill.functions import files, urls
from pagemill.operators import links

BASES = [
    "http://a.b/c/d;p?q=1", "https://m.x.y/en/25#top", "http://a.b", "http://a.b/",
    "http://a.b/fr/825?page=2&ref=x", "http://a.b//x//y/", "http://a.b/x/;y",
]
HREFS = [
    "g", "./g", "g/", "/g", "//g.h/x", "?y", "g?y", "#s", "g#s", ";x", "", ".", "./", "..", "../", "../g",
    "../..", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "http:g", "mailto:a@b",
    "javascript:void(0)", "HTTP://Q.r/T?u#", "http://q.r", "https://q.r/a/../b", "/a/./b/../c?x#y", "a//b",
    "/a//b", "a/b/..", " /sp ace ", "\t/x\ny", "/ciónga/ñ,x", "tel:123", "a:b", "1:2", "x?a=/../b", "..;x",
    "ftp://h/x", "?", "#", "/x;p=1/y", "/x;p", "g;x=1/./y",
]


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_resolve_url_equals_urljoin(spark):
    cases = [(b, h, urljoin(b, h)) for b in BASES for h in HREFS]
    got = rows(spark, cases, "b string, h string, e string").select(
        "*", urls.resolve_url(F.col("b"), F.col("h")).alias("g")
    )
    assert got.filter("e <> g").collect() == []


def test_resolve_url_on_random_paths(spark):
    dice = random.Random(5)
    parts = ["a", "b.c", ".", "..", "", "x;y", "é"]
    make = lambda: "/".join(dice.choice(parts) for _ in range(dice.randint(1, 6)))
    cases = [(f"http://h.i/{make()}", dice.choice(["", "/"]) + make()) for _ in range(800)]
    cases = [(b, h, urljoin(b, h)) for b, h in cases]
    got = rows(spark, cases, "b string, h string, e string").select(
        "*", urls.resolve_url(F.col("b"), F.col("h")).alias("g")
    )
    assert got.filter("e <> g").collect() == []


def normal(url):
    p = urlparse(url.lower())
    out = f"{p.scheme}://{p.netloc}{p.path}" + (f"?{p.query}" if p.query else "")
    return out[:-1] if out.endswith("/") and len(p.path) > 1 else out


URLS = sorted({urljoin(b, h) for b in BASES for h in HREFS}) + [
    "HTTP://A.b/X/?Q=1#f", "http://a.b/x//", "http://a.b/x;p=1", "http://a.b/x;p/", "http://a.b/?x/", "http://a.b/x/?",
    "http://a.b:80/x?y=1/", "http://a.b/x?y;z", "http://u@h/x?a#b?c",
]


def test_parts_and_normal_form(spark):
    cases = [(u, normal(u), *urlparse(u)) for u in URLS]
    schema = "u string, n string, scheme string, netloc string, path string, params string, query string, fragment string"
    got = rows(spark, cases, schema).select(
        "*", urls.normalize_url(F.col("u")).alias("g"), urls.url_parts(F.col("u")).alias("p")
    )
    for r in got.collect():
        assert r.g == r.n, r.u
        assert tuple(r.p) == (r.scheme, r.netloc, r.path, r.params, r.query, r.fragment), r.u


def test_link_targets_equal_the_long_way(spark):
    df = rows(spark, [(b, HREFS) for b in BASES], "b string, h array<string>")
    short = urls.link_targets(F.col("b"), F.col("h"))
    long = F.transform("h", lambda h: urls.normalize_url(urls.resolve_url(F.col("b"), h)))
    web = lambda u: u.startswith("http")
    got = df.select(F.transform(short, lambda t: t["url"]).alias("s"), long.alias("l")).collect()
    for r in got:
        assert [u for u in r.s if web(u)] == [u for u in r.l if web(u)]


def test_normalize_twice_changes_nothing_more(spark):
    # Two exceptions by definition: only one of several slashes goes, and a slash after
    # path parameters hides them from the first pass.
    once = urls.normalize_url(F.col("u"))
    plain = [u for u in URLS if not u.endswith("//") and ";" not in u]
    got = rows(spark, [(u,) for u in plain], "u string").select(once.alias("u")).distinct()
    again = got.select("u", once.alias("v")).filter(~F.col("u").endswith("/"))
    assert again.filter("u <> v").collect() == []


def test_parse_course_url(spark):
    cases = [
        ("http://a.edu/x/cs-101/y", "cs-101"), ("http://a.edu/course_7", "course_7"), ("http://a.edu/?id=9&id=8", "9"),
        ("http://a.edu/l?cid=&course=z", "z"), ("http://a.edu/none", None),
    ]
    got = rows(spark, cases, "u string, e string").select("*", urls.parse_course_url(F.col("u")).alias("c")).collect()
    for r in got:
        assert r.c.course_id == r.e
        assert r.c.query == parse_qs(urlparse(r.u).query)


def test_predicates(spark):
    df = rows(spark, [("http://evilexample.com/x",), ("http://a.example.com/x",), ("http://example.com/x.PDF",), ("ftp://example.com/x",)], "u string")
    u = F.col("u")
    dotted = [r[0] for r in df.select(urls.is_crawlable_url(u, ["example.com"])).collect()]
    strict = [r[0] for r in df.select(urls.is_crawlable_url(u, ["example.com"], strict=True)).collect()]
    assert dotted == [False, True, False, False]
    assert strict == [True, True, False, False]


@pytest.mark.parametrize(
    "name, kept, whole",
    [
        ("a<b>:c?.pdf", "a_b_c_.pdf", "a_b_c_.pdf"),
        ("x" * 300 + ".pdf", "x" * 200 + ".pdf", "x" * 250),
        ("", "unnamed", "unnamed"),
        ("  ..", "_", "_"),
        ("a.", "a", "a"),
        ("my  file__x.tar.gz", "my_file_x.tar.gz", "my_file_x.tar.gz"),
        ("tab\there.txt", "tabhere.txt", "tabhere.txt"),
    ],
)
def test_sanitize_filename(spark, name, kept, whole):
    n = F.col("n")
    row = rows(spark, [(name,)], "n string").select(files.sanitize_filename(n, True), files.sanitize_filename(n)).first()
    assert tuple(row) == (kept, whole)


def test_file_type_strict_and_plain(spark):
    cases = [("http://h/hw1.pdf", "lecture_slide", "assignment"), ("http://h/x.pdf", "lecture_slide", "reading"), ("http://h/a.html", "syllabus", "other"), ("http://h/a.mp4", "lecture_video", "lecture_video")]
    df = rows(spark, cases, "u string, s string, p string")
    none = F.lit("")
    got = df.select("*", files.file_type(F.col("u"), none, none).alias("gs"), files.file_type(F.col("u"), none, none, strict=False).alias("gp"))
    assert got.filter("s <> gs OR p <> gp").collect() == []


def test_long_domain_lists_equal_short_ones(spark):
    hosts = ["a.b", "x.a.b", "xa.b", "b", "A.B", "a.b:8080", "c.d.e", "d.e", "e", "", "..a.b", "f.g."]
    rows = [(n, f"http://{h}/p") for n, h in enumerate(hosts)] + [(20, None), (21, "mailto:x@a.b"), (22, "http://a.b/again"), (22, "http://a.b/again")]
    frame = spark.createDataFrame(rows, "n int, url string")
    for listed in (["a.b"], [".a.b", "d.e"], ["c.d.e", "g."], ["nowhere"], ["b:8080", "e"]):
        want = sorted(r.n for r in frame.filter(urls.is_crawlable_url(F.col("url"), listed)).collect())
        domains = spark.createDataFrame([(d,) for d in listed + listed] + [(None,), ("",)], "domain string")
        crawlable = frame.filter(urls.is_crawlable_url(F.col("url")))
        assert sorted(r.n for r in links.in_domains(crawlable, domains).collect()) == want


def test_edges_inside_a_domain_table(spark):
    page = '<a href="http://a.b/1">x</a><a href="http://q.a.b/2">x</a><a href="http://z/3">x</a>'
    pages = spark.createDataFrame([(1, "http://s/", page)], "page_id long, url string, html string")
    many = spark.createDataFrame([(f"d{n}.example",) for n in range(1000)] + [("a.b",)], "domain string")
    assert sorted(r.dst for r in links.extract_edges(pages, many).collect()) == ["http://a.b/1", "http://q.a.b/2"]


def test_hosts_of_a_common_ending_are_found_where_they_lie(spark):
    hosts = [f"h{i}.example.com" for i in range(40)] + ["a.org", "b.a.org", "xa.org", "c.net", "", None]
    df = rows(spark, [(None if h is None else h and f"http://{h.upper()}/x?y=1/2",) for h in hosts], "url string")
    listed = rows(spark, [(".h3.example.com",), ("org",), ("a.org",), ("",), (None,), ("nothing.com",)], "domain string")
    want = ["http://A.ORG/x?y=1/2", "http://B.A.ORG/x?y=1/2", "http://H3.EXAMPLE.COM/x?y=1/2", "http://XA.ORG/x?y=1/2"]
    # With 1 all shared endings are common, with 10 "com" and "example.com", with 100 none.
    for most in (1, 10, 100):
        assert sorted(r.url for r in links.in_domains(df, listed, most_hosts=most).collect()) == want
    every = rows(spark, [("com",)], "domain string")
    assert links.in_domains(df, every, most_hosts=5).count() == 40


ODD = [
    "http://a\tb.com/x", "http://a b.com/x", " http://a.b/x", "http://a.b/x y", "http://a.b/x\n", "http://a.b?x=1/2;3", "http://a.b/?",
    "http://a.b/p;q/r?s;t", "http://a.b/x#", "a+b://c/d", "http://", "http:///x", "http://é.b/ü", "HTTP://A.b", "http://a.b/x?y?z#w?v",
]


def test_odd_urls_have_the_parts_of_the_long_way(spark):
    cases = [(u, urlparse(u.lstrip("".join(map(chr, range(0x21))))).netloc) for u in ODD]
    got = rows(spark, cases, "u string, n string").select(
        "*", urls.url_parts(F.col("u"))["netloc"].alias("p"), urls.host_of(F.col("u")).alias("h")
    )
    assert [(r.u, r.p, r.h) for r in got.collect() if not r.n == r.p == r.h] == []


def test_odd_references_resolve_as_urljoin(spark):
    hrefs = ["/", "/x/", "/x//y", "/.x", "/x/.y", "/x;y", "/x ", " /x", "/x\n", "/é/Ü", "/x?y#z", "/A/B.html", "/a.PDF", "/a.pdf/", "../a.Zip", "//h/x", "/'\"<>"]
    bases = ["http://a.b/c?d#e", "https://U@a.b:80", "http://a.b;c/d", "http://é.b/c", "HTTP://a.b/c", " http://a.b/c", "ftp://a.b/c"]
    cases = [(b, h, urljoin(b.strip(), h.lstrip())) for b in bases for h in hrefs]
    resolved = urls.resolve_url(F.col("b"), F.col("h"))
    target = urls.link_targets(F.col("b"), F.array("h"))[0]["url"]
    df = rows(spark, cases, "b string, h string, e string")
    got = df.select("*", resolved.alias("g"), target.alias("t"), urls.normalize_url(F.col("e")).alias("n"))
    assert [(r.b, r.h, r.g, r.e) for r in got.collect() if r.g != r.e] == []
    assert [(r.b, r.h, r.t, r.n) for r in got.collect() if r.t != r.n] == []
    # Kept are those that pass the test of URLs, whichever way is taken.
    some = lambda **more: urls.crawlable_targets(F.col("b"), F.array("h"), **more)
    kept = df.select("*", some().alias("s"), some(url_filter=lambda u: F.lit(True)).alias("l"))
    kept = kept.withColumn("c", urls.is_crawlable_url(F.concat("e", F.lit("#"))))
    assert [(r.b, r.h, r.s, r.l, r.c) for r in kept.collect() if r.s != r.l or bool(r.s) != r.c] == []


def test_plain_addresses_are_judged_as_all_others(spark):
    odd = ["http://a.zip", "http://a.b/x.ZIP", "http://a.b/x.zip?y", "http://a.b/?x.zip", "http://a.b/x.zip/", "http://a.b/x.zip;p", "https://a.b/zip"]
    df = rows(spark, [(u,) for u in [*ODD, *URLS, *odd]], "u string")
    short, full = urls.is_crawlable_url(F.col("u")), urls.is_crawlable_url(F.concat("u", F.lit("#")))
    assert df.select("u", short.alias("s"), full.alias("f")).filter("s <> f").collect() == []
    assert df.filter(short).filter(F.col("u").isin(odd)).count() == 4


def test_dates_are_parsed_only_where_found(spark):
    from pagemill.functions.text import find_date

    cases = [("", None), ("none", None), ("13/45/2023 then 2021-02-03", "2021-02-03"), ("on 1 mar, 2020 Mar 2, 2021", "2021-03-02"), (None, None)]
    got = rows(spark, cases, "t string, e string").select("e", find_date(F.col("t")).cast("string").alias("d"))
    assert [r for r in got.collect() if r.d != r.e] == []


def test_relative_references_cost_about_as_much_as_rooted_ones(spark):
    def seconds(form, resolved=False):
        refs = F.array(*[F.concat(F.lit(form), F.lit(f"{n}p"), F.col("id").cast("string")) for n in range(30)])
        base = F.concat(F.lit("http://h.i/a/"), F.col("id").cast("string"))
        targets = F.transform(refs, lambda r: urls.resolve_url(base, r)) if resolved else urls.crawlable_targets(base, refs)
        frame = spark.range(60_000).select(targets.alias("t"))
        taken = []
        for _ in range(3):
            started = time.perf_counter()
            frame.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        return min(taken)

    assert seconds("../b/") < 4 * seconds("/b/")
    assert seconds("../b/", True) < 4 * seconds("/b/", True)


@pytest.mark.parametrize("base", ["http://H.i/A/b/c", "http://h.i", "http://h.i/a/b?q=/x", "http://h.i/a//b", "http://h.i/.a/b", "ftp://h.i/a/b"])
def test_relative_references_equal_the_long_way(spark, base):
    hrefs = [up + rest for up in ["", "../", "../../", "../../../"] for rest in ["x", "X/y/", "x#f/g", "x.pdf", "x.pdf/", "x:y", "x;p", "x?q", "..x", "x/../y"]]
    found = rows(spark, [(base, hrefs)], "b string, h array<string>").select(
        urls.link_targets(F.col("b"), F.col("h"))["url"].alias("t"), urls.crawlable_targets(F.col("b"), F.col("h")).alias("c")
    )
    full = rows(spark, [(base, h) for h in hrefs], "b string, h string").select(
        urls.normalize_url(urls.resolve_url(F.col("b"), F.col("h"))).alias("t")
    )
    every = [r.t for r in full.collect()]
    got = found.first()
    assert got.t == every
    kept = dict.fromkeys(t for t in every if t.startswith("http:") and not t.rstrip("/").endswith(".pdf"))
    assert [t for t in got.c if ".pdf" not in t] == list(kept)

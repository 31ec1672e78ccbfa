import gzip
import json
import random

from pyspark.sql import functions as F

from pagemill.operators.pages import extract_metadata
from pagemill.sources import json_lists, readers, writers
from pagemill.streaming import streams
from pagemill.streaming.keyed import KeyedTable


def urls(df):
    return sorted(r.url for r in df.collect())


def test_url_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('["http://a.b",{"url":"http://c.d"},"",{"x":1}]')
    (tmp_path / "b.json").write_text('{"urls":["http://e.f","nope"]}')
    (tmp_path / "u.xml").write_text('<r><url>http://a</url><x><link>http://b</link></x><url id="3">http://c</url></r>')
    (tmp_path / "u.csv").write_text('http://a,1\n\n"http://b,c",2\n')
    (tmp_path / "u.txt").write_text("# c\n http://a \n\n #http://b\nhttp://c\n")
    (tmp_path / "u.md").write_text("see [x](http://a.b/c) and https://d.e/f, or <http://g>")
    assert urls(readers.urls_json(spark, str(tmp_path / "a.json"))) == ["http://a.b", "http://c.d"]
    assert urls(readers.urls_json(spark, str(tmp_path / "b.json"))) == ["http://e.f", "nope"]
    assert urls(readers.urls_file(spark, str(tmp_path / "b.json"))) == ["http://e.f"]
    assert urls(readers.urls_xml(spark, str(tmp_path / "u.xml"))) == ["http://a", "http://b", "http://c"]
    assert urls(readers.urls_csv(spark, str(tmp_path / "u.csv"))) == ["http://a", "http://b,c"]
    assert urls(readers.urls_text(spark, str(tmp_path / "u.txt"))) == ["#http://b", "http://a", "http://c"]
    assert urls(readers.urls_text(spark, str(tmp_path / "u.txt"), comments=False)) == ["# c", "#http://b", "http://a", "http://c"]
    assert urls(readers.urls_file(spark, str(tmp_path / "u.txt"))) == ["http://a", "http://c"]
    assert urls(readers.urls_file(spark, str(tmp_path / "u.md"))) == ["http://a.b/c)", "http://g", "https://d.e/f,"]


def test_site_files(spark, tmp_path):
    body = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://h/1 </loc><priority>x</priority></url></urlset>'
    with gzip.open(tmp_path / "s.xml.gz", "wt") as f:
        f.write(body)
    assert [tuple(r) for r in readers.sitemap_files(spark, str(tmp_path / "s.xml.gz")).collect()] == [("http://h/1", None, None, None)]
    (tmp_path / "h.x.robots.txt").write_text("User-agent: *\nDisallow: /a\n")
    assert [tuple(r) for r in readers.robots_files(spark, str(tmp_path / "*.robots.txt")).collect()] == [("h.x", "User-agent: *\nDisallow: /a\n")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("http://a", "x,y"), ("http://b", None)], "url string, name string")
    writers.write_json(rows, str(tmp_path / "j"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "j")).collect() == rows.collect()
    writers.write_csv(rows, str(tmp_path / "c"), {"url": "URL"})
    assert sorted(r.URL for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == ["http://a", "http://b"]
    writers.write_text(rows, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["http://a", "http://b"]
    lines = rows.select(F.col("url").alias("line"), "name")
    writers.write_report(lines, str(tmp_path / "r"), ["line"])
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["http://a", "http://b"]
    files = spark.createDataFrame([("C: 1", "syllabus", "s"), ("C: 1", "reading", "r")], "course string, type string, name string")
    writers.write_catalog(files, str(tmp_path / "k"))
    got = spark.read.parquet(str(tmp_path / "k")).select("course", "type_dir", "name")
    assert sorted(tuple(r) for r in got.collect()) == [("C_1", ".", "s"), ("C_1", "readings", "r")]


def test_incremental_extract_reads_each_url_once(spark, pages, tmp_path):
    source, sink, progress = [str(tmp_path / n) for n in ("in", "out", "progress")]
    schema = "page_id long, url string, html string"
    titles = lambda df: extract_metadata(df).select("page_id", "title")
    run = lambda checkpoint=progress: streams.incremental_extract(spark, source, schema, sink, checkpoint, titles)
    results = lambda: sorted(r.title for r in run().attached("results", "page_id long, title string").collect())
    pages(("http://a/", "<title>one</title>")).write.parquet(source)
    run()
    assert results() == ["one"]
    # The URL again in another file, twice, and a new one.
    pages(("http://b/", "<title>two</title>"), ("http://a/", "<title>again</title>")).write.mode("append").parquet(source)
    pages(("http://b/", "<title>two</title>")).write.mode("append").parquet(source)
    assert results() == ["one", "two"]
    # A stream that knows nothing of the first one reads all files, and adds nothing.
    run(str(tmp_path / "other"))
    assert results() == ["one", "two"]


def test_of_captures_that_arrive_together_the_first_is_read(spark, tmp_path):
    source, sink, progress = [str(tmp_path / n) for n in ("in", "out", "progress")]
    schema = "page_id long, url string, html string"
    rows = [(n, f"http://{n % 20}/", f"<title>{n}</title>") for n in range(99, -1, -1)]
    spark.createDataFrame(rows, schema).repartition(3).sortWithinPartitions(F.desc("page_id")).write.parquet(source)
    done = streams.incremental_extract(spark, source, schema, sink, progress, lambda df: df.select("page_id"))
    assert sorted(r.page_id for r in done.attached("results", "page_id long").collect()) == list(range(20))


def test_a_batch_counts_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    schema = "k int, v string"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    assert not table.committed("s", 0) and table.latest(schema).count() == 0
    table.commit(rows((1, "a"), (2, "b")), "s", 0, more=rows((9, "x")))
    table.commit(rows((2, "c"), (3, None)), "s", 1)
    # The second batch is tried again, with another outcome.
    table.commit(rows((2, "d")), "s", 1)
    assert table.committed("s", 1) and not table.committed("s", 2) and not table.committed("t", 1)
    assert sorted(map(tuple, table.latest(schema).collect())) == [(1, "a"), (2, "d")]
    assert sorted(map(tuple, table.new(rows((2, "n"), (4, "n")), schema).collect())) == [(4, "n")]
    assert [tuple(r) for r in table.attached("more", schema).collect()] == [(9, "x")]


def test_open_windows_are_given(spark, tmp_path):
    log = [(1, "2024-01-01 00:10:00", True, 1.0, 5), (1, "2024-01-01 00:20:00", False, 1.0, 5), (2, "2024-01-01 03:00:00", True, 2.0, 7)]
    schema = "domain bigint, ts string, ok boolean, latency double, bytes bigint"
    frame = spark.createDataFrame(log, schema).withColumn("ts", F.to_timestamp("ts"))
    source = str(tmp_path / "in")
    frame.write.parquet(source)
    stream = streams.stream_domain_metrics(spark.readStream.schema(frame.schema).parquet(source))
    table = KeyedTable(spark, str(tmp_path / "out"), ["window_start", "domain"])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    for _ in range(2):
        streams.upsert_available(stream, table, str(tmp_path / "progress"))
    got = sorted((r.domain, r.requests, r.errors, r.bytes) for r in table.latest(shape).collect())
    assert got == [(1, 1, 1, 5), (2, 1, 0, 7)]
    frame.limit(1).write.mode("append").parquet(source)
    # Within the watermark the window is counted on, and its newer row counts.
    frame.filter("domain = 2").write.mode("append").parquet(source)
    streams.upsert_available(stream, table, str(tmp_path / "progress"))
    assert {r.domain: r.requests for r in table.latest(shape).collect()}[2] == 2


def plain_urls(text):
    """URLs of JSON texts one after the other."""
    decoder, at, out = json.JSONDecoder(), 0, []
    text = text.strip()
    while at < len(text):
        value, at = decoder.raw_decode(text, at)
        while at < len(text) and text[at].isspace():
            at += 1
        listed = value.get("urls") if isinstance(value, dict) else value
        for item in listed if isinstance(listed, list) else []:
            url = item.get("url") if isinstance(item, dict) else item
            out += [url] if isinstance(url, str) else []
    return sorted(out)


def test_large_json_lists_are_read_by_several_tasks(spark, tmp_path):
    dice = random.Random(1)

    def item(n):
        text = f'http://h/{n}?"q"=\\{n}' + dice.choice(["", "é[", "]}", "\\\\", ":", ",", '"'])
        return dice.choice([
            text, {"url": text}, {"x": [1, "no", {"url": "deep"}], "url": text, "urls": ["no"]}, {"x": "no"}, 5, None, ["no", {"url": "no"}], "", {"url": None},
        ])

    def listed(n):
        items = [item(i) for i in range(n)]
        return dice.choice([items, {"a": ["no"], "urls": items, "b": {"urls": ["no"]}}, {"urls": {"x": "no"}}, {"other": items}])

    texts = ["", "[]", "{}", "[\n]", '["a"]\n["b"]', '{"urls": ["a"]}\n["b", {"url": "c"}]\n{"x": ["d"]}']
    texts += [json.dumps(listed(dice.randint(0, 40)), ensure_ascii=dice.random() < 0.5, indent=dice.choice([None, 1])) for _ in range(12)]
    for n, text in enumerate(texts):
        (tmp_path / f"f{n}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {n: [] for n in range(len(texts))}
        for r in json_lists.listed_urls(spark, str(tmp_path)).collect():
            got[int(r.file.split("/f")[-1][:-5])].append(r.url)
        one = tmp_path / "one"
        one.mkdir()
        (one / "large.json").write_text(json.dumps(["http://h/" + "x" * 50] * 200))
        tasks = spark.read.option("lineSep", '"').text(str(one)).rdd.getNumPartitions()
        assert tasks > 8 and json_lists.listed_urls(spark, str(one)).count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {n: sorted(u) for n, u in got.items()} == {n: plain_urls(t) for n, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 40

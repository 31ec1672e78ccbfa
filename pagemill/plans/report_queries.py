"""Queries on tasks, outcomes, logs, catalogs and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import layout, log_runs, ordered, reports
from pagemill.plans.derived import derived, given, with_derived
from pagemill.plans.url_queries import _bytes_sql
from pagemill.session import shared_path
from pagemill.sources import readers, writers

QUERIES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function

    return register


@query(
    "resume_anti",
    with_derived(["tasks"], "SELECT task_id, url FROM tasks WHERE status <> 'completed'"),
)
def resume_anti(spark, sf):
    tasks = derived(spark, sf, "tasks")
    return reports.resume_anti(tasks, tasks.filter("status = 'completed'")).select("task_id", "url")


BATCH = """SELECT batch_id, count(*) AS total_tasks, count(*) FILTER (status = 'completed') AS completed_tasks,
    count(*) FILTER (status = 'failed') AS failed_tasks, count(*) FILTER (status = 'processing') AS in_progress_tasks,
    CAST(sum(CASE WHEN status = 'completed' THEN files ELSE 0 END) AS BIGINT) AS total_files,
    CAST(sum(CASE WHEN status = 'completed' THEN bytes ELSE 0 END) AS BIGINT) AS total_bytes,
    min(started_at) AS start_time, max(completed_at) AS end_time,
    (epoch_us(max(completed_at)) - epoch_us(min(started_at))) / 1e6 AS duration,
    count(*) FILTER (status = 'completed') / count(*) AS success_rate FROM tasks GROUP BY batch_id"""


@query("batch_summary", with_derived(["tasks"], BATCH))
def batch_summary(spark, sf):
    return reports.batch_summary(derived(spark, sf, "tasks"))


_SHARE = "CAST(round(1000 * completed_tasks / total_tasks) AS BIGINT)"


@query(
    "batch_report",
    with_derived(
        ["tasks"],
        f"""WITH b AS ({BATCH}), s AS (SELECT *, total_bytes AS n, CAST(duration AS BIGINT) AS sec FROM b)
        SELECT batch_id, 0 AS section, l.line_key, l.line FROM s, LATERAL (VALUES
        ('00', '# Batch Processing Report'), ('01', '**Batch ID:** ' || batch_id),
        ('02', '**Start Time:** ' || strftime(start_time, '%Y-%m-%d %H:%M:%S')),
        ('03', '**End Time:** ' || strftime(end_time, '%Y-%m-%d %H:%M:%S')),
        ('04', '**Duration:** ' || concat_ws(' ', CASE WHEN sec >= 3600 THEN (sec // 3600) || 'h' END,
        CASE WHEN sec % 3600 >= 60 THEN (sec % 3600 // 60) || 'm' END, CASE WHEN sec % 60 > 0 THEN (sec % 60) || 's' END)),
        ('05', '## Summary'), ('06', '- Total Tasks: ' || total_tasks), ('07', '- Completed: ' || completed_tasks),
        ('08', '- Failed: ' || failed_tasks),
        ('09', '- Success Rate: ' || ({_SHARE} // 10) || '.' || ({_SHARE} % 10) || '%'),
        ('10', '- Files Downloaded: ' || total_files), ('11', '- Data Downloaded: ' || {_bytes_sql()})) AS l(line_key, line)
        UNION ALL SELECT batch_id, 1, '', '## Failed Tasks' FROM b WHERE failed_tasks > 0
        UNION ALL SELECT batch_id, 2, '' || task_id, '- ' || url || ': ' || coalesce(error, 'None') FROM tasks WHERE status = 'failed'""",
    ),
)
def batch_report(spark, sf):
    return reports.batch_report(derived(spark, sf, "tasks"))


@query(
    "results_to_files",
    with_derived(
        ["course_links", "outcomes"],
        "SELECT url, course_url, success, error, download_time FROM course_links LEFT JOIN (SELECT * FROM outcomes WHERE success IS NOT NULL) USING (url)",
    ),
)
def results_to_files(spark, sf):
    outcomes = derived(spark, sf, "outcomes").filter("success IS NOT NULL")
    return reports.results_to_files(derived(spark, sf, "course_links"), outcomes).select(
        "url", "course_url", "success", "error", "download_time"
    )


@query(
    "course_summary",
    with_derived(
        ["course_links", "outcomes"],
        """SELECT course_url, count(*) AS files_found, count(*) FILTER (success) AS files_downloaded,
        count(*) FILTER (NOT success) AS files_failed, count(error) AS n_errors, sum(download_time) AS duration
        FROM course_links LEFT JOIN outcomes USING (url) GROUP BY course_url""",
    ),
)
def course_summary(spark, sf):
    return reports.course_summary(derived(spark, sf, "course_links"), derived(spark, sf, "outcomes"))


@query(
    "course_errors",
    with_derived(
        ["course_links", "outcomes"],
        """SELECT course_url, error, count(*) AS n FROM course_links JOIN outcomes USING (url)
        WHERE error IS NOT NULL GROUP BY ALL""",
    ),
)
def course_errors(spark, sf):
    return reports.course_errors(derived(spark, sf, "course_links"), derived(spark, sf, "outcomes"))


STATS = """SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
    CAST(sum(bytes) AS BIGINT) AS total_bytes, sum(download_time) AS total_time, count(error) AS n_errors,
    sum(bytes) / sum(download_time) AS average_speed FROM downloads"""


@query("download_stats", with_derived(["downloads"], STATS))
def download_stats(spark, sf):
    return reports.download_stats(derived(spark, sf, "downloads"))


@query(
    "download_report",
    with_derived(
        ["downloads"],
        f"""WITH t AS (SELECT count(*) AS total, count(*) FILTER (success) AS good,
        CAST(sum(CASE WHEN success THEN bytes END) AS BIGINT) AS n FROM downloads)
        SELECT 0 AS section, l.line_key, l.line FROM t, LATERAL (VALUES ('0', '- Total files: ' || total),
        ('1', '- Successful: ' || good), ('2', '- Failed: ' || (total - good)),
        ('3', '- Total downloaded: ' || {_bytes_sql()})) AS l(line_key, line)
        UNION ALL SELECT CASE WHEN success THEN 1 ELSE 2 END, name, CASE WHEN success THEN '- ✓ ' || name || ' (' || size || ') - '
        || (tenths // 10) || '.' || (tenths % 10) || 's' ELSE '- ✗ ' || name || ': ' || error END FROM
        (SELECT *, {_bytes_sql()} AS size, CAST(round_even(download_time * 10, 0) AS BIGINT) AS tenths FROM (SELECT *, bytes AS n FROM downloads))""",
    ),
)
def download_report(spark, sf):
    return reports.download_report(derived(spark, sf, "downloads"))


_KEPT = """kept AS (SELECT domain, latency FROM fetch_log WHERE ok
    QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, request_id DESC) <= 100)"""


@query(
    "domain_metrics",
    with_derived(
        ["fetch_log"],
        f"""WITH {_KEPT}, c AS (SELECT domain, count(*) FILTER (ok) AS requests, count(*) FILTER (NOT ok) AS errors,
        CAST(sum(CASE WHEN ok THEN bytes ELSE 0 END) AS BIGINT) AS bytes FROM fetch_log GROUP BY domain)
        SELECT domain, requests, errors, bytes, round(coalesce(m, 0), 6) AS avg_latency FROM c
        LEFT JOIN (SELECT domain, avg(latency) AS m FROM kept GROUP BY domain) USING (domain)""",
    ),
)
def domain_metrics(spark, sf):
    rows = reports.domain_metrics(derived(spark, sf, "fetch_log"), keep=100)
    return rows.withColumn("avg_latency", F.round("avg_latency", 6))


@query(
    "global_metrics",
    with_derived(
        ["fetch_log"],
        f"""WITH {_KEPT} SELECT count(*) FILTER (ok) AS total_requests, count(*) FILTER (NOT ok) AS total_errors,
        CAST(sum(CASE WHEN ok THEN bytes ELSE 0 END) AS BIGINT) AS total_bytes, count(DISTINCT CASE WHEN ok THEN domain END) AS domains,
        (SELECT round(avg(latency), 6) FROM kept) AS avg_latency FROM fetch_log""",
    ),
)
def global_metrics(spark, sf):
    rows = reports.global_metrics(derived(spark, sf, "fetch_log"), keep=100)
    return rows.withColumn("avg_latency", F.round("avg_latency", 6))


@query(
    "pool_status",
    with_derived(
        ["heartbeats"],
        """WITH last AS (SELECT worker_id, arg_max(status, ts) AS status FROM heartbeats GROUP BY worker_id)
        SELECT count(*) AS total_workers, count(*) FILTER (status = 'busy') AS active_workers,
        count(*) FILTER (status = 'idle') AS idle_workers, count(*) FILTER (status = 'error') AS error_workers,
        count(*) FILTER (status = 'busy') / count(*) AS utilization FROM last""",
    ),
)
def pool_status(spark, sf):
    return reports.pool_status(derived(spark, sf, "heartbeats"))


@query(
    "stale_workers",
    with_derived(
        ["heartbeats"],
        """SELECT worker_id, max(ts) AS last_heartbeat,
        (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1e6 AS silent_seconds
        FROM heartbeats GROUP BY worker_id HAVING silent_seconds > 21600""",
    ),
)
def stale_workers(spark, sf):
    at = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return reports.stale_workers(derived(spark, sf, "heartbeats"), at, interval_seconds=10800)


@query(
    "ext_counts",
    with_derived(
        ["catalog_files"],
        """SELECT course, lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) AS ext, count(*) AS n FROM catalog_files
        WHERE name NOT LIKE '.%' GROUP BY ALL""",
    ),
)
def ext_counts(spark, sf):
    return reports.ext_counts(derived(spark, sf, "catalog_files"))


@query(
    "recent_files",
    with_derived(
        ["catalog_files"],
        """SELECT course, name, mtime, seq, row_number() OVER (PARTITION BY course ORDER BY mtime DESC, name, seq)::INTEGER AS rank
        FROM catalog_files WHERE name NOT LIKE '.%' AND name <> 'README.md' QUALIFY rank <= 5""",
    ),
)
def recent_files(spark, sf):
    rows = reports.recent_files(derived(spark, sf, "catalog_files"), order=["name", "seq"])
    return rows.select("course", "name", "mtime", "seq", "rank")


@query(
    "existing_file_semi",
    with_derived(
        ["catalog_files"],
        """SELECT seq, dir, name FROM catalog_files WHERE seq % 2 = 0 AND (dir, name) IN
        (SELECT (dir, name) FROM catalog_files WHERE seq % 2 = 1)""",
    ),
)
def existing_file_semi(spark, sf):
    files = derived(spark, sf, "catalog_files").select("seq", "dir", "name")
    return reports.existing_file_semi(files.filter("seq % 2 = 0"), files.filter("seq % 2 = 1"))


# The k-th duplicate takes the k-th number no other file has.
_FREE = """firsts AS (SELECT DISTINCT dir, name FROM {0}),
    split AS (SELECT *, coalesce(nullif(regexp_extract(name, '^(.+)([.][^.]+)$', 1), ''), name) AS stem,
    regexp_extract(name, '^(.+)([.][^.]+)$', 2) AS ext,
    row_number() OVER (PARTITION BY dir, name ORDER BY seq) - 1 AS k FROM {0}),
    most AS (SELECT dir, name, stem, ext, max(k) AS m FROM split GROUP BY ALL),
    numbers AS (SELECT dir, name, stem, ext, unnest(range(1, m + 20)) AS c FROM most),
    free AS (SELECT dir, name, stem || '_' || c || ext AS new_name, row_number() OVER (PARTITION BY dir, name ORDER BY c) AS k
    FROM numbers WHERE (dir, stem || '_' || c || ext) NOT IN (SELECT (dir, name) FROM firsts))"""


@query(
    "dup_suffix",
    with_derived(
        ["catalog_files"],
        f"""WITH {_FREE.format('catalog_files')} SELECT seq, dir, name, CASE WHEN k = 0 THEN name ELSE new_name END AS new_name
        FROM split LEFT JOIN free USING (dir, name, k)""",
    ),
)
def dup_suffix(spark, sf):
    return layout.dup_suffix(derived(spark, sf, "catalog_files").select("seq", "dir", "name"))


_DIR = """'base/' || replace(course, ' ', '_') || CASE type WHEN 'lecture_video' THEN '/lectures/videos' WHEN 'lecture_slide'
    THEN '/lectures/slides' WHEN 'assignment' THEN '/assignments' WHEN 'reading' THEN '/readings' WHEN 'syllabus' THEN '' ELSE '/misc' END"""


@query(
    "organize_batch",
    with_derived(
        ["catalog_files"],
        f"""WITH placed AS (SELECT seq, {_DIR} AS dir, name AS original_name,
        CASE WHEN name = '.hidden' THEN 'unnamed.hidden' ELSE name END AS name FROM catalog_files),
        {_FREE.format('placed')} SELECT seq, dir, original_name, CASE WHEN k = 0 THEN name ELSE new_name END AS new_name
        FROM split LEFT JOIN free USING (dir, name, k)""",
    ),
)
def organize_batch(spark, sf):
    files = derived(spark, sf, "catalog_files").select("seq", "course", "type", "name")
    return layout.organize_batch(files, "base").select("seq", "dir", "original_name", "new_name")


@query(
    "priority_order",
    with_derived(["tasks"], "SELECT task_id, priority, row_number() OVER (ORDER BY priority DESC, seq) AS place FROM tasks"),
)
def priority_order(spark, sf):
    tasks = derived(spark, sf, "tasks").select("task_id", "priority", "seq")
    return ordered.priority_order(tasks).select("task_id", "priority", "place")


@query(
    "chunk",
    with_derived(["tasks"], "SELECT task_id, (row_number() OVER (ORDER BY seq) - 1) // 64 AS chunk_no FROM tasks"),
)
def chunk(spark, sf):
    return ordered.chunk(derived(spark, sf, "tasks").select("task_id", "seq"), ["seq"], 64).select("task_id", "chunk_no")


@query(
    "short_gaps",
    with_derived(
        ["fetch_log"],
        """SELECT * FROM (SELECT request_id, domain, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY domain ORDER BY ts, request_id)))
        / 1000000.0 AS gap_seconds FROM fetch_log) WHERE gap_seconds < CASE WHEN domain LIKE '%7' THEN 28800 ELSE 7200 END""",
    ),
)
def short_gaps(spark, sf):
    delay = F.when(F.col("domain").endswith("7"), 28800.0).otherwise(7200.0)
    return log_runs.short_gaps(derived(spark, sf, "fetch_log"), delay)


@query(
    "failure_runs",
    with_derived(
        ["fetch_log"],
        """WITH r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY ts, request_id) AS k FROM fetch_log),
        t AS (SELECT domain, count(*) FILTER (ok) AS s FROM fetch_log GROUP BY domain)
        SELECT domain, CAST(k AS BIGINT) AS successes_before, count(*) AS failures, min(ts) AS first_failure, max(ts) AS last_failure,
        s > k AS recovered FROM r JOIN t USING (domain) WHERE NOT ok GROUP BY domain, k, s""",
    ),
)
def failure_runs(spark, sf):
    return log_runs.failure_runs(derived(spark, sf, "fetch_log"))


# Sources and sinks: write to a new place in the shared folder, read back.
@query("src_urls_text", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def src_urls_text(spark, sf):
    path = shared_path(spark, "urls-text")
    pages = given(spark, sf, "pages")
    lines = pages.select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("url"))
    noise = pages.select(F.concat(F.lit("# page "), F.col("page_id").cast("string")).alias("url"))
    writers.write_text(lines.unionByName(noise).unionByName(pages.select(F.lit("").alias("url"))), path)
    return readers.urls_text(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query("src_urls_csv", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def src_urls_csv(spark, sf):
    path = shared_path(spark, "urls-csv")
    given(spark, sf, "pages").select("url", "page_id").write.csv(path)
    return readers.urls_csv(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query(
    "src_urls_xml",
    "SELECT url, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT 'http://x.example/' || page_id FROM pages) GROUP BY url",
)
def src_urls_xml(spark, sf):
    path = shared_path(spark, "urls-xml")
    rows = given(spark, sf, "pages").select(
        "url", F.concat(F.lit("http://x.example/"), F.col("page_id").cast("string")).alias("link")
    )
    rows.write.format("xml").option("rowTag", "item").option("rootTag", "items").save(path)
    return readers.urls_xml(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query(
    "src_urls_json",
    """SELECT 'http://c' || c_custkey || '.example.edu/1' AS url FROM customer
    UNION ALL SELECT 'http://c' || c_custkey || '.example.edu/2' FROM customer WHERE c_custkey % 4 < 3""",
)
def src_urls_json(spark, sf):
    key = F.concat(F.lit("http://c"), F.col("c_custkey").cast("string"), F.lit(".example.edu/"))
    one, two = F.concat(key, F.lit("1")), F.concat(key, F.lit("2"))
    docs = (
        F.when(F.col("c_custkey") % 4 == 0, F.to_json(F.array(one, F.lit(""), two)))
        .when(F.col("c_custkey") % 4 == 1, F.to_json(F.struct(F.array(one, two).alias("urls"))))
        .when(F.col("c_custkey") % 4 == 2, F.to_json(F.array(F.struct(one.alias("url")), F.struct(two.alias("url")))))
        .otherwise(F.concat(F.lit('["'), one, F.lit('", {"x": 1}, {"url": ""}]')))
    )
    # Written as files of several texts each; half of the rows are read from these, half as cells.
    path = shared_path(spark, "urls-json")
    rows = given(spark, sf, "customer").select("c_custkey", docs.alias("value"))
    rows.filter("c_custkey % 8 < 4").select("value").write.text(path)
    cells = rows.filter("c_custkey % 8 >= 4").select(F.explode(readers.json_urls(F.col("value"))).alias("url"))
    return readers.urls_json(spark, path).unionByName(cells.filter("url <> ''"))


@query("sink_json", with_derived(["tasks"], "SELECT task_id, url, status, error, files FROM tasks"))
def sink_json(spark, sf):
    path = shared_path(spark, "json")
    rows = derived(spark, sf, "tasks").select("task_id", "url", "status", "error", F.struct("files", "bytes").alias("sizes"))
    writers.write_json(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select("task_id", "url", "status", "error", "sizes.files")


@query("sink_csv", "SELECT '' || page_id AS \"ID\", url AS \"URL\" FROM pages")
def sink_csv(spark, sf):
    path = shared_path(spark, "csv")
    writers.write_csv(given(spark, sf, "pages"), path, {"page_id": "ID", "url": "URL"})
    return spark.read.schema("ID string, URL string").csv(path, header=True)


@query("sink_text", "SELECT url AS value FROM pages")
def sink_text(spark, sf):
    path = shared_path(spark, "text")
    writers.write_text(given(spark, sf, "pages"), path)
    return spark.read.text(path)


@query(
    "sink_catalog_layout",
    with_derived(
        ["catalog_files"],
        """SELECT seq, dir, name, coalesce(type, 'other') AS type, replace(course, ' ', '_') AS course, CASE type WHEN 'lecture_video' THEN 'lectures/videos' WHEN 'lecture_slide'
        THEN 'lectures/slides' WHEN 'assignment' THEN 'assignments' WHEN 'reading' THEN 'readings' WHEN 'syllabus' THEN '.'
        ELSE 'misc' END AS type_dir FROM catalog_files""",
    ),
)
def sink_catalog_layout(spark, sf):
    path = shared_path(spark, "catalog")
    files = derived(spark, sf, "catalog_files").withColumn("type", F.coalesce("type", F.lit("other")))
    writers.write_catalog(files, path)
    return spark.read.parquet(path).select("seq", "dir", "name", "type", "course", "type_dir")

"""Summaries of crawls, batches, downloads and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.files import file_visible, suffix_of
from pagemill.functions.text import format_bytes, format_duration, micros


def resume_anti(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks whose URL is not completed yet."""
    return tasks.join(done.select("url"), "url", "left_anti")


def batch_summary(tasks: DataFrame) -> DataFrame:
    """Per batch: tasks by state, files, bytes, duration in seconds, success rate."""
    done = F.col("status") == "completed"
    out = tasks.groupBy("batch_id").agg(
        F.count("*").alias("total_tasks"),
        F.count_if(done).alias("completed_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"),
        F.count_if(F.col("status") == "processing").alias("in_progress_tasks"),
        F.sum(F.when(done, F.col("files")).otherwise(0)).alias("total_files"),
        F.sum(F.when(done, F.col("bytes")).otherwise(0)).alias("total_bytes"),
        F.min("started_at").alias("start_time"),
        F.max("completed_at").alias("end_time"),
    )
    seconds = micros(F.col("end_time")) - micros(F.col("start_time"))
    return out.withColumns(
        {
            "duration": seconds / 1e6,
            "success_rate": F.col("completed_tasks") / F.col("total_tasks"),
        }
    )


def _percent(rate: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.bround(rate * 100, 1)), F.lit("%"))


def batch_report(tasks: DataFrame) -> DataFrame:
    """(batch_id, section, line_key, line): the lines of a report per batch, to be sorted
    by (batch_id, section, line_key). Failed tasks are rows, never one long text."""
    summary = batch_summary(tasks)
    labels = [
        ("Total Tasks", F.col("total_tasks").cast("string")),
        ("Completed", F.col("completed_tasks").cast("string")),
        ("Failed", F.col("failed_tasks").cast("string")),
        ("Success Rate", _percent(F.col("success_rate"))),
        ("Files Downloaded", F.col("total_files").cast("string")),
        ("Data Downloaded", format_bytes(F.col("total_bytes"))),
    ]
    head = [
        ("# Batch Processing Report", None),
        ("**Batch ID:** ", F.col("batch_id").cast("string")),
        ("**Start Time:** ", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss")),
        ("**End Time:** ", F.date_format("end_time", "yyyy-MM-dd HH:mm:ss")),
        ("**Duration:** ", format_duration(F.coalesce(F.col("duration"), F.lit(0.0)))),
        ("## Summary", None),
    ]
    lines = [F.concat(F.lit(t), v) if v is not None else F.lit(t) for t, v in head]
    lines += [F.concat(F.lit(f"- {t}: "), v) for t, v in labels]
    top = summary.select(
        "batch_id", F.lit(0).alias("section"), F.posexplode(F.array(*[F.coalesce(l, F.lit("")) for l in lines])).alias("_p", "line")
    ).select("batch_id", "section", F.lpad(F.col("_p").cast("string"), 2, "0").alias("line_key"), "line")
    title = summary.filter("failed_tasks > 0").select(
        "batch_id", F.lit(1).alias("section"), F.lit("").alias("line_key"), F.lit("## Failed Tasks").alias("line")
    )
    failed = tasks.filter(F.col("status") == "failed").select(
        "batch_id",
        F.lit(2).alias("section"),
        F.col("task_id").cast("string").alias("line_key"),
        F.concat(F.lit("- "), "url", F.lit(": "), F.coalesce("error", F.lit("None"))).alias("line"),
    )
    return top.unionByName(title).unionByName(failed)


def results_to_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files with the outcome of their own URL; a file without outcome keeps NULLs."""
    return files.join(results, "url", "left")


def course_summary(files: DataFrame, results: DataFrame) -> DataFrame:
    """Per course: files found, downloaded and failed, and the total time. The error
    texts of a course are rows of ``course_errors``."""
    joined = results_to_files(files, results)
    return joined.groupBy("course_url").agg(
        F.count("*").alias("files_found"),
        F.count_if(F.col("success")).alias("files_downloaded"),
        F.count_if(~F.col("success")).alias("files_failed"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.sum("download_time").alias("duration"),
    )


def course_errors(files: DataFrame, results: DataFrame) -> DataFrame:
    """(course_url, error, n): error texts per course with how often they occur."""
    joined = results_to_files(files, results).filter(F.col("error").isNotNull())
    return joined.groupBy("course_url", "error").agg(F.count("*").alias("n"))


def download_stats(results: DataFrame) -> DataFrame:
    """One row over all outcomes; bytes count whether or not the download succeeded."""
    out = results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("download_time"), F.lit(0.0)).alias("total_time"),
        F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("n_errors"),
    )
    speed = F.when(F.col("total_time") > 0, F.col("total_bytes") / F.col("total_time")).otherwise(0.0)
    return out.withColumn("average_speed", speed)


def download_report(results: DataFrame) -> DataFrame:
    """(section, line_key, line): report lines; bytes count for successes only."""
    ok = F.col("success")
    totals = results.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("good"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
    lines = [
        F.concat(F.lit("- Total files: "), F.col("total").cast("string")),
        F.concat(F.lit("- Successful: "), F.col("good").cast("string")),
        F.concat(F.lit("- Failed: "), (F.col("total") - F.col("good")).cast("string")),
        F.concat(F.lit("- Total downloaded: "), format_bytes(F.col("bytes"))),
    ]
    top = totals.select(F.lit(0).alias("section"), F.posexplode(F.array(*lines)).alias("_p", "line")).select(
        "section", F.col("_p").cast("string").alias("line_key"), "line"
    )
    size = F.when(F.col("bytes") > 0, F.concat(F.lit(" ("), format_bytes(F.col("bytes")), F.lit(")"))).otherwise("")
    took = F.when(
        F.col("download_time") > 0,
        F.concat(F.lit(" - "), F.format_string("%.1f", F.bround("download_time", 1)), F.lit("s")),
    ).otherwise("")
    good = F.concat(F.lit("- ✓ "), "name", size, took)
    bad = F.concat(
        F.lit("- ✗ "), F.col("name"), F.when(F.col("error") != "", F.concat(F.lit(": "), "error")).otherwise("")
    )
    rows = results.select(
        F.when(ok, 1).otherwise(2).alias("section"),
        F.col("name").alias("line_key"),
        F.when(ok, good).otherwise(bad).alias("line"),
    )
    return top.unionByName(rows)


def _kept_latencies(log: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` successful requests per domain; cut before the shuffle."""
    newest = Window.partitionBy("domain").orderBy(F.desc("ts"), F.desc("request_id"))
    ok = log.filter("ok").select("domain", "ts", "request_id", "latency")
    return ok.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep)


def _domain_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("domain").agg(
        F.count_if("ok").alias("requests"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.sum(F.when(F.col("ok"), F.col("bytes")).otherwise(0)).alias("bytes"),
    )


def domain_metrics(log: DataFrame, keep: int = 100) -> DataFrame:
    """Per domain: requests, errors, bytes, mean latency of the last ``keep`` requests."""
    counts = _domain_counts(log)
    means = _kept_latencies(log, keep).groupBy("domain").agg(F.avg("latency").alias("avg_latency"))
    return counts.join(means, "domain", "left").fillna({"avg_latency": 0.0})


def global_metrics(log: DataFrame, keep: int = 100) -> DataFrame:
    """One row over all domains; ``domains`` counts those with a successful request. The mean latency is that of
    the rows ``domain_metrics`` keeps, so each domain counts with as many as it has."""
    kept = _kept_latencies(log, keep).groupBy("domain").agg(F.sum("latency").alias("_l"), F.count("latency").alias("_k"))
    per_domain = _domain_counts(log).join(kept, "domain", "left")
    none = F.lit(0)
    return per_domain.agg(
        F.coalesce(F.sum("requests"), none).alias("total_requests"),
        F.coalesce(F.sum("errors"), none).alias("total_errors"),
        F.coalesce(F.sum("bytes"), none).alias("total_bytes"),
        F.count_if(F.col("requests") > 0).alias("domains"),
        F.coalesce(F.sum("_l") / F.nullif(F.sum("_k"), none), F.lit(0.0)).alias("avg_latency"),
    )


def latest_heartbeats(beats: DataFrame) -> DataFrame:
    """The last heartbeat of every worker, reduced before the shuffle."""
    rest = [c for c in beats.columns if c != "worker_id"]
    last = beats.groupBy("worker_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "status")).alias("_b"))
    return last.select("worker_id", "_b.*")


def pool_status(beats: DataFrame) -> DataFrame:
    """One row: workers by state and the share that is busy."""
    out = latest_heartbeats(beats).agg(
        F.count("*").alias("total_workers"),
        F.count_if(F.col("status") == "busy").alias("active_workers"),
        F.count_if(F.col("status") == "idle").alias("idle_workers"),
        F.count_if(F.col("status") == "error").alias("error_workers"),
    )
    share = F.col("active_workers") / F.col("total_workers")
    return out.withColumn("utilization", F.when(F.col("total_workers") > 0, share).otherwise(0.0))


def stale_workers(beats: DataFrame, as_of: Column, interval_seconds: float = 30.0) -> DataFrame:
    """(worker_id, last_heartbeat, silent_seconds): workers silent for more than twice
    the health check interval at time ``as_of``."""
    last = beats.groupBy("worker_id").agg(F.max("ts").alias("last_heartbeat"))
    silent = (micros(as_of) - micros(F.col("last_heartbeat"))) / 1e6
    return last.withColumn("silent_seconds", silent).filter(F.col("silent_seconds") > 2 * interval_seconds)


def ext_counts(files: DataFrame) -> DataFrame:
    """(course, ext, n): visible files per course and ending."""
    shown = files.filter(file_visible(F.col("name")))
    return shown.groupBy("course", suffix_of(F.col("name")).alias("ext")).agg(F.count("*").alias("n"))


def recent_files(files: DataFrame, limit: int = 5, order: Sequence[str] = ("name",)) -> DataFrame:
    """The most recently modified files per course; each task keeps only its own best."""
    newest = Window.partitionBy("course").orderBy(F.desc("mtime"), *order)
    shown = files.filter(file_visible(F.col("name"), recent=True))
    return shown.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def existing_file_semi(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose (dir, name) is already there."""
    return wanted.join(existing.select("dir", "name"), ["dir", "name"], "left_semi")

"""Structured Streaming forms: domain metrics, silent workers, resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import cut
from pagemill.streaming.keyed import KeyedTable


def stream_domain_metrics(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, errors, bytes and mean latency per domain and window. Rows later than
    the watermark are dropped. Counts are combined before the shuffle, so a busy domain
    is no hot key. In update mode (``upsert_available``) open windows are given as they stand."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "domain")
        .agg(
            F.count_if("ok").alias("requests"),
            F.count_if(~F.col("ok")).alias("errors"),
            F.sum(F.when(F.col("ok"), F.col("bytes")).otherwise(0)).alias("bytes"),
            F.avg(F.when(F.col("ok"), F.col("latency"))).alias("avg_latency"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "domain",
            "requests",
            "errors",
            "bytes",
            "avg_latency",
        )
    )


def stream_silent_workers(beats: DataFrame, interval_seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """(worker_id, first_beat, last_beat): runs of heartbeats that ended because the worker
    was silent for twice the health check interval."""
    gap = 2 * interval_seconds
    return (
        beats.withWatermark("ts", late)
        .groupBy(F.session_window("ts", f"{gap} seconds"), "worker_id")
        .agg(F.min("ts").alias("first_beat"), F.max("ts").alias("last_beat"), F.count("*").alias("beats"))
        .select("worker_id", "first_beat", "last_beat", "beats")
    )


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, append it to parquet files at ``sink`` and stop. A second
    run with the same checkpoint goes on where the first one stopped."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_available(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Process what is there and commit the changed rows of every batch to ``table``, whose latest rows are then the
    result: also that of windows which are still open. A run with the same checkpoint goes on."""

    def write(rows: DataFrame, batch: int) -> None:
        table.commit(rows, checkpoint, batch)

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def incremental_extract(
    spark: SparkSession,
    source: str,
    schema: str,
    sink: str,
    checkpoint: str,
    extract: Callable[[DataFrame], DataFrame],
    source_format: str = "parquet",
) -> KeyedTable:
    """Run ``extract`` over pages that arrived since the last run and whose URLs were in no run before. The table at
    ``sink`` has the done URLs; the rows extracted are attached to it under ``results``.

    A batch's URLs meet the done ones in an anti join, so no state is kept by the stream, and runs with another
    checkpoint know them too. Of captures that arrive together, the least in the order of the other columns (the first
    ``page_id``) is read. A batch that is run again after its
    commit adds nothing; URLs and results of a batch come in one commit. A page without a URL is read each time."""
    done = KeyedTable(spark, sink, ["url"])

    def write(pages: DataFrame, batch: int) -> None:
        if done.committed(checkpoint, batch):
            return
        rest = F.struct(*[c for c in pages.columns if c != "url"])
        named = pages.filter("url IS NOT NULL").groupBy("url").agg(F.min(rest).alias("_first"))
        named = named.select("url", "_first.*").select(*pages.columns)
        fresh = cut(done.new(named, "url string").unionByName(pages.filter("url IS NULL")))
        done.commit(fresh.filter("url IS NOT NULL").select("url"), checkpoint, batch, results=extract(fresh))

    pages = spark.readStream.schema(schema).format(source_format).load(source)
    query = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done

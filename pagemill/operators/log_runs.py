"""What a fetch log shows about failures and pace: runs of failures, and requests that came too soon.

Both go over the log in time order without a hot domain (see ``ordered``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import micros
from pagemill.operators.ordered import BLOCK, numbered, ordered_blocks, running_over

_ORDER = ["ts", "request_id"]


def failure_runs(log: DataFrame) -> DataFrame:
    """(domain, successes_before, failures, first_failure, last_failure, recovered): every run of failed requests
    of a domain in the order of time and request, and whether a success came after it."""
    blocks = ordered_blocks(log.select("domain", *_ORDER, "ok"), ["domain"], _ORDER)
    good = F.col("ok").cast("long")
    counted = running_over(blocks, ["domain"], _ORDER, {"successes_before": ("sum", good)}).drop(BLOCK)
    runs = (
        counted.filter(~F.col("ok"))
        .groupBy("domain", "successes_before")
        .agg(F.count("*").alias("failures"), F.min("ts").alias("first_failure"), F.max("ts").alias("last_failure"))
    )
    totals = log.groupBy(F.col("domain").alias("_d")).agg(F.count_if("ok").alias("_s"))
    joined = runs.join(totals, F.col("domain").eqNullSafe(F.col("_d")))
    return joined.select(*runs.columns, (F.col("_s") > F.col("successes_before")).alias("recovered"))


def short_gaps(log: DataFrame, delay_seconds: Column | float) -> DataFrame:
    """(request_id, domain, gap_seconds): requests that came sooner after the one before them, in the same domain,
    than the crawl delay allows."""
    rows = numbered(log.select("domain", *_ORDER), ["domain"], _ORDER, "_n")
    # One row per (domain, place) on either side: a busy domain is spread over its places.
    before = rows.select(F.col("domain").alias("_d"), (F.col("_n") + 1).alias("_m"), micros(F.col("ts")).alias("_t"))
    joined = rows.join(before, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("_n") == F.col("_m")))
    gap = (micros(F.col("ts")) - F.col("_t")) / 1e6
    delay = F.lit(delay_seconds) if isinstance(delay_seconds, (int, float)) else delay_seconds
    return joined.select("request_id", "domain", gap.alias("gap_seconds")).filter(F.col("gap_seconds") < delay)

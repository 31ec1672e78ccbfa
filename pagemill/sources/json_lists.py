"""URL lists in JSON files of any size, read by several tasks.

A JSON text is cut at its quotes. The pieces of a split of the file come from one task, in order; whether a quote
ends a string or is escaped shows in the piece before it. Running sums over the pieces then tell which of them stand
inside a string, how deep the brackets are, and what the last top-level key was, so a file is never in one task or
row. A string is as long as one row at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.ordered import BLOCK, ordered_blocks, running_over
from pagemill.session import cut


def _count(text: Column, brackets: str) -> Column:
    return F.regexp_count(text, F.lit(brackets)).cast("long")


def json_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, text) of the texts between unescaped quotes, numbered in their file: strings, still with their escapes,
    have odd numbers, what stands between strings even ones."""
    pieces = spark.read.option("lineSep", '"').text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("piece"),
        F.col("value").alias("text"),
    )
    # A quote behind an odd number of backslashes is escaped.
    ends = (F.length(F.regexp_extract("text", r"(\\*)$", 1)) % 2 == 0).cast("long")
    order = ["split", "piece"]
    blocks = ordered_blocks(pieces.withColumn("ends", ends), ["file"], order)
    counted = running_over(blocks, ["file"], order, {"_upto": ("sum", F.col("ends"))}).drop(BLOCK)
    placed = counted.withColumn("no", F.col("_upto") - F.col("ends"))
    whole = F.array_sort(F.collect_list(F.struct("split", "piece", "text")))
    joined = placed.groupBy("file", "no").agg(whole.alias("_p"))
    return joined.select("file", "no", F.array_join(F.transform("_p", lambda p: p["text"]), '"').alias("text"))


def listed_urls(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, url) of the URLs in JSON lists: strings in a top-level array, values of ``url`` in its objects, and the
    same in the array ``urls`` of a top-level object. A file may hold several texts, one after the other. Values that
    are no strings give no URL, an empty file no rows."""
    tokens = cut(json_tokens(spark, path))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    between = tokens.filter("no % 2 = 0").select(
        "file",
        "no",
        text.alias("marks"),
        (_count(F.col("text"), r"[\[{]") - _count(F.col("text"), r"[\]}]")).alias("_step"),
        # The bracket that opens a text: the first of the file, or one that follows a closed text without a comma.
        F.regexp_extract("text", r"^\s*([\[{])", 1).alias("_first"),
        F.regexp_extract("text", r"[\]}]\s*([\[{])", 1).alias("_next"),
    )
    marked = between.select("file", "no", "marks", "_step", F.when(F.col("no") == 0, F.col("_first")).otherwise(F.col("_next")).alias("_open"))
    # Keys: strings that a colon follows, with what stands behind it.
    keys = tokens.filter("no % 2 = 1").join(
        marked.select("file", (F.col("no") - 1).alias("no"), F.col("marks").alias("_behind")), ["file", "no"], "left"
    )
    strings = keys.select("file", "no", "text", F.coalesce(F.col("_behind").startswith(":"), F.lit(False)).alias("is_key"), "_behind")
    line = strings.select("file", "no", "text", "is_key", "_behind", F.lit(0).cast("long").alias("_step"), F.lit("").alias("_open"), F.lit("").alias("marks"))
    line = line.unionByName(
        marked.select("file", "no", F.lit("").alias("text"), F.lit(False).alias("is_key"), F.lit("").alias("_behind"), "_step", "_open", "marks")
    )
    blocks = ordered_blocks(line, ["file"], ["no"])
    deep = running_over(blocks, ["file"], ["no"], {"depth": ("sum", F.col("_step"))})
    flag = lambda test: F.col("no") * 2 + test.cast("long")
    # The last opening bracket of a text, and the last key at depth 1: is it an array named urls?
    named = (F.col("text") == "urls") & F.col("_behind").startswith(": [") | (F.col("text") == "urls") & F.col("_behind").startswith(":[")
    facts = {
        "_top": ("max", F.when(F.col("_open") != "", flag(F.col("_open") == "{"))),
        "_last": ("max", F.when(F.col("is_key") & (F.col("depth") == 1), flag(named))),
    }
    known = running_over(deep, ["file"], ["no"], facts).drop(BLOCK)
    known = cut(known.select("file", "no", "text", "marks", "is_key", "depth", (F.col("_top") % 2 == 1).alias("_object"), (F.col("_last") % 2 == 1).alias("_urls")))
    before = known.filter("no % 2 = 0").select("file", (F.col("no") + 1).alias("no"), F.col("marks").alias("_before"))
    owner = known.filter("is_key").select("file", (F.col("no") + 2).alias("no"), F.col("text").alias("_owner"))
    found = known.filter("no % 2 = 1 AND NOT is_key").join(before, ["file", "no"], "left").join(owner, ["file", "no"], "left")
    inner = F.col("depth") - F.when(F.col("_object"), F.lit(1)).otherwise(0)
    listed = ~F.col("_object") | F.coalesce("_urls", F.lit(False))
    valued = F.coalesce(F.col("_before").endswith(":"), F.lit(False))
    kept = found.filter(
        listed & (((inner == 1) & ~valued) | ((inner == 2) & valued & (F.col("_owner") == "url")))
    )
    plain = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), "text", F.lit('"'))), "$", "string")
    return kept.select("file", "no", plain.alias("url"))

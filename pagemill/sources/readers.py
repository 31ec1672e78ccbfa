"""Readers: URL lists, pages, sitemaps, robots files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.functions.urls import harvest_urls, is_valid_url_basic
from pagemill.sources.json_lists import listed_urls


def _kept(urls: DataFrame, validate: bool) -> DataFrame:
    kept = urls.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    return kept.filter(is_valid_url_basic(F.col("url"))) if validate else kept


def json_urls(text: Column) -> Column:
    """ARRAY<STRING> of a JSON URL list: texts, objects with ``url``, or ``{"urls": []}``."""

    def one(item: Column) -> Column:
        return F.coalesce(
            F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string")),
            F.try_variant_get(item, "$.url", "string"),
        )

    parsed = F.try_parse_json(text)
    items = F.coalesce(
        F.try_variant_get(parsed, "$", "array<variant>"), F.try_variant_get(parsed, "$.urls", "array<variant>")
    )
    return F.transform(items, one)


def urls_json(spark: SparkSession, path: str, validate: bool = False) -> DataFrame:
    """URLs of JSON list files: texts, objects with ``url``, or ``{"urls": []}``. Files of any size are read by several
    tasks (``json_lists``); ``json_urls`` reads texts that are cells."""
    return _kept(listed_urls(spark, path).select("url"), validate)


def urls_xml(spark: SparkSession, path: str) -> DataFrame:
    """Text of every ``url`` and ``link`` element."""

    def texts(tag: str) -> DataFrame:
        rows = spark.read.format("xml").schema("_VALUE string, _id string").option("rowTag", tag).load(path)
        return rows.select(F.col("_VALUE").alias("url"))

    return _kept(texts("url").unionByName(texts("link")), False)


def urls_csv(spark: SparkSession, path: str) -> DataFrame:
    """First column of every row; there is no header."""
    rows = spark.read.schema("url string").option("header", False).option("enforceSchema", True).csv(path)
    return _kept(rows, False)


def urls_text(spark: SparkSession, path: str, comments: bool = True, validate: bool = False) -> DataFrame:
    """Trimmed lines that are not empty; with ``comments``, lines starting with ``#`` go."""
    lines = spark.read.text(path)
    if comments:
        lines = lines.filter(~F.col("value").startswith("#"))
    return _kept(lines.select(strip(F.col("value")).alias("url")), validate)


def urls_harvest(texts: DataFrame, column: str = "text") -> DataFrame:
    """Every valid URL found in free text, duplicates kept."""
    return _kept(texts.select(F.explode(harvest_urls(F.col(column))).alias("url")), True)


def urls_file(spark: SparkSession, path: str) -> DataFrame:
    """URL list in the format its name ends with."""
    low = path.lower()
    if low.endswith(".json"):
        return urls_json(spark, path, validate=True)
    if low.endswith((".txt", ".list")):
        return urls_text(spark, path, validate=True)
    return urls_harvest(spark.read.text(path), "value")


def pages_table(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    schema = "page_id long, url string, html string"
    return spark.read.schema(schema).format(source_format).load(path)


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(host, body) of files named ``HOST.robots.txt``."""
    files = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    host = F.regexp_extract("_f", r"([^/]+)\.robots\.txt$", 1)
    return files.select(host.alias("host"), F.col("value").alias("body"))


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod, changefreq, priority) of XML sitemap files, ``.gz`` by name. The
    files are split by element, so one of any size is read in parallel."""
    schema = "loc string, lastmod string, changefreq string, priority string"
    rows = (
        spark.read.format("xml").schema(schema).option("rowTag", "url").option("ignoreNamespace", True).load(path)
    )
    kept = rows.withColumns({"loc": strip(F.col("loc")), "priority": F.col("priority").try_cast("double")})
    return kept.filter(F.col("loc").isNotNull() & (F.col("loc") != ""))

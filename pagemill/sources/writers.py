"""Writers: every task writes its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.files import sanitize_filename, type_folder


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, nested values kept; absent values are written as null."""
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, names: dict[str, str]) -> None:
    """CSV with a header; ``names`` maps columns to header texts, e.g. ``{"url": "URL"}``."""
    rows.select(*[F.col(c).alias(n) for c, n in names.items()]).write.mode("errorifexists").csv(path, header=True)


def write_text(urls: DataFrame, path: str, column: str = "url") -> None:
    """One URL per line."""
    urls.select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)


def write_report(lines: DataFrame, path: str, order: list[str]) -> None:
    """Report lines in order, over as many files as the report needs."""
    lines.orderBy(*order).select("line").write.mode("errorifexists").text(path)


def write_catalog(files: DataFrame, path: str) -> None:
    """File catalog laid out by course and type folder."""
    folder = F.when(type_folder(F.col("type")) == "", ".").otherwise(type_folder(F.col("type")))
    laid = files.withColumns({"course": sanitize_filename(F.col("course")), "type_dir": folder})
    # Rows of a folder go to few files; a folder with very many rows gets several tasks.
    laid = laid.hint("rebalance", "course", "type_dir")
    laid.write.mode("errorifexists").partitionBy("course", "type_dir").parquet(path)

"""Columns and helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows with long lists that travel to Python together, at most.
LIST_ROWS = 2_000
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Jobs that run inside read at most so many rows, or ``LIST_ROWS``, at once and send no more to Python: the default batch
    holds the word hashes of 10,000 documents, in the JVM and in Python, for each task."""
    rows = rows or LIST_ROWS
    before = {name: int(spark.conf.get(name)) for name in _BATCHES}
    for name, n in before.items():
        spark.conf.set(name, str(min(n, rows) if n > 0 else rows))
    try:
        yield
    finally:
        for name, n in before.items():
            spark.conf.set(name, str(n))


def unsized(rows: DataFrame) -> DataFrame:
    """``rows``, whose joins sort and never broadcast. Spark sizes a table by its file and by one entry for each list, so a table of
    lists, and what is exploded from one, may be many times as large as Spark takes it for."""
    return rows.hint("merge")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngram_hashes(listed: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` entries of an array; none if it is shorter."""
    return let(
        listed,
        lambda w: F.when(
            F.size(w) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )

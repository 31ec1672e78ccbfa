"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the columns of
``documents``; the last adds the piece ids. ``run`` writes a stage's result as Parquet to the
shared folder and gives it to the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table
from pagemill.llm.mixing import mixed_rows
from pagemill.llm.near_dedup import without_near_duplicates
from pagemill.llm.quality_rules import quality_rules
from pagemill.llm.sentence_pieces import encode
from pagemill.llm.substring_dedup import without_repeats
from pagemill.session import cut


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; ``n_chars`` follows the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines that fail a rule go, and so do documents that the rules reject."""
    judged = quality_rules(docs).filter("kept").withColumn("text", F.col("clean_text"))
    return _with_length(judged, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the document with the smallest id stays."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: words of windows that a document with a smaller id also has go."""
    return _with_length(without_repeats(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents and parts of them, repeated or left out, to the sources' target weights."""
    return mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the piece ids of every text."""
    return encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", clean_lines),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("sentence_pieces", tokenise),
]

#: Substring removal and encoding cannot be written in SQL here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}

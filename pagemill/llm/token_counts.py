"""Token counts as delta-maintained rollups.

The state is a folder of committed batches. A batch holds signed sums by source, language and tokenizer
version: documents and tokens that came, minus those that went. Totals are the sums over all batches, so
inserts, deletes and revised counts need nothing but their own rows. A batch is written in one commit
under its id; running it again replaces it, which changes nothing."""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table, words
from pagemill.session import cut, shared_path

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts a text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BPE, WORDS = "byte_bpe_50k", "words-1"
KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
MANIFEST = "batch string, version string"


def bpe_counts(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``docs`` without the text and with ``tokens``, the tokens of the whole text; 0 for a null one. The rank
    file is read on the driver and travels to the executors."""
    with open(ranks, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(text).to_pylist()]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(counts, pa.int64())], [*names, "tokens"])

    rest = docs.drop("tokens")
    schema = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes if c != text)
    return rest.mapInArrow(run, f"{schema}, tokens bigint" if schema else "tokens bigint")


def _sums(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Signed sums of rows with the keys and ``tokens``."""
    sums = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return sums.select(*KEYS, (sign * F.col("docs")).alias("docs"), (sign * F.col("tokens")).alias("tokens"))


def deltas(
    inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """The signed sums of one batch. Rows have ``source, lang, tokenizer, tokens``, one per document; ``revised``
    has the rows as they were and as they are now. Null keys are groups of their own, null tokens count 0."""
    parts = [_sums(x, s) for x, s in ((inserted, 1), (deleted, -1), *zip(revised or (), (-1, 1))) if x is not None]
    if not parts:
        raise ValueError("a batch needs rows")
    both = reduce(DataFrame.unionByName, parts).groupBy(*KEYS)
    return both.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def commit(changes: DataFrame, state: str, batch: str) -> None:
    """Write the sums of batch ``batch``, in as many files as they come in. Committing the same id again replaces it:
    each commit is a version of its own, and the last that the manifest names counts. A row of the
    manifest is written after all others, so readers see a batch whole, as it was or as it is."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = changes.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")])
    rows.write.parquet(f"{state}/sums/version={version}")
    named = changes.sparkSession.createDataFrame([(batch, version)], MANIFEST).coalesce(1)
    named.write.mode("append").parquet(f"{state}/manifest")


def totals(spark: SparkSession, state: str) -> DataFrame:
    """``source, lang, tokenizer, docs, tokens`` over all committed batches; groups without documents are left out."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{state}/manifest")
    last = manifest.groupBy("batch").agg(F.max("version").alias("version"))
    rows = spark.read.schema(f"{SCHEMA}, version string").parquet(f"{state}/sums").join(last, "version")
    sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.filter("docs <> 0 OR tokens <> 0")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rollups of all documents, kept in three batches: every document's BPE tokens are inserted, so are its words
    as a second tokenizer version, and the copies of a text are deleted but for that of the smallest id. The last
    batch is committed twice, which counts once."""
    docs = table(spark, folder, "documents")
    counted = bpe_counts(
        docs.select(
            "doc_id", "source", "lang", F.md5("text").alias("print"), F.size(words(F.col("text"))).cast("bigint").alias("words"), "text"
        )
    )
    ledger = cut(counted)
    versions = {BPE: F.col("tokens"), WORDS: F.col("words")}

    def rows(frame: DataFrame, version: str) -> DataFrame:
        return frame.select("source", "lang", F.lit(version).alias("tokenizer"), versions[version].alias("tokens"))

    state = shared_path(spark, "rollup")
    for version in versions:
        commit(deltas(inserted=rows(ledger, version)), state, f"load {version}")
    # Rows without a text are no copies of each other.
    texts = ledger.filter("print IS NOT NULL")
    first = texts.groupBy("print").agg(F.min(F.struct("doc_id", "source", "lang", "tokens", "words")).alias("r")).select("r.*")
    for version in versions:
        gone = deltas(revised=(rows(texts, version), rows(first, version)))
        for _ in range(2):
            commit(gone, state, f"copies {version}")
    return totals(spark, state)


QUERIES = {"op5_token_counts": (op5_token_counts, None)}

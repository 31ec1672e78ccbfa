"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, over characters.

Every character is a symbol of its own, so the model has as many runs of ``ORDER`` symbols as the trusted text holds and
grows with it. Runs are counted over all trusted text and summed in shards; discounts, back-off weights and
probabilities come from joins of the counts of one order with those of their contexts and of the order
below. The model stays a table: texts are dealt into blocks, the different runs of each block are joined
with their probabilities, and a block's texts meet its part of the model where they get their perplexity. A
document is kept if that is no higher than a quantile of the trusted documents of its language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table
from pagemill.llm.sketch import filter_column, filter_of
from pagemill.session import cut

ORDER = 4
SYMBOLS = 48
#: Share of a language's trusted documents that are kept, and how far above their limit others may be.
QUANTILE = 0.995
SLACK = 1.05
#: Characters that are worked on at once.
CHUNK_CHARS = 1 << 20
#: Characters of the texts that ask the model for their runs together.
BLOCK_CHARS = 1 << 23
#: Characters that share a class of ``CLASSES``.
_GROUPS = (*"abcdefghijklmnopqrstuvwxyz", " ", "\n", ".", ",", "!?", ";:'\"-()", "|", "#", "*", "$", "%", "&", "<>/@=_")
_CAPITAL, _DIGIT, _ACCENTED, _SIGN, _OTHER = (len(_GROUPS) + i for i in (0, 1, 2, 6, 7))
assert _OTHER + 2 <= SYMBOLS


def _fold_table() -> np.ndarray:
    """Classes of the characters below 0x250: the groups above, else capitals, digits, accented letters by
    their place, and the rest."""
    own = {c: i for i, group in enumerate(_GROUPS) for c in group}
    out = np.full(0x250, _SIGN)
    for code in range(0x250):
        letter = chr(code)
        if letter in own:
            out[code] = own[letter]
        elif letter.isupper():
            out[code] = _CAPITAL
        elif letter.isdigit():
            out[code] = _DIGIT
        elif letter.isalpha():
            out[code] = _ACCENTED + code % 4
    return out


_FOLD = _fold_table()


class Alphabet(NamedTuple):
    """How many symbols there are, and those of an array of code points."""

    symbols: int
    of: Callable[[np.ndarray], np.ndarray]


def _classes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], _OTHER + (codes >= 0x3000))


#: Code points below ``_PLAIN`` and those of Hangul syllables are one symbol each. All others are two, of which the first
#: stands for the upper bits, so different texts have different symbols and a run still fits 63 bits.
_PLAIN, _HANGUL, _HANGULS, _LOW_BITS = 0xA000, 0xAC00, 0x2BB0, 10
_HIGH = _PLAIN + _HANGULS
_LOW = _HIGH + (0x10FFFF >> _LOW_BITS) + 1


def _characters(codes: np.ndarray) -> np.ndarray:
    hangul = (codes >= _HANGUL) & (codes < _HANGUL + _HANGULS)
    out = np.where(hangul, codes - _HANGUL + _PLAIN, codes)
    pairs = (codes >= _PLAIN) & ~hangul
    if not pairs.any():
        return out
    place = np.arange(len(codes)) + np.cumsum(pairs)
    both = np.empty(len(codes) + int(pairs.sum()), np.int64)
    both[place] = np.where(pairs, _LOW + (codes & ((1 << _LOW_BITS) - 1)), out)
    both[place[pairs] - 1] = _HIGH + (codes[pairs] >> _LOW_BITS)
    return both


#: Few enough symbols for a table of all runs, see ``log_probabilities``; and the alphabet of the classifier.
CLASSES = Alphabet(SYMBOLS, _classes)
CHARACTERS = Alphabet(_LOW + (1 << _LOW_BITS), _characters)
assert CHARACTERS.symbols**ORDER < 1 << 63


def runs(text: str, alphabet: Alphabet = CLASSES) -> np.ndarray:
    """The run of ``ORDER`` symbols that ends at each symbol from the ``ORDER``-th on, as a number."""
    kinds = alphabet.of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
    n = len(kinds) - ORDER + 1
    if n <= 0:
        return kinds[:0]
    out = kinds[:n].copy()
    for i in range(1, ORDER):
        out = out * alphabet.symbols + kinds[i : i + n]
    return out


def _counted(alphabet: Alphabet):
    """Counts of the runs of each batch of texts."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                parts.append(runs(text.as_py() or "", alphabet))
                size += len(parts[-1])
                if size >= CHUNK_CHARS:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2, and 3 and more, from how many runs have counts 1 to 4."""
    n = {r["n"]: r["c"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def train(texts: DataFrame, alphabet: Alphabet = CLASSES) -> DataFrame:
    """The model of the column ``text``: ``size, code, p`` for every run of 1 to ``ORDER`` symbols that occurs, and
    ``gamma``, the back-off weight of the run as a context; one of the two may be null."""
    symbols = alphabet.symbols
    counts = texts.mapInArrow(_counted(alphabet), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    orders = {ORDER: cut(counts)}
    for size in range(ORDER - 1, 0, -1):
        # A shorter run counts the different symbols that stand before it.
        tail = (F.col("code") % (symbols**size)).alias("code")
        orders[size] = cut(orders[size + 1].select(tail).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    model, below = {}, None
    gammas = {}
    for size in range(1, ORDER + 1):
        d = _discounts(orders[size])
        n = F.col("n")
        rows = orders[size].withColumns(
            {
                "context": F.expr(f"code div {symbols}"),
                "tail": F.col("code") % symbols ** (size - 1),
                "off": F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]),
            }
        )
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("gamma"))
        gammas[size] = contexts.select(F.col("context").alias("code"), "gamma")
        joined = rows.join(contexts, "context").withColumn("own", (F.col("n") - F.col("off")) / F.col("total"))
        if below is None:
            joined = joined.withColumn("p", F.col("own") + F.col("gamma") / symbols)
        else:
            lower = below.select(F.col("code").alias("tail"), F.col("p").alias("q"))
            joined = joined.join(lower, "tail").withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        below = model[size] = cut(joined.select("code", "p"))
    parts = []
    for size in range(ORDER + 1):
        p = model[size] if size else texts.sparkSession.createDataFrame([(0, 1.0)], "code bigint, p double")
        gamma = gammas[size + 1] if size < ORDER else None
        # The first symbols of a text are a context, though nothing stands before them that would count them.
        both = p.join(gamma, "code", "full") if gamma is not None else p.withColumn("gamma", F.lit(None).cast("double"))
        parts.append(both.select(F.lit(size).alias("size"), "code", "p", "gamma"))
    return cut(reduce(DataFrame.unionByName, parts))


def log_probabilities(model: DataFrame) -> np.ndarray:
    """Natural logarithm of the last symbol's probability for each of the ``SYMBOLS ** ORDER`` runs of a model over
    ``CLASSES``, the plain form of ``_asked``."""
    rows = model.toArrow()
    size, code, p, gamma = (rows.column(n).to_numpy() for n in ("size", "code", "p", "gamma"))
    below = np.full((1, SYMBOLS), 1.0 / SYMBOLS, np.float32)
    for n in range(1, ORDER + 1):
        # A row per context; behind a context stand the same symbols as behind its tail, weighted.
        context = (size == n - 1) & ~np.isnan(gamma)
        weight = np.ones(SYMBOLS ** (n - 1), np.float32)
        weight[code[context]] = gamma[context]
        here = np.tile(below, (SYMBOLS if n > 1 else 1, 1))
        here *= weight[:, None]
        seen = (size == n) & ~np.isnan(p)
        here.ravel()[code[seen]] = p[seen]
        below = here.reshape(-1, SYMBOLS)
    return np.log(below, out=below).ravel()


def _asked(codes: DataFrame, model: DataFrame, symbols: int) -> DataFrame:
    """``code, p``: the last symbol's probability for each of the different runs ``codes``, seen or not."""
    asked = {ORDER: codes}
    for size in range(ORDER - 1, 0, -1):
        asked[size] = asked[size + 1].select((F.col("code") % symbols**size).alias("code")).distinct()
    start = model.filter("size = 0").first()["gamma"] / symbols
    below = None
    for size in range(1, ORDER + 1):
        seen = model.filter((F.col("size") == size) & F.col("p").isNotNull()).select("code", "p")
        rows = asked[size].join(seen, "code", "left")
        if below is None:
            below = rows.select("code", F.coalesce("p", F.lit(start)).alias("p"))
        else:
            gammas = model.filter((F.col("size") == size - 1) & F.col("gamma").isNotNull())
            gammas = gammas.select(F.col("code").alias("context"), "gamma")
            lower = below.select(F.col("code").alias("tail"), F.col("p").alias("q"))
            # Only runs that were not seen back off.
            rest = rows.filter("p IS NULL").select(
                "code", F.expr(f"code div {symbols}").alias("context"), (F.col("code") % symbols ** (size - 1)).alias("tail")
            )
            rest = rest.join(gammas, "context", "left").join(lower, "tail")
            backed = rest.select("code", (F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"))
            below = rows.filter("p IS NOT NULL").unionByName(backed)
        below = cut(below)
    return below


def _blocks(text: str):
    """The rows with the block they are in: runs of a task's rows of about ``BLOCK_CHARS`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            found = []
            for item in batch.column(text):
                if size >= BLOCK_CHARS:
                    block, size = block + 1, 0
                found.append((task << 32) + block)
                size += len(item.as_py() or "")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "_block"])

    return run


def _wanted(text: str, alphabet: Alphabet):
    """The different runs of the texts of a block; those of a block that is met in parts may come again."""

    def flush(block: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        code = np.unique(np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code)], ["_block", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, size = None, [], 0
        for batch in batches:
            for block, item in zip(batch.column("_block").to_pylist(), batch.column(text)):
                if parts and (block != last or size >= CHUNK_CHARS):
                    if block != last:
                        yield flush(last, parts)
                        parts = []
                    else:
                        parts = [np.unique(np.concatenate(parts))]
                    size = 0
                last = block
                parts.append(runs(item.as_py() or "", alphabet))
                size += len(parts[-1])
        if parts:
            yield flush(last, parts)

    return run


def _scored(text: str, alphabet: Alphabet, names: list[str]):
    """Rows come by block, those with runs and logarithms before those with texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes, logs, parts = None, np.zeros(0, np.int64), np.zeros(0), []
        for batch in batches:
            blocks, listed = batch.column("_block").to_pylist(), batch.column("_codes").is_valid().to_pylist()
            rows, found = [], []
            for i, block in enumerate(blocks):
                if block != last:
                    last, codes, logs, parts = block, np.zeros(0, np.int64), np.zeros(0), []
                if listed[i]:
                    parts.append([batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("_codes", "_logs")])
                    continue
                if parts:
                    codes, logs = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(codes)
                    codes, logs, parts = codes[order], logs[order], []
                asked = runs(batch.column(text)[i].as_py() or "", alphabet)
                rows.append(i)
                found.append(float(np.exp(-logs[np.searchsorted(codes, asked)].mean())) if len(asked) else None)
            held = [batch.column(n).take(pa.array(rows, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([*held, pa.array(found, pa.float64())], [*names, "perplexity"])

    return run


def perplexities(docs: DataFrame, model: DataFrame, text: str = "text", alphabet: Alphabet = CHARACTERS) -> DataFrame:
    """``docs`` without the text and with ``perplexity`` per symbol; null for a text of less than ``ORDER``
    symbols."""
    rest = docs.drop("perplexity")
    names = [c for c in rest.columns if c != text]
    plain = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    kept = ", ".join([*(f"`{c}` {t}" for c, t in rest.dtypes if c != text), "perplexity double"])
    # Written, so that a row is in the same block whenever it is read.
    dealt = cut(rest.mapInArrow(_blocks(text), f"{plain}, _block bigint"))
    wanted = cut(dealt.select("_block", text).mapInArrow(_wanted(text, alphabet), "_block bigint, code bigint").distinct())
    known = _asked(wanted.select("code").distinct(), model, alphabet.symbols)
    # In lists, so that few rows travel to the texts.
    tables = wanted.join(known, "code").groupBy("_block", F.pmod("code", F.lit(61)).alias("_part"))
    tables = tables.agg(F.collect_list("code").alias("_codes"), F.collect_list(F.log("p")).alias("_logs")).drop("_part")
    both = dealt.unionByName(tables, allowMissingColumns=True).withColumn("_late", F.col("_codes").isNull())
    both = both.repartition("_block").sortWithinPartitions("_block", "_late")
    return both.mapInArrow(_scored(text, alphabet, names), kept)


def quality(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, perplexity, limit, kept`` for every row of ``docs`` (``doc_id, lang, text``); ``trusted`` has the
    ids of trusted documents.

    The limit is the quantile over the trusted documents of the language (a null language is one of
    its own), each half of them scored by a model of the other, times ``SLACK``; a language without any takes
    that over all. A document too short for a perplexity is not kept. Equal rows
    are judged alike. Without any trusted text all perplexities are null and nothing is kept."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("bigint").alias("_id")).filter("_id IS NOT NULL").distinct()
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), "lang", "text")
    ids = cut(ids)
    likely = docs.filter(filter_column(filter_of(ids))(F.col("doc_id")))
    # The same join whatever the size of the labels.
    known = cut(likely.join(ids.withColumnRenamed("_id", "doc_id").hint("merge"), "doc_id", "left_semi"))
    model = train(known.select("text"), CHARACTERS)
    if model.filter(F.col("size") == ORDER).isEmpty():
        empty = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", empty.alias("perplexity"), empty.alias("limit"), F.lit(False).alias("kept"))
    scored = cut(perplexities(docs, model))
    # Text that a model has seen looks better to it than other text, so limits come from halves it has not seen.
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    halves = [known.filter(half == i) for i in range(2)]
    sure = cut(
        perplexities(halves[0], train(halves[1].select("text"), CHARACTERS)).unionByName(perplexities(halves[1], train(halves[0].select("text"), CHARACTERS)))
    )
    limit = (F.percentile_approx("perplexity", quantile, 10_000) * SLACK).alias("limit")
    overall = sure.agg(limit).first()["limit"]
    limits = sure.groupBy(F.col("lang").alias("_lang")).agg(limit)
    judged = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    judged = judged.withColumn("limit", F.coalesce("limit", F.lit(overall).cast("double")))
    return judged.select("doc_id", "lang", "perplexity", "limit", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(False)).alias("kept"))


def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole document under the model of all documents labelled as good and not toxic."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    found = quality(table(spark, folder, "documents"), labels.filter("q = 1 AND t = 0").select("doc_id"))
    return found.select("doc_id", F.round("perplexity", 9).alias("perplexity"), "kept")


QUERIES = {"op9_quality_model": (op9_quality_model, None)}

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents lie in shards of about ``SHARD_DOCS`` documents, so that the hottest source
is only more shards. A shard is one stream of words in a seeded order, cut into equal blocks. All
blocks of the mix go to sources by highest quotients, then within a source to groups of shards and
on to shards, so each shard has an integer quota. The quota's full rounds take the whole shard; the
rest takes seeded blocks of it."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import let, table, words

WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken at most so many times over.
MOST_REPEATS = 3
#: Words of a block, about.
BLOCK_WORDS = 64
SHARD_DOCS = 2000
#: Shards that are apportioned together.
FAN_OUT = 1024
#: The table of sources is a configuration: its rows come to the driver, up to this many.
MOST_SOURCES = 100_000
#: Larger than any number of blocks in a shard, so it shares no divisor with it.
PRIME = 2147483647


def quotas(weights: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients ``w / 1, w / 3, w / 5, ...``; entry i gets at most ``most[i]``.
    Equal quotients go to the earlier entry. The common divisor is found by bisection, so the cost
    does not depend on the number of seats."""
    weights, most = np.asarray(weights, float), np.where(np.asarray(weights) > 0, most, 0).astype(np.int64)
    seats = min(int(seats), int(most.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(weights / divisor + 0.5), most).astype(np.int64)

    low, high = weights[weights > 0].min() / (2 * seats + 1), 4 * weights.max()
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if at(middle).sum() <= seats else (middle, high)
    got = at(high)
    queue = [(-w / (2 * k + 1), i) for i, (w, k, m) in enumerate(zip(weights, got, most)) if k < m]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: np.ndarray, weights: np.ndarray, repeats: float = MOST_REPEATS) -> np.ndarray:
    """The words each source should give: all words shared out by weight, a share above
    ``repeats`` times its source cut to that and its excess shared anew, until none is above."""
    sizes, left = np.asarray(sizes, float), np.ones(len(sizes), bool)
    out, rest = np.zeros(len(sizes)), float(np.sum(sizes))
    while left.any():
        share = rest * weights[left] / weights[left].sum()
        above = share > repeats * sizes[left]
        where = np.flatnonzero(left)
        if not above.any():
            out[where] = share
            break
        out[where[above]] = repeats * sizes[where[above]]
        rest = float(np.sum(sizes)) - out.sum()
        left[where[above]] = False
    return out


def _share_out(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The quota of each group (``keys``) goes to its parts: ``part``, and its ``quota``. ``parts``
    has per part ``_size``, ``_blocks`` and the group's ``_quota``."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(part)
        got = quotas(group["_size"].to_numpy(), MOST_REPEATS * group["_blocks"].to_numpy(), int(group["_quota"].iloc[0]))
        return group.assign(_got=got)[[*keys, part, "_got"]]

    kinds = dict(parts.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, part]) + ", _got bigint"
    return parts.select(*keys, part, "_size", "_blocks", "_quota").groupBy(*keys).applyInPandas(one, schema)


def _chosen(j: Column, blocks: Column, rest: Column, seed: Column) -> Column:
    """Whether block ``j`` of a shard is among the ``rest`` seeded ones: a permutation of the
    blocks puts it below ``rest``."""
    return F.pmod(j * F.pmod(F.lit(PRIME), blocks) + F.pmod(seed, blocks), blocks) < rest


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """``docs`` with ``size`` (words of ``text``), ``source_size``, ``target`` of its source, ``copies``
    (whole times it is taken), ``pieces`` (word ranges taken once more, from and to, the last excluded)
    and ``taken`` (words taken, repeats counted).

    Sources in order of their code points, null last, weigh ``weights``, repeating. A null or empty
    text has size 0 and nothing of it is taken. Documents of equal id and size may change places in
    their stream, which changes no result but between rows that are alike. Null ids and repeated rows
    are documents of their own. Columns that have a new column's name are replaced. With no words at
    all every target is 0; an empty table gives an empty one."""
    spark = docs.sparkSession
    sized = docs.withColumn("size", F.size(words(F.col("text"))).cast("bigint"))
    light = sized.select(
        F.col("source").alias("_source"), F.col("doc_id").alias("_doc"), F.col("size").alias("_n")
    )
    found = light.groupBy("_source").agg(F.sum("_n").alias("size"), F.count(F.lit(1)).alias("docs"))
    sources = found.limit(MOST_SOURCES + 1).toPandas()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; raise MOST_SOURCES if the driver can hold them")
    order = sorted(range(len(sources)), key=lambda i: (pd.isna(sources["_source"][i]), sources["_source"][i] or ""))
    sources = sources.iloc[order].reset_index(drop=True)
    n_weights = np.array([weights[i % len(weights)] for i in range(len(sources))], float)
    sources["target"] = targets(sources["size"].to_numpy(), n_weights)
    sources["shards"] = np.ceil(sources["docs"] / SHARD_DOCS).clip(lower=1).astype("int64")
    rows = [
        (None if pd.isna(s) else s, int(n), float(t), int(h), i)
        for i, (s, n, t, h) in enumerate(zip(sources["_source"], sources["size"], sources["target"], sources["shards"]))
    ]
    known = spark.createDataFrame(rows, "_source string, source_size bigint, target double, _shards bigint, _no bigint")

    def placed(frame: DataFrame, name: str) -> DataFrame:
        joined = frame.join(known, F.col(name).eqNullSafe(known["_source"]), "left").drop(known["_source"])
        return joined.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_doc"), "_shards"))

    shards = (
        placed(light.withColumnRenamed("_source", "_s"), "_s")
        .groupBy("_no", "_shard")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_blocks", F.when(F.col("_size") > 0, F.greatest(F.lit(1), F.round(F.col("_size") / block))).otherwise(0).cast("bigint"))
        .withColumn("_group", F.floor(F.col("_shard") / FAN_OUT))
    )
    blocks = {r["_no"]: r["n"] for r in shards.groupBy("_no").agg(F.sum("_blocks").alias("n")).collect()}
    # A block of a source may be a little longer or shorter than ``block``; a quota counts its words.
    own = np.array([n / max(1, blocks[i]) for i, n in enumerate(sources["size"])], float)
    wanted = sources["target"].to_numpy()
    seats = np.array([round(t / b) if b else 0 for t, b in zip(wanted, own)], np.int64)
    most = np.array([MOST_REPEATS * blocks[i] for i in range(len(sources))], np.int64)
    scaled = np.divide(wanted, own, out=np.zeros(len(own)), where=own > 0)
    first = quotas(scaled, most, int(seats.sum()))
    quota = spark.createDataFrame([(i, int(q)) for i, q in enumerate(first)], "_no bigint, _quota bigint")
    groups = shards.groupBy("_no", "_group").agg(F.sum("_size").alias("_size"), F.sum("_blocks").alias("_blocks"))
    per_group = _share_out(groups.join(quota, "_no"), ["_no"], "_group").withColumnRenamed("_got", "_quota")
    per_shard = _share_out(shards.join(per_group, ["_no", "_group"]), ["_no", "_group"], "_shard")
    plan = shards.join(per_shard, ["_no", "_group", "_shard"]).select(
        "_no", "_shard", F.col("_size").alias("_all"), "_blocks", F.col("_got").alias("_quota")
    )

    dealt = placed(sized.withColumns({"_doc": F.col("doc_id"), "_s": F.col("source")}).drop("source_size", "target"), "_s")
    stream = Window.partitionBy("_no", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "_doc"), "_doc", "size")
    end = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.withColumn("_from", end - F.col("size")).join(plan, ["_no", "_shard"], "left")

    n, words_all, size, start = F.col("_blocks"), F.col("_all"), F.col("size"), F.col("_from")
    rest = F.when(n > 0, F.pmod("_quota", n)).otherwise(0)
    mark = F.xxhash64(F.lit(seed + 2), "_no", "_shard")

    def block_of(place: Column) -> Column:
        return F.floor(((place + 1) * n + words_all - 1) / words_all) - 1

    def edge(j: Column) -> Column:
        return F.floor(j * words_all / n)

    spans = F.when(
        (size > 0) & (rest > 0),
        let(
            F.struct(n.alias("n"), rest.alias("rest"), mark.alias("mark"), block_of(start).alias("a"), block_of(start + size - 1).alias("z")),
            lambda s: F.transform(
                F.filter(F.sequence(s.a, s.z), lambda j: _chosen(j, s.n, s.rest, s.mark)),
                lambda j: F.struct(
                    F.greatest(F.lit(0), edge(j) - start).cast("bigint").alias("start"),
                    F.least(size, edge(j + 1) - start).cast("bigint").alias("stop"),
                ),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    out = joined.withColumns({"copies": F.when(size > 0, F.floor(F.col("_quota") / n)).otherwise(0).cast("bigint"), "pieces": spans})
    part = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p.stop - p.start)
    out = out.withColumn("taken", F.col("copies") * size + part)
    return out.drop("_doc", "_s", "_no", "_shard", "_shards", "_from", "_all", "_blocks", "_quota")


def mixed_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every whole copy of a document, and one
    with the words of its pieces, joined by blanks, if it has any. ``n_chars`` follows the text."""
    mixed = mix(docs)
    listed = words(F.col(text))
    cut = F.array_join(
        F.flatten(F.transform("pieces", lambda p: F.slice(listed, (p.start + 1).cast("int"), (p.stop - p.start).cast("int")))), " "
    )
    whole = F.array_repeat(F.col(text), F.col("copies").cast("int"))
    part = F.when(F.size("pieces") > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))
    rows = mixed.withColumn("_text", F.explode(F.concat(whole, part))).withColumn(text, F.col("_text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    sized = docs.withColumn("text", F.col("text"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mixing": (op10_mixing, None)}

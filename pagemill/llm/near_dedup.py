"""MinHash near-dedup by a signature-coordinate inverted join.

Documents of equal shingle sets become one class. A class is posted under the pairs (coordinate,
value) of its signature; pairs that nobody else has are counted and dropped, and of the others only
the rarest are posted: two signatures that agree in ``MATCHES`` coordinates share one of the
``COORDINATES - MATCHES + 1`` rarest of either. Inside a posting list classes meet its most widely
shared member first; lists whose members are linked by then are skipped, and only members of different
components meet after that. Pairs that agree often enough are confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ascii_lower, let, ngram_hashes, table, unsized, word_hashes, words
from pagemill.llm.components import components, joined_components
from pagemill.llm.sketch import _ODD, chunks, filter_column, filter_of, grams, may_hold, mix
from pagemill.session import cut

SHINGLE = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES = 64
#: Coordinates that must agree. Of 64, sets at the limit of 75 % agree in 48 on average, and in fewer
#: than 28 with a chance of 2.5e-8.
MATCHES = 28
#: Members that must have a shingle for each step up in the order of shingles.
STEPS = (1, 8, 64, 512)
#: Shingles of a set that tell whether a pair has met already.
HEAD = 24
#: Shingles that are hashed at once.
BLOCK = 1 << 14


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _ODD)
    return seeds[:COORDINATES] | np.uint64(1), seeds[COORDINATES:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``COORDINATES`` hashes over a set of 64-bit values."""
    times, plus = _multipliers()
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        out = np.minimum(out, (shingles[at : at + BLOCK, None] * times + plus).min(0))
    return (out >> np.uint64(33)).astype(np.int32)


def _shingles(flat: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingles of each document; a document of fewer words has its whole sequence."""
    hashed = grams(flat, SHINGLE)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if end - start >= SHINGLE:
            yield np.unique(hashed[start : end - SHINGLE + 1])
        elif end > start:
            yield mix(grams(flat[start:end], end - start) + np.uint64(end - start))
        else:
            yield hashed[:0]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, flat, offsets in chunks(batch, "w"):
            counts, prints, signs = [], [], []
            for found in _shingles(flat, offsets):
                counts.append(len(found))
                if len(found):
                    both = [mix(found).sum(dtype=np.uint64), mix(found ^ _ODD).sum(dtype=np.uint64)]
                    prints.append(np.array(both, np.uint64).tobytes())
                    signs.append(signature(found))
                else:
                    prints.append(None)
                    signs.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").slice(row, len(counts)),
                    batch.column("row").slice(row, len(counts)),
                    pa.array(counts, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(signs, pa.list_(pa.int32())),
                ],
                ["doc", "row", "n", "print", "sign"],
            )


def _shingle_set(text: Column) -> Column:
    """The same sets on the JVM side, for the documents that need them."""
    whole = lambda w: F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))
    return let(
        words(ascii_lower(text)),
        lambda w: F.when(F.size(w) >= SHINGLE, F.array_distinct(ngram_hashes(w, SHINGLE))).otherwise(whole(w)),
    )


def _prefixes(classes: DataFrame) -> DataFrame:
    """``token, c, fame``: the posting lists of the classes that could agree with another one. ``fame`` sums how
    many classes have each of the class's tokens; the text that others were made from has most."""
    spread = classes.select("c", F.posexplode("sign").alias("i", "v"))
    tokens = spread.select("c", F.shiftleft(F.col("i").cast("bigint"), 32).bitwiseOR(F.col("v").cast("bigint")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    mine = Window.partitionBy("c")
    ranked = unsized(tokens).join(shared, "token").withColumns(
        {
            "known": F.count(F.lit(1)).over(mine),
            "fame": F.sum("seen").over(mine),
            "place": F.row_number().over(mine.orderBy("seen", "token")),
        }
    )
    # A coordinate that nobody shares comes first in the order, so it uses up a place of the prefix.
    return ranked.filter(F.col("place") <= F.col("known") - MATCHES + 1).select("token", "c", "fame")


def _agree(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) >= MATCHES


def _sizes_fit(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sizes and signatures agree."""
    signs = unsized(classes.select("c", "n", "sign"))
    both = pairs.join(signs.withColumnsRenamed({"c": "a", "n": "na", "sign": "sa"}), "a").join(
        signs.withColumnsRenamed({"c": "b", "n": "nb", "sign": "sb"}), "b"
    )
    return both.filter(_sizes_fit(F.col("na"), F.col("nb")) & _agree(F.col("sa"), F.col("sb"))).select("a", "b")


def _sets(named: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``c, s``: the full sets of the classes ``c``, read anew from the texts."""
    owners = cut(named.join(classes.select("c", "doc", "row"), "c"))
    asked = filter_of(owners.select("row"))
    hit = filter_column(asked)
    keyed = owners.select("c", F.col("row").alias("_row"), F.col("doc").alias("_own"))
    held = docs.filter(hit("_row")).join(keyed, ["_row"]).filter(F.col("_doc").eqNullSafe(F.col("_own")))
    sets = cut(held.dropDuplicates(["c"]).select("c", _shingle_set(F.col("_text")).alias("s")))
    asked.destroy()
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets agree."""
    both = pairs.join(sets.withColumnsRenamed({"c": "b", "s": "sb"}), "b").join(
        sets.withColumnsRenamed({"c": "a", "s": "sa"}), "a"
    )
    inter = let(F.size(F.array_intersect("sa", "sb")), lambda n: 100 * n >= PERCENT * (F.size("sa") + F.size("sb") - n))
    return cut(both.filter(inter).select("a", "b"))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()


def _heads(held: list[Broadcast]):
    """The first shared shingles of each set in an order that all sets have in common: shingles that one member has,
    then those of more and more (one filter per step of ``STEPS``), each by value. The filters may take a rare shingle for a shared one, but
    then they do so for every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = batch.column("root").to_pylist()
            ids = batch.column("c").to_pylist()
            for row, flat, offsets in chunks(batch, "s"):
                level = sum(may_hold(f.value, flat).astype(np.int8) for f in held)
                out = []
                for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    n, rare = z - a, int((level[a:z] == 0).sum())
                    stop = n - -(-PERCENT * n // 100) + 1
                    if rare < stop:
                        order = np.lexsort((flat[a:z], level[a:z]))[rare:stop]
                        out.append((ids[row + i], roots[row + i], n, flat[a:z][order], np.arange(rare + 1, stop + 1)))
                if out:
                    size = [len(x[3]) for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array(np.repeat(np.array([x[k] for x in out], np.int64), size)) for k in range(3)],
                            pa.array(np.concatenate([x[3] for x in out]).view(np.int64)),
                            pa.array(np.concatenate([x[4] for x in out])),
                        ],
                        ["c", "root", "n", "x", "at"],
                    )

    return run


def _close(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of members (``c, root``) of different components whose full sets may be similar enough.

    A set similar to one of ``n`` shingles has ``PERCENT`` of these at least. Shingles that no other member has
    come first in the order, so similar sets share one among the first of either, and what follows there must be
    long enough for the overlap still missing. Shingles that one component has alone part nothing and go."""
    seen = cut(sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1"))
    held = [filter_of(seen.filter(F.col("seen") > step).select("x")) for step in STEPS]
    first = sets.join(members, "c").mapInArrow(_heads(held), "c bigint, root bigint, n bigint, x bigint, at bigint")
    first = cut(first)
    for one in held:
        one.destroy()
    apart = first.groupBy("x").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p < q").select("x")
    first = cut(first.join(apart, "x"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "x")))
    heads = first.groupBy("c").agg(F.transform(F.slice(in_order, 1, HEAD), lambda e: e.x).alias("head"))
    here = cut(first.join(unsized(heads), "c"))
    other = here.select([F.col(x).alias(f"{x}_b") for x in here.columns])
    # Pairs meet at the first shingle their heads share; those that share none there may meet more than once.
    once = F.coalesce(F.get(F.array_intersect("head", "head_b"), F.lit(0)), F.col("x")) == F.col("x")
    least = F.ceil(PERCENT * (F.col("n") + F.col("n_b")) / (100 + PERCENT))
    enough = 1 + F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= least
    both = unsized(here).join(other, (F.col("x") == F.col("x_b")) & (F.col("root") < F.col("root_b")) & enough & once)
    return cut(both.select(F.col("c").alias("a"), F.col("c_b").alias("b")).distinct())


def _met(lists: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs of each list's chosen member with the others."""
    both = lists.join(firsts, "token").filter("c <> a")
    return both.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()


def _linked(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, root`` of the classes that are linked with another one.

    First the members of each list meet its most famous one. In lists whose members are not all linked by then, those
    of different components meet. Copies of one text are linked by that time, so what is left are groups that are
    alike but not similar enough; a prefix of their full sets tells most of them apart before they meet."""
    lists = cut(_prefixes(classes).withColumn("root", F.col("c")))
    firsts = lists.groupBy("token").agg(F.min_by("c", F.struct(-F.col("fame"), "c")).alias("a"))
    pairs = cut(_agreeing(_met(lists, firsts), classes))
    known = components(_confirmed(pairs, _sets(_named(pairs), classes, docs)))
    roots = known.withColumnsRenamed({"node": "c", "root": "now"})
    moved = cut(lists.join(roots, "c", "left").select("token", "c", F.coalesce("now", "root").alias("root")))
    apart = moved.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("token")
    members = cut(moved.join(apart, "token").select("c", "root").distinct())
    sets = _sets(members.select("c"), classes, docs)
    return joined_components(known, _confirmed(_close(members, sets), sets))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, row, n_shingles, component_id, kept`` for every row of ``docs``; ``row`` is a hash of id and text.

    A document without words has no shingles and is linked with nothing. Rows that share an id and a
    text are all kept or all dropped. A null id is a component's id only if no linked row has one; its
    row is kept in that case. An empty table gives an empty table."""
    ident = F.col(id_column).cast("bigint")
    row = F.xxhash64(ident, F.col(text))
    plain = docs.select(row.alias("_row"), ident.alias("_doc"), F.col(text).alias("_text"))
    hashed = docs.select(ident.alias("doc"), row.alias("row"), word_hashes(ascii_lower(F.col(text))).alias("w"))
    signed = cut(hashed.mapInArrow(_signed, "doc bigint, row bigint, n bigint, print binary, sign array<int>"))
    classes = cut(
        signed.filter("n > 0")
        .groupBy("print")
        .agg(F.min("doc").alias("lo"), F.min(F.struct("doc", "row")).alias("one"), F.first("n").alias("n"), F.first("sign").alias("sign"))
        .select("print", "lo", "one.doc", "one.row", "n", "sign", F.monotonically_increasing_id().alias("c"))
    )
    linked = _linked(classes.select("c", "doc", "row", "n", "sign"), plain)
    rooted = classes.select("c", "print", "lo").join(linked.withColumnRenamed("node", "c"), "c", "left")
    rooted = rooted.select("print", "lo", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy("root").agg(F.min("lo").alias("component"))
    named = rooted.join(least, "root").select("print", "component")
    out = signed.select("doc", "row", F.col("n").alias("n_shingles"), "print").join(named, "print", "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select("doc", "row", "n_shingles", found.alias("component_id")).withColumn(
        "kept", F.col("doc").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest id."""
    gone = cut(near_duplicates(docs, id_column, text).filter("NOT kept").select("row").distinct())
    hit = filter_column(filter_of(gone))
    marked = docs.withColumn("_row", F.xxhash64(F.col(id_column).cast("bigint"), F.col(text))).withColumn("_hit", hit("_row"))
    sure = marked.filter("NOT _hit")
    rest = marked.filter("_hit").join(gone.withColumnRenamed("row", "_row"), "_row", "left_anti")
    return sure.select(*docs.columns).unionByName(rest.select(*docs.columns))


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near duplicates among all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

QUERIES = {"op1_near_dedup": (op1_near_dedup, SQL)}

"""Substring dedup: repeated word windows found by an FM-index per shard.

Two equal windows of 13 words hold the same least 5-word hash, their anchor. Passages around an anchor
(all windows that share it) therefore need to meet only passages of the same anchor. Anchors that
occur in one document only go first; of equal passages one stays, with its smallest document.
Passages are dealt to shards by anchor, a shard indexes its passages, and backward search streams their
windows through the index. Passages of an anchor that has very many are not indexed: their equal windows
are grouped, and those of more than one document are joined back. What broadcasts is filters of a
fixed size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import small_batches, table, unsized, word_hashes
from pagemill.llm.fm_index import FMIndex
from pagemill.llm.sketch import _ODD, chunks, filter_column, filter_of, grams, held_rows, may_hold, mix
from pagemill.session import cut

WINDOW = 13
GRAM = 5
#: Words that a shard indexes at once.
INDEX_WORDS = 300_000
#: Anchors with more different passages than this are settled window by window, by grouping.
HOT_ANCHOR = 5_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WORD_AND_SPACE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, number of windows, place of the first window in ``flat``) for every
    run of windows of a document that have the same anchor."""
    span = WINDOW - GRAM + 1
    m = len(flat) - WINDOW + 1
    if m <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty, empty
    hashed = grams(flat, GRAM)
    least, at = hashed[:m].copy(), np.arange(m)
    for d in range(1, span):
        less = hashed[d : d + m] < least
        least[less] = hashed[d : d + m][less]
        at[less] = np.flatnonzero(less) + d
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    inside = np.flatnonzero(np.arange(m) + WINDOW <= offsets[rows + 1])
    if not len(inside):
        return anchors(flat[:0], offsets)
    at, rows = at[inside], rows[inside]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    start = inside[first]
    return rows[first], least[start], start - offsets[rows[first]], count, start


def _prints(flat: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit prints of the runs of ``words`` words at ``start``."""
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(flat), _ODD)]))
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(flat), inverse)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat) * power[: len(flat)], dtype=np.uint64)])
    return mix((sums[start + words] - sums[start]) * back[start] + words.astype(np.uint64))


def _hashed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("bigint").alias("doc"), word_hashes(F.col(text)).alias("w"))


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> pa.Array:
    return batch.column("doc").take(pa.array(rows))


def _all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, flat, offsets in chunks(batch, "w"):
            rows, anchor, *_ = anchors(flat, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), _ids(batch, row + rows)], ["h", "doc"])


def _shared_passages(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, flat, offsets in chunks(batch, "w"):
                rows, anchor, first, count, start = anchors(flat, offsets)
                keep = np.flatnonzero(may_hold(held.value, anchor))
                prints = _prints(flat, start[keep], count[keep] + WINDOW - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[keep].view(np.int64)),
                        pa.array(prints.view(np.int64)),
                        _ids(batch, row + rows[keep]),
                        pa.array(first[keep].astype(np.int32)),
                        pa.array(count[keep].astype(np.int32)),
                    ],
                    ["h", "f", "doc", "a", "n"],
                )

    return run


def _words_of(held: Broadcast):
    """The words of the passages whose (anchor, print, document) may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for row, flat, offsets in chunks(batch, "w"):
                rows, anchor, _, count, start = anchors(flat, offsets)
                words = count + WINDOW - 1
                prints = _prints(flat, start, words)
                keep = np.flatnonzero(may_hold(held.value, _key(anchor, prints, docs[row + rows])))
                _, one = np.unique(np.stack([anchor[keep], prints[keep]]), axis=1, return_index=True)
                keep = keep[one]
                ends = np.concatenate([[0], np.cumsum(words[keep])])
                places = np.arange(ends[-1]) + np.repeat(start[keep] - ends[:-1], words[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[keep].view(np.int64)),
                        pa.array(prints[keep].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[places].view(np.int64))),
                    ],
                    ["h", "f", "w"],
                )

    return run


def _key(anchor: np.ndarray, prints: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(mix(anchor ^ _ODD) + prints) ^ mix(doc)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, f, doc = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(_key(h, f, doc).view(np.int64))], ["key"])


def _with_words(search):
    """``search`` over the passages with their words. Rows come sorted by ``k`` and ``f``, the one with the smallest
    document of a passage before those with its words, which may be several or of a passage that is not asked for."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_passage = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, f = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("h", "f"))
            asked = batch.column("lo").is_valid().to_numpy(zero_copy_only=False)
            lo = batch.column("lo").fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(asked[:-1] & ~asked[1:] & (h[:-1] == h[1:]) & (f[:-1] == f[1:])) + 1
            least = lo[at - 1]
            if not asked[0] and open_passage is not None and open_passage[:2] == (h[0], f[0]):
                at, least = np.append(0, at), np.append(open_passage[2], least)
            open_passage = (h[-1], f[-1], lo[-1]) if asked[-1] else None
            rows = batch.take(pa.array(at))
            yield rows.set_column(rows.schema.get_field_index("lo"), "lo", pa.array(least))

    return lambda batches: search(whole(batches))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``k``; passages of one ``k`` are indexed together, and a shard's keys in runs
    of about ``INDEX_WORDS`` words. Gives per passage its windows that another passage also holds, with
    the smallest document that holds them."""

    def search(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(rows).combine_chunks()
        listed = held.column("w").chunk(0)
        offsets = listed.offsets.to_numpy().astype(np.int64)
        flat = listed.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        length = np.diff(offsets)
        _, symbols = np.unique(flat, return_inverse=True)
        text = np.zeros(len(flat) + len(length), np.int64)
        owner = np.repeat(np.arange(len(length)), length)
        text[np.arange(len(flat)) + owner] = symbols + 1
        begin = offsets[:-1] + np.arange(len(length))
        windows = length - WINDOW + 1
        ends = np.concatenate([[0], np.cumsum(windows)])
        passage = np.repeat(np.arange(len(length)), windows)
        offset = np.arange(ends[-1]) - ends[passage]
        index = FMIndex(text, WINDOW)
        found, low, high = index.repeated(begin[passage] + offset, WINDOW)
        lows = held.column("lo").to_numpy()
        by_place = np.repeat(lows, length + 1)[index.order]
        # Ranges of different windows do not overlap; an end beyond the last row is left out.
        edges = np.stack([low, high], 1).ravel()
        fewest = np.minimum.reduceat(np.append(by_place, np.iinfo(np.int64).max), edges)[::2] if len(edges) else lows[:0]
        better = fewest < lows[passage[found]]
        passages, offset = passage[found][better], offset[found][better]
        return pa.RecordBatch.from_arrays(
            [
                held.column("h").take(pa.array(passages)).combine_chunks(),
                held.column("f").take(pa.array(passages)).combine_chunks(),
                pa.array((held.column("j").to_numpy()[passages] + offset).astype(np.int32)),
                pa.array(fewest[better]),
            ],
            ["h", "f", "j", "lo"],
        )

    waiting: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        listed = batch.column("w")
        offsets = listed.offsets.to_numpy().astype(np.int64)
        keys = batch.column("k").to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]]))
        row = 0
        for at in [*new.tolist(), batch.num_rows]:
            if at > row:
                waiting.append(batch.slice(row, at - row))
                size += int(offsets[at] - offsets[row])
                row = at
            if size >= INDEX_WORDS and at < batch.num_rows:
                yield search(waiting)
                waiting, size = [], 0
        last = keys[-1]
    if waiting:
        yield search(waiting)


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, starts``: the documents that hold windows which also start in a document with a smaller
    id, and those windows as ranges (first, last) of word places.

    Documents of fewer words than a window, null texts and empty tables give no rows. A null id is no
    smaller id and has no windows removed. Rows of one id share their ranges."""
    hashed = _hashed(docs, id_column, text)
    once = hashed.mapInArrow(_all_anchors, "h bigint, doc bigint")
    shared = once.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h")
    in_two = filter_of(shared)
    places = cut(hashed.mapInArrow(_shared_passages(in_two), "h bigint, f bigint, doc bigint, a int, n int"))
    in_two.destroy()
    passages = cut(places.groupBy("h", "f").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo IS NOT NULL"))
    several = passages.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("lo").alias("l"), F.max("hi").alias("m"))
    several = several.filter("kinds > 1 AND l < m").select("h", (F.col("kinds") > HOT_ANCHOR).alias("hot"))
    to_index = cut(passages.join(several, "h").select("h", "f", "lo", "hot"))

    def words_of(rows: DataFrame) -> DataFrame:
        """The words of the passages, and of some others."""
        wanted = filter_of(rows.select("h", "f", "lo").mapInArrow(_keys, "key bigint"))
        return hashed.mapInArrow(_words_of(wanted), "h bigint, f bigint, w array<bigint>")

    def listed(rows: DataFrame) -> DataFrame:
        """Passages with their words."""
        return rows.join(words_of(rows).groupBy("h", "f").agg(F.first("w").alias("w")), ["h", "f"])

    hot = to_index.filter("hot")
    # Passages and their words go to the shards as they are and meet there, where they are sorted anyway.
    cold = to_index.filter("NOT hot").select("h", "f", "lo", F.lit(None).cast("array<bigint>").alias("w"))
    both = cold.unionByName(words_of(cold).withColumn("lo", F.lit(None).cast("bigint")))
    shards = both.select(F.col("h").alias("k"), "h", "f", "lo", F.lit(0).alias("j"), "w")
    shards = shards.repartition("k").sortWithinPartitions("k", "f", F.col("lo").isNull())
    matched = shards.mapInArrow(_with_words(_matched), "h bigint, f bigint, j int, lo bigint")
    if not hot.isEmpty():
        prints = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda j: F.xxhash64(F.slice("w", j + 1, WINDOW)))
        split = cut(listed(hot).select("h", "f", "lo", F.posexplode(prints).alias("j", "k")))
        # Equal windows have one anchor and one print; they become one row before they travel, and the join with
        # the written rows may be split.
        least = split.groupBy("h", "k").agg(F.min("lo").alias("least"), F.max("lo").alias("most"))
        least = cut(least.filter("least < most").drop("most"))
        others = split.join(least, ["h", "k"]).filter("least < lo")
        matched = matched.unionByName(others.select("h", "f", "j", F.col("least").alias("lo")))
    found = matched.groupBy("h", "f").agg(F.collect_list(F.struct("j", "lo")).alias("others"))
    # Written, so that the join below has two plain sides and a passage of very many documents is split.
    known = cut(passages.join(unsized(found), ["h", "f"], "left").filter("lo < hi OR others IS NOT NULL"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    a, last = F.col("a"), F.col("a") + F.col("n") - 1
    ranges = F.when(F.col("lo") < F.col("doc"), F.array(F.struct(a.alias("s"), last.alias("e")))).otherwise(
        F.coalesce(
            F.transform(
                F.filter("others", lambda o: o.lo < F.col("doc")),
                lambda o: F.struct((a + o.j).alias("s"), (a + o.j).alias("e")),
            ),
            none,
        )
    )
    joined = places.join(unsized(known), ["h", "f"]).select("doc", ranges.alias("r")).filter(F.size("r") > 0)
    return joined.groupBy("doc").agg(F.flatten(F.collect_list("r")).alias("starts"))


def _covered(n: int, starts: list[dict]) -> np.ndarray:
    """Which of ``n`` words the windows that start in the given ranges cover."""
    change = np.zeros(n + 1, np.int64)
    s = np.array([x["s"] for x in starts], np.int64)
    e = np.array([x["e"] for x in starts], np.int64) + WINDOW
    fits = e <= n
    np.add.at(change, s[fits], 1)
    np.add.at(change, e[fits], -1)
    return np.cumsum(change[:-1]) > 0


def _finish(text: str, starts: list[dict] | None) -> tuple[int, int, str, str]:
    """(words, words removed, digest of the kept words, text without the removed words)."""
    listed = _WORD.findall(text)
    if not starts:
        return len(listed), 0, hashlib.sha256(" ".join(listed).encode()).hexdigest(), text
    gone = _covered(len(listed), starts).tolist()
    kept = " ".join([w for w, g in zip(listed, gone) if not g])
    left = "".join([w for w, g in zip(_WORD_AND_SPACE.findall(text), gone) if not g])
    return len(listed), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), left


def _finished(text: str, digest: bool, drop: str, outside: tuple[Broadcast, str] | None = None):
    """Replaces ``text`` by what is left of it, or adds the digest columns and leaves the text out. With
    ``outside``, a filter and an id column, only rows whose id is not in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if outside is not None:
                batch = batch.filter(pa.array(~held_rows(outside[0].value, batch.column(outside[1]))))
            ranges = batch.column(drop).to_pylist() if drop in batch.schema.names else [None] * batch.num_rows
            done = [_finish(t or "", r) for t, r in zip(batch.column(text).to_pylist(), ranges)]
            names = [n for n in batch.schema.names if n != drop]
            if digest:
                names.remove(text)
                new = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], [*names, "n_words", "n_removed", "kept_sha256"])
            else:
                left = pa.array([None if t is None else d[3] for t, d in zip(batch.column(text).to_pylist(), done)], pa.string())
                yield pa.RecordBatch.from_arrays([left if n == text else batch.column(n) for n in names], names)

    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with every word removed that a repeated window covers (see ``repeated_windows``), the
    white space after it too; with ``digest``, ``n_words, n_removed, kept_sha256`` instead of the text.
    Only documents that lose words travel to meet their ranges. Null texts stay null (digest of
    no words); equal rows are treated alike; other columns pass through."""
    with small_batches(docs.sparkSession):
        ranges = cut(repeated_windows(docs, id_column, text))
    held = filter_of(ranges.select("doc"))
    if digest:
        docs = docs.drop("n_words", "n_removed", "kept_sha256")
    ident = F.col(id_column).cast("bigint")
    plain = docs if dict(docs.dtypes)[id_column] == "bigint" else docs.withColumn(id_column, ident)
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes if not (digest and c == text))
    if digest:
        schema += ", n_words bigint, n_removed bigint, kept_sha256 string"
    whole = plain.mapInArrow(_finished(text, digest, "_starts", (held, id_column)), schema)
    loses = plain.filter(filter_column(held)(ident)).withColumn("_doc", ident)
    joined = loses.join(unsized(ranges).withColumnsRenamed({"doc": "_doc", "starts": "_starts"}), "_doc", "left").drop("_doc")
    run = _finished(text, digest, "_starts")
    return whole.unionByName(joined.mapInArrow(run, schema))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated windows of every whole document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return without_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS lo FROM w GROUP BY k),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 13)) AS p FROM w JOIN f USING (k) WHERE f.lo < w.doc_id)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(
         CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

QUERIES = {"op4_substring_dedup": (op4_substring_dedup, SQL)}

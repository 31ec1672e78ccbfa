"""Spelling variants: words one edit apart, found through lists of variable-length grams.

Words get an end mark and are cut into positional grams of ``LEAST_GRAM`` to ``MOST_GRAM`` letters: a gram grows
while it is more frequent than the pruned dictionary allows, and goes if the grams before it reach as far.
Whether a gram of a word stays depends on nothing but the ``MOST_GRAM`` letters up to its end. So an edit at a
place affects only the grams whose last ``MOST_GRAM`` letters span it, and all others are found again in the edited
word, at the same place before the edit and moved with it behind. That bounds the affected grams of a word for
each place, not only their largest number.

A near word stands in the lists of all grams that the edit leaves. These lists are merged at once: a word is
posted, for each place of an edit, under the combination of the grams left, and words that meet under one are
verified by edit distance. A combination fixes all letters but those near the edit, so lists stay short however many
words share common grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import ascii_lower, table
from pagemill.session import cut

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: Grams of 3 letters at most: any edit leaves a gram of a word of 6 letters or more, mostly two or more.
LEAST_GRAM, MOST_GRAM = 2, 3
#: A gram that more than this share of the words hold is cut longer.
FREQUENT = 0.0005
#: A form is at least so many times as frequent as its variant.
TIMES = 5
END = "$"
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100))) + END
_CODES = {c: i for i, c in enumerate(_LETTERS, 1)}
_BASE = len(_LETTERS) + 1


def code_of(gram: str) -> int:
    """A gram as a number in base ``_BASE``; grams of different length differ."""
    code = 0
    for letter in gram:
        code = code * _BASE + _CODES[letter]
    return code


def counted_words(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    every: int = 199,
) -> DataFrame:
    """``word, n``: distinct words of the texts with their occurrences, after the deletions that the key decides:
    where ``every`` divides the crc32 of ``key:run``, the run loses a letter.

    A null text has no words; under a null key no letter is deleted. Repeated rows count each time."""
    runs = docs.select(
        F.col(key).cast("string").alias("_k"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0))).alias("_r"),
    )
    size = F.length("_r")
    hashed = runs.withColumn("_h", F.crc32(F.concat("_k", F.lit(":"), "_r").cast("binary")))
    at = (F.col("_h") % size).cast("int")
    short = F.concat(F.substr("_r", F.lit(1), at), F.substr("_r", at + 2))
    word = F.when(F.col("_h") % every == 0, short).otherwise(F.col("_r")).alias("word")
    long_enough = hashed.select(word).filter(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def gram_counts(words: DataFrame) -> DataFrame:
    """``gram, words``: the grams of the marked words that are shorter than ``MOST_GRAM`` and how often they come.
    There are at most 91 ** 2 of them, whatever the number of words."""
    marked = F.concat("word", F.lit(END))

    def of_length(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(marked) - q + 1), lambda i: F.substr(marked, i, F.lit(q)))

    grams = [of_length(q) for q in range(LEAST_GRAM, MOST_GRAM)]
    return words.select(F.explode(F.concat(*grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))


def decompose(word: str, frequent: set[str]) -> list[tuple[int, str]]:
    """(place, gram) of the variable grams of a word; grams in ``frequent`` grow while they can."""
    marked = word + END
    out, reached = [], 0
    for p in range(len(marked) - LEAST_GRAM + 1):
        e = p + LEAST_GRAM
        while e - p < MOST_GRAM and e < len(marked) and marked[p:e] in frequent:
            e += 1
        if e > reached:
            out.append((p, marked[p:e]))
            reached = e
    return out


def left_over(grams: list[tuple[int, str]], size: int) -> set[tuple[int, int]]:
    """The lists of a word of ``size`` letters: (length of the shorter word of the pair, hash of the grams that an
    edit leaves), for a letter replaced by another, a letter deleted, and a letter inserted at each place."""
    marked = [(code_of(g), p, p + len(g)) for p, g in grams]
    before = [0]
    for code, p, _ in marked:
        before.append(hash((before[-1], code, p)))

    def behind(moved: int) -> list[int]:
        out = [1]
        for code, p, _ in reversed(marked):
            out.append(hash((out[-1], code, p + moved)))
        return out[::-1]

    still, pulled = behind(0), behind(-1)
    lists = set()
    first = last = gap = 0
    for place in range(size + 1):
        # Grams that end at the place or before it stay; so do those whose last letters begin behind it.
        while first < len(marked) and marked[first][2] <= place:
            first += 1
        while last < len(marked) and marked[last][2] - MOST_GRAM <= place:
            last += 1
        while gap < len(marked) and marked[gap][2] - MOST_GRAM < place:
            gap += 1
        if place < size:
            lists.add((size, hash((0, before[first], still[last]))))
            lists.add((size - 1, hash((1, before[first], pulled[last]))))
        lists.add((size, hash((1, before[first], still[max(first, gap)]))))
    return lists


_POSTING = "size int, grams bigint, word string, n bigint"


def postings(words: DataFrame) -> DataFrame:
    """The lists: a row per word and combination of grams that some edit leaves of it."""
    words = words.select("word", "n")
    total = words.count()
    often = gram_counts(words).filter(F.col("words") > FREQUENT * total)
    held = words.sparkSession.sparkContext.broadcast({row["gram"] for row in often.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        types = [pa.int32(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in _POSTING.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(size, key, word, n) for size, key in left_over(decompose(word, frequent), len(word))]
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return words.mapInArrow(run, _POSTING)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: the words that differ by exactly one inserted, deleted or replaced letter, each pair
    in both directions. ``words`` has distinct ``word`` of letters of ``RUN`` in lower case, ``LEAST_LENGTH`` or
    longer, and ``n``."""
    lists = cut(postings(words))
    a, b = lists.alias("a"), lists.alias("b")
    met = a.join(
        b, F.expr("a.size = b.size AND a.grams = b.grams AND a.word < b.word AND levenshtein(a.word, b.word, 1) = 1")
    )
    pairs = cut(met.select(F.col("a.word").alias("x"), F.col("a.n").alias("xn"), F.col("b.word").alias("y"), F.col("b.n").alias("yn")).distinct())
    forth = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("yn").alias("near_n"))
    return forth.unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("xn").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of ``word, form`` that starts at each word ends. Chains are free of cycles;
    every round doubles the way that is known, and the driver sees one yes or no a round."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = cut(known.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        known = after.select("word", "root")
        if after.filter("_moved").isEmpty():
            return known


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with their counts: the near word of the largest
    count (ties: the smallest in code-point order) is the form if it is ``times`` as frequent, and ``root`` is the
    last form that is reached. Words without near words come with ``n_near`` 0 and themselves as root; no words
    give no rows."""
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best")
    )
    best_n = -F.col("_best.less")
    fits = best_n >= times * F.col("n")
    judged = cut(
        words.select("word", "n")
        .join(near, "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(fits, F.col("_best.near")).alias("form"),
            F.when(fits, best_n).alias("form_n"),
        )
    )
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all whole documents with their near words, forms and roots."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling_variants(cut(counted_words(docs)))


SQL = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS x FROM d),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, v: xor(c // 256, t[1 + xor(c % 256, v)])), 4294967295) AS h FROM b, steps),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING sum(n) >= 5),
v AS (SELECT * FROM w WHERE length(word) >= 6),
cutout AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cutout a JOIN cutout b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cutout a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cutout a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
chosen AS (SELECT b.word, b.n_near, b.most, min(near) AS near FROM best b JOIN near e ON b.word = e.word AND e.near_n = b.most GROUP BY ALL),
j AS (
  SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN most >= 5 * v.n THEN near END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
  FROM v LEFT JOIN chosen c ON v.word = c.word),
walk AS (
  SELECT word, word AS reached, 0 AS hops FROM j
  UNION ALL SELECT walk.word, j.form, hops + 1 FROM walk JOIN j ON walk.reached = j.word WHERE j.form IS NOT NULL),
chain AS (SELECT word, arg_max(reached, hops) AS root FROM walk GROUP BY word)
SELECT j.word, j.form, chain.root, j.n, j.n_near, j.form_n FROM j JOIN chain ON j.word = chain.word
"""

QUERIES = {"op11_spelling_variants": (op11_spelling_variants, SQL)}

"""Line-first cleaning: lines are judged and removed, then documents that lost too much go.

DataFrame functions only; a row never leaves its partition, so there is no shuffle and no
hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import let, ngram_hashes, table, words

SYMBOLS = "[#*$%&|<>]"
#: Phrases of page furniture; a short line that holds one is boilerplate.
BOILERPLATE = (
    "accept (all )?cookies|all rights reserved|click here|cookie policy|enable javascript|log ?in|newsletter|"
    "privacy policy|read more|share (this|on)|sign (in|up)|skip to content|subscribe|terms (of|and) (use|service|conditions)"
)
#: Share of a line's words above which its marks make it fail.
MARKED = 0.3
#: A line of at least so many words must end like a sentence.
LONG_LINE = 12
#: A phrase of BOILERPLATE counts in lines of at most so many words.
SHORT_LINE = 10
#: Share of the words that must survive the line rules.
LEAST_LEFT = 0.5


def _line_fails(line: Column, n: Column) -> Column:
    """Punctuation, navigation and boilerplate rules of one line of ``n`` words. A line without words passes."""
    marked = F.regexp_count(line, F.lit(f"{SYMBOLS}{{2,}}"))
    shouted = F.regexp_count(line, F.lit("!!"))
    bars = F.regexp_count(line, F.lit("[|»›•·]"))
    return (n > 0) & (
        (marked > MARKED * n)
        | (line.contains("!!") & (shouted > MARKED * n))
        | (bars >= F.greatest(F.lit(2.0), 0.25 * n))
        | ((n >= LONG_LINE) & ~line.rlike("[.!?:;…。！？\"'”’»)\\]][\\x20\\x09-\\x0D]*$"))
        | ((n <= SHORT_LINE) & line.rlike(f"(?i)(^|[^a-z])({BOILERPLATE})([^a-z]|$)"))
    )


def _covered(hashes: Column) -> Column:
    """Words in windows of three that occur twice or more: sort the windows' hashes with their
    places, keep equal neighbours, and add up what each place covers anew. Nothing is sorted where
    all windows differ."""
    rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(
        rows,
        lambda r: F.transform(
            F.filter(r, lambda e, i: (e.h == F.get(r, i - 1).h) | (e.h == F.get(r, i + 1).h)), lambda e: e.i
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        F.sort_array(twice),
        start,
        lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a.n,
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered)


def _facts(body: Column) -> Column:
    """What the rules read off a text, as one struct: each line is cut into words once, each word hashed once."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("w")))
    judged = lambda listed: F.transform(
        listed, lambda x: F.struct(x.line.alias("line"), F.size(x.w).alias("n"), _line_fails(x.line, F.size(x.w)).alias("fails"))
    )
    filled = lambda rows: F.transform(F.filter(rows, lambda x: x.n > 0), lambda x: x.line)
    passed = lambda rows: F.filter(rows, lambda x: ~x.fails)
    hashes = lambda listed: F.transform(F.flatten(F.transform(listed, lambda x: x.w)), lambda w: F.xxhash64(w))

    def counted(listed: Column) -> Column:
        return let(
            judged(listed),
            lambda rows: F.struct(
                F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + x.n).alias("n_words"),
                F.aggregate(
                    listed, F.lit(0).cast("bigint"), lambda a, x: a + F.length(F.array_join(x.w, ""))
                ).alias("word_chars"),
                let(filled(rows), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                let(ngram_hashes(hashes(listed), 3), _covered).alias("n_repeat_words"),
                F.array_join(F.transform(passed(rows), lambda x: x.line), "\n").alias("clean_text"),
                F.aggregate(passed(rows), F.lit(0).cast("bigint"), lambda a, x: a + x.n).alias("n_clean_words"),
            ),
        )

    return let(lines, counted)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (of the given
    text), ``base_failed``, ``clean_text`` (the lines that pass, joined by line feeds),
    ``n_clean_words`` and ``kept``.

    A null or empty text has no words: all counts are 0, the base rules fail and the clean text is
    empty. Equal rows are judged alike, one by one; other columns pass through, and one that has a
    new column's name is replaced. An empty table gives an empty table."""
    body = F.coalesce(F.col(text), F.lit(""))
    facts = "_facts" + "_" * max(map(len, docs.columns))
    read = docs.withColumns({facts: _facts(body), "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint")})
    new = ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "clean_text", "n_clean_words")
    counted = read.withColumns({name: F.col(facts)[name] for name in new}).drop(facts)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns(
        {"base_failed": base, "kept": ~base & (F.col("n_clean_words") >= LEAST_LEFT * F.col("n_words"))}
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules over every whole document."""
    return quality_rules(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_clean_words",
    )


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS r FROM documents),
w AS (
  SELECT r, doc_id, body, regexp_extract_all(body, '{_WORD}') AS ws,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (
  SELECT DISTINCT r, i + k AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM g), range(0, 3) AS t(k) WHERE n > 1),
cover AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
line AS (
  SELECT r, x, len(regexp_extract_all(x, '{_WORD}')) AS n
  FROM (SELECT r, unnest(ls) AS x FROM w)),
good AS (
  SELECT r, sum(n) AS n FROM line
  WHERE NOT (
    len(regexp_extract_all(x, '{SYMBOLS}{{2,}}')) > {MARKED} * n
    OR len(regexp_extract_all(x, '!!')) > {MARKED} * n
    OR (len(regexp_extract_all(x, '[|»›•·]')) >= 2 AND len(regexp_extract_all(x, '[|»›•·]')) >= 0.25 * n)
    OR (n >= {LONG_LINE} AND NOT regexp_matches(x, '[.!?:;…。！？"''”’»)\]][\x20\x09-\x0D]*$'))
    OR (n <= {SHORT_LINE} AND regexp_matches(x, '(?i)(^|[^a-z])({BOILERPLATE})([^a-z]|$)')))
  GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(good.n, 0) AS BIGINT) AS n_clean_words
  FROM w LEFT JOIN cover USING (r) LEFT JOIN good USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_clean_words >= {LEAST_LEFT} * n_words AS kept
FROM m
"""

QUERIES = {"op8_quality_rules": (op8_quality_rules, SQL)}

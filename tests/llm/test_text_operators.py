"""Operators over documents against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import common, mixing, near_dedup, quality_model, quality_rules, sentence_pieces, substring_dedup, token_counts, topk_search
from pagemill.llm.fm_index import FMIndex, WaveletMatrix
from pagemill.llm.sketch import filter_of, may_hold
from pagemill.session import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, c bigint, row string, size int"


def made(seed=3, n=60):
    """Documents with exact and near copies, shared passages, empty, null and short texts, and clashing columns."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for i in range(n):
        kind = i % 10
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 140))]
        if kind == 1 and texts:
            words = WORD.findall(texts[-1])
        elif kind == 2:
            words = WORD.findall(rng.choice([t for t in texts if t and len(t) > 50]))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "changed"
        elif kind == 3:
            at = rng.randrange(len(words))
            words[at:at] = passage[: rng.randint(12, 30)]
        text = " ".join(words)
        text = {4: "", 5: None, 6: " \t\n", 7: "a B", 8: text.upper() if i % 20 == 8 else text}.get(kind, text)
        texts.append(text)
    order = list(range(n))
    rng.shuffle(order)
    rows = [(order[i], t, [None, "en"][i % 2], ["s1", "s2", "S", None][i % 4], 0, i, "x", i) for i, t in enumerate(texts)]
    rows.append((None, texts[0], "en", "s1", 0, 1, "y", 2))
    rows.append(rows[0])
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for j, x in enumerate(rows) if find(j) == find(i) and x[0] is not None] if sets[i] else [r[0]]
        least = min((x for x in ids if x is not None), default=None)
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return out


def key(rows):
    return sorted(map(str, rows))


def test_near_dedup_against_all_pairs(docs):
    found = near_dedup.near_duplicates(docs).select("doc", "n_shingles", "component_id", "kept").collect()
    assert key(map(tuple, found)) == key(brute_components(ROWS))


def test_near_dedup_links_copies_that_only_a_middle_one_links(spark):
    """A chain: neighbours are similar, ends are not."""
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(12)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    expected = brute_components([(i, t) for i, t in rows])
    assert key((r.doc, r.n_shingles, r.component_id, r.kept) for r in found.collect()) == key(expected)


def test_near_dedup_of_a_large_group(spark):
    """Copies of one text with changes of their own: most are similar to the text and not to one another."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert key((r.doc, r.n_shingles, r.component_id, r.kept) for r in found.collect()) == key(brute_components(rows))


def test_without_near_duplicates_keeps_columns(docs, none):
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert key(r.doc_id for r in kept.collect()) == key(r[0] for r in brute_components(ROWS) if r[3])
    assert near_dedup.without_near_duplicates(none).count() == 0


def brute_removed(rows):
    where = {}
    listed = [WORD.findall(r[1] or "") for r in rows]
    for r, words in zip(rows, listed):
        if r[0] is not None:
            for i in range(len(words) - 12):
                at = tuple(words[i : i + 13])
                where[at] = min(where.get(at, r[0]), r[0])
    out = []
    for r, words in zip(rows, listed):
        gone = set()
        for i in range(len(words) - 12):
            least = where.get(tuple(words[i : i + 13]))
            if r[0] is not None and least < r[0]:
                gone |= set(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((r[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [5_000, 1])
def test_substring_dedup_against_all_windows(docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", hot)
    found = substring_dedup.without_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(map(tuple, found.collect())) == key(brute_removed(ROWS))


def test_substring_dedup_of_a_window_in_very_many_documents(spark, monkeypatch):
    """Equal windows between different words are not indexed together."""
    matched, most = substring_dedup._matched, 20

    def counted(batches):
        held = list(batches)
        keys = Counter(k for b in held for k in b.column("k").to_pylist())
        assert max(keys.values(), default=0) <= most
        yield from matched(iter(held))

    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", most)
    monkeypatch.setattr(substring_dedup, "_matched", counted)
    rng = random.Random(11)
    shared = " ".join(f"p{i}" for i in range(14))
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 30)))
    rows = [(i, f"{own()} {shared} {own()}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = substring_dedup.without_repeats(frame, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(map(tuple, found.collect())) == key(brute_removed(rows))


def test_substring_dedup_keeps_the_rest_of_the_text(spark, none):
    shared = " ".join(f"p{i}" for i in range(15))
    rows = [(1, f"one\n{shared} two"), (2, f"three\t{shared}\nfour\n\nfive"), (3, None)]
    found = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id int, text string"))
    assert dict(map(tuple, found.collect())) == {1: rows[0][1], 2: "three\tfour\n\nfive", 3: None}
    assert substring_dedup.without_repeats(none).count() == 0


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 500), 0)
    index = FMIndex(text, 6)
    starts = np.arange(len(text) - 7)
    found, low, high = index.repeated(starts, 6)
    counts = Counter(tuple(text[i : i + 6]) for i in range(len(text) - 5))
    expected = {i: counts[tuple(text[i : i + 6])] for i in starts if counts[tuple(text[i : i + 6])] > 1}
    assert dict(zip(found.tolist(), (high - low).tolist())) == expected
    for i, (a, z) in enumerate(zip(low, high)):
        assert {tuple(text[p : p + 6]) for p in index.order[a:z]} == {tuple(text[starts[found[i]] : starts[found[i]] + 6])}


def test_wavelet_matrix_ranks():
    symbols = np.random.default_rng(2).integers(0, 37, 300)
    matrix = WaveletMatrix(symbols, 37)
    places = np.arange(301)
    for symbol in range(37):
        expected = np.concatenate([[0], np.cumsum(symbols == symbol)])
        assert (matrix.rank(np.full(301, symbol), places) == expected).all()


def test_filter_holds_all_keys(spark):
    rows = [(x,) for x in range(-500, 500)]
    held = filter_of(spark.createDataFrame([*rows, (None,)], "k bigint"))
    assert may_hold(held.value, np.arange(-500, 500).view(np.uint64)).all()
    assert may_hold(held.value, np.arange(10**6, 2 * 10**6).view(np.uint64)).mean() < 0.01


def brute_repeats(words):
    seen = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if seen[t] > 1 for k in range(3)})


def test_filters_are_as_small_as_their_keys_allow(spark):
    for n, most in [(0, 64), (10, 4096), (3000, 1 << 18)]:
        keys = np.arange(n, dtype=np.uint64) * np.uint64(7)
        held = filter_of(spark.range(n).select((F.col("id") * 7).alias("k")))
        assert len(held.value) <= most and may_hold(held.value, keys).all()
        others = np.arange(100_000, dtype=np.uint64) * np.uint64(7) + np.uint64(1)
        assert may_hold(held.value, others).mean() < 0.01
        held.destroy()


def test_quality_rules_counts(docs, none):
    extra = "a b c d a b c x\nsame line.\nsame line.\n | | menu | home | about\nBuy ### it &&& now *** here.\n" + "fine words here. " * 40
    frame = docs.unionByName(docs.sparkSession.createDataFrame([(900, extra, "en", "s", 0, 0, "", 0)], SCHEMA))
    for r in quality_rules.quality_rules(frame).collect():
        text = r.text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(words)
        assert r.base_failed == (len(words) < 50 or 100 * brute_repeats(words) > 50 * len(words))
        if r.doc_id == 900:
            assert "menu" not in r.clean_text and "###" not in r.clean_text and "fine words" in r.clean_text
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_rules_plan_has_no_python_and_no_shuffle(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quotas_are_those_of_highest_quotients():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 8)
        weights = [rng.choice([0, 1, 2, 5, rng.random() * 10]) for _ in range(n)]
        most = [rng.randint(0, 12) for _ in range(n)]
        seats = rng.randint(0, 30)
        got = [0] * n
        for _ in range(min(seats, sum(m for m, w in zip(most, weights) if w > 0))):
            best = max((i for i in range(n) if got[i] < most[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
            got[best] += 1
        assert mixing.quotas(np.array(weights), np.array(most), seats).tolist() == got


def test_targets_share_the_excess():
    sizes, weights = np.array([10.0, 500.0, 400.0, 1.0]), np.array([5.0, 2.0, 1.0, 5.0])
    out = mixing.targets(sizes, weights)
    assert abs(out.sum() - sizes.sum()) < 1e-6 and (out <= 3 * sizes + 1e-9).all()
    free = out < 3 * sizes - 1e-9
    assert np.ptp((out / weights)[free]) < 1e-6 and mixing.targets(np.zeros(2), np.ones(2)).tolist() == [0, 0]


@pytest.mark.parametrize("shard", [2000, 7])
def test_mixing(docs, none, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard)
    monkeypatch.setattr(mixing, "FAN_OUT", 4)
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()
    assert key((r.doc_id, r.taken) for r in rows) == key(map(tuple, again))
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.source_size > 0
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    expected = mixing.targets(np.array([size[s] for s in sources], float), np.array([5.0, 2.0, 1.0, 5.0]))
    for s, t in zip(sources, expected):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 2 * mixing.BLOCK_WORDS
    assert mixing.mix(none).count() == 0


def test_mixed_rows_hold_the_words_taken(docs):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    expected = Counter()
    for r in mixing.mix(docs).collect():
        expected[r.doc_id] += r.taken
    assert +got == +expected


def test_pieces_are_those_of_the_library(spark, none):
    held = sentence_pieces.load()
    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = [r[1] for r in ROWS] + ["Hello  world\nthe é ñ 你好 \t x", " a", "  a b ", " " * 37 + "x", "a" * 300, "😀😀 a\r\n", "<s> </s>", "\x00"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids, ends = sentence_pieces.encode_texts(held, texts)
    for text, a, z in zip(texts, ends, ends[1:]):
        assert ids[a:z].tolist() == model.encode(text or "")
        assert sentence_pieces.decode(held, ids[a:z].tolist()) == (text or "")
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    encoded = sentence_pieces.encode(frame)
    back = sentence_pieces.decode_column(encoded.withColumnRenamed("text", "was").withColumn("text", F.lit(1)))
    assert all((r.was or "") == r.text for r in back.collect())
    assert sentence_pieces.encode(none).count() == 0


def test_unigram_pieces_have_the_best_score():
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.4, "aba": -3.1, "bb": -2.2}
    pieces = list(scores)
    ends = {p[i:]: -1 for p in pieces for i in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
    held = sentence_pieces.Pieces(False, pieces, list(scores.values()), [p.encode() for p in pieces], [], ends, {}, {}, "", -9.0)

    def best(word):
        if not word:
            return 0.0
        return max(scores[p] + best(word[len(p) :]) for p in pieces if word.startswith(p))

    words = sorted({"".join(random.Random(i).choices("ab", k=1 + i % 9)) for i in range(60)})
    for word, ids in zip(words, sentence_pieces.encode_sorted(held, words)):
        assert "".join(pieces[i] for i in ids) == word
        assert abs(sum(scores[pieces[i]] for i in ids) - best(word)) < 1e-9


def test_token_rollups(spark, folder, tmp_path):
    state = f"{tmp_path}/state"
    schema = "source string, lang string, tokenizer string, tokens bigint"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    token_counts.commit(token_counts.deltas(inserted=frame(("a", "en", "t", 5), ("a", "en", "t", 7), (None, "de", "t", None))), state, "day 1/x")
    second = token_counts.deltas(deleted=frame(("a", "en", "t", 5)), revised=(frame(("a", "en", "t", 7)), frame(("b", "en", "t", 9))))
    token_counts.commit(second, state, "day 2")
    expected = [("None", "de", "t", 1, 0), ("b", "en", "t", 1, 9)]
    assert key((str(r[0]), *r[1:]) for r in token_counts.totals(spark, state).collect()) == key(expected)
    token_counts.commit(second, state, "day 2")
    assert key((str(r[0]), *r[1:]) for r in token_counts.totals(spark, state).collect()) == key(expected)


def test_token_batches_are_switched_whole(spark, tmp_path):
    state = f"{tmp_path}/state"
    rows = [(f"s{i}", "en", "t", 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens bigint")
    changes = token_counts.deltas(inserted=frame).repartition(4)
    token_counts.commit(changes, state, "b")
    assert len([f for f in tmp_path.rglob("part-*.parquet") if "manifest" not in str(f)]) == 4
    broken = changes.withColumn("tokens", F.when(F.col("source") == "s7", F.raise_error(F.lit("no"))).otherwise(2))
    with pytest.raises(Exception, match="no"):
        token_counts.commit(broken, state, "b")
    assert token_counts.totals(spark, state).agg(F.sum("tokens")).first()[0] == 40
    token_counts.commit(changes.withColumn("tokens", F.lit(3)), state, "b")
    assert token_counts.totals(spark, state).agg(F.sum("tokens")).first()[0] == 120


def test_token_query(spark, folder):
    path = folder(documents=(ROWS, SCHEMA))
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_counts.op5_token_counts(spark, path).collect()}
    first = {}
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[3] is not None, r[3] or "")):
        if r[1] is not None:
            first.setdefault(r[1], r)
    live = [*first.values(), *[r for r in ROWS if r[1] is None]]
    expected = Counter()
    for r in live:
        expected[r[3], r[2], token_counts.WORDS] += 1
    assert {k: v[0] for k, v in got.items() if k[2] == token_counts.WORDS} == expected
    words = Counter()
    for r in live:
        words[r[3], r[2], token_counts.WORDS] += len(WORD.findall(r[1] or ""))
    assert {k: v[1] for k, v in got.items() if k[2] == token_counts.WORDS} == words
    assert set(k[:2] for k in got if k[2] == token_counts.BPE) == set(k[:2] for k in expected)


def brute_search(rows, queries, top):
    listed = [(i, Counter(WORD.findall((t or "").lower()))) for i, t in rows]
    n, average = len(rows), max(1.0, sum(sum(c.values()) for _, c in listed) / max(1, len(rows)))
    df = Counter(w for _, c in listed for w in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in listed:
            length = sum(c.values())
            s = sum(
                np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / average))
                for w in set(WORD.findall((text or "").lower())) if w in c
            )
            if round(s, 6) > 0:
                scores.append((-round(float(s), 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("postings, terms", [(3_000_000, 1_500_000), (150, 40)])
def test_search_against_full_scores(spark, none, monkeypatch, postings, terms):
    monkeypatch.setattr(topk_search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(topk_search, "BLOCK_TERMS", terms)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None][:-1]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    queries = [r for r in rows if r[0] % 7 == 0]
    got = topk_search.search(topk_search.build_index(frame), spark.createDataFrame(queries, "doc_id bigint, text string"), top=5)
    expected = brute_search(rows, queries, 5)
    assert [(q, r, i) for q, r, i, _ in sorted(map(tuple, got.collect()))] == [(q, r, i) for q, r, i, _ in sorted(expected)]
    assert np.allclose([x[3] for x in sorted(map(tuple, got.collect()))], [x[3] for x in sorted(expected)], atol=2e-6)
    assert topk_search.search(topk_search.build_index(none), frame).count() == 0


def test_search_keeps_null_and_large_ids(spark):
    rows = [(2**53 + 1, "red fox"), (None, "red fox"), (2**53 + 3, "red fox"), (-1, "red fox"), (7, "grey wolf")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    for top, expected in [(10, [-1, 2**53 + 1, 2**53 + 3, None]), (3, [-1, 2**53 + 1, 2**53 + 3])]:
        got = topk_search.search(topk_search.build_index(frame), spark.createDataFrame([(1, "red")], "doc_id bigint, text string"), top=top)
        assert [r.doc_id for r in got.orderBy("rank").collect()] == expected


def test_language_model_sums_to_one(spark):
    frame = spark.createDataFrame([("the cat sat on the mat. " * 3,), ("a dog!",), (None,), ("xy",)], "text string")
    logs = quality_model.log_probabilities(quality_model.train(frame))
    sums = np.exp(logs.astype(float)).reshape(-1, quality_model.SYMBOLS).sum(1)
    assert np.allclose(sums, 1.0, atol=1e-4)


def test_language_model_against_plain_counts(spark):
    """Probabilities of every run seen, from dictionaries of counts."""
    texts = ["the cat sat on the mat. the hat", "that cat. a rat and a bat sat", "no"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    logs = quality_model.log_probabilities(quality_model.train(frame))
    s = quality_model.SYMBOLS
    full = Counter(c for t in texts for c in quality_model.runs(t).tolist())
    orders = {4: full}
    for n in (3, 2, 1):
        orders[n] = Counter(c % s**n for c in orders[n + 1])
    discount = {}
    for n, counts in orders.items():
        m = Counter(counts.values())
        y = m[1] / (m[1] + 2 * m[2])
        raw = [1 - 2 * y * m[2] / m[1] if m[1] else 0.5, 2 - 3 * y * m[3] / m[2] if m[2] else 1.0, 3 - 4 * y * m[4] / m[3] if m[3] else 1.5]
        discount[n] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def p(code, n):
        if n == 0:
            return 1 / s
        context = [c for c in orders[n] if c // s == code // s]
        if not context:
            return p(code % s ** (n - 1), n - 1)
        total = sum(orders[n][c] for c in context)
        off = lambda c: discount[n][min(orders[n][c], 3) - 1]
        own = orders[n][code] - off(code) if code in orders[n] else 0
        return own / total + sum(map(off, context)) / total * p(code % s ** (n - 1), n - 1)

    codes = [*full, *(c + 1 for c in list(full)[:20] if (c + 1) % s)]
    assert np.allclose(logs[codes], np.log([p(c, 4) for c in codes]), atol=1e-4)


def test_perplexities_are_those_of_the_table_of_all_runs(spark, monkeypatch):
    """Blocks joined with the model give what the plain table gives."""
    monkeypatch.setattr(quality_model, "BLOCK_CHARS", 20)
    model = quality_model.train(spark.createDataFrame([("the cat sat on the mat. " * 3,), ("a dog!",)], "text string"))
    logs = quality_model.log_probabilities(model).astype(float)
    texts = ["the cat", "a dog sat! on 3 Mats", "zzz|#*", "the mat " * 9, "no", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    got = dict(map(tuple, quality_model.perplexities(frame, model, alphabet=quality_model.CLASSES).collect()))
    for i, text in enumerate(texts):
        codes = quality_model.runs(text or "")
        assert got[i] == pytest.approx(np.exp(-logs[codes].mean()), rel=1e-4) if len(codes) else got[i] is None


def test_quality_model_knows_text_of_every_script(spark):
    """Characters of other scripts in random order are worse than the text they are from."""
    rng = random.Random(5)
    scripts = {"ru": "добрый день дорогие друзья сегодня", "el": "καλημέρα σας αγαπητοί φίλοι", "ja": "今日は良い天気ですね明日", "ko": "안녕하세요 오늘은 날씨가"}
    rows = []
    for lang, words in scripts.items():
        parts = words.split() if " " in words else [words[i : i + 3] for i in range(0, len(words), 3)]
        for i in range(40):
            good = " ".join(rng.choice(parts) for _ in range(40))
            if i >= 30:
                good = "".join(rng.sample(good, len(good)))
            rows.append((len(rows), lang, good, i < 30))
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, good boolean")
    kept = {r.doc_id: r.kept for r in quality_model.quality(docs, docs.filter("good").select("doc_id")).collect()}
    assert not any(kept[r[0]] for r in rows if not r[3])
    assert np.mean([kept[r[0]] for r in rows if r[3]]) > 0.95


def test_characters_are_told_apart():
    texts = ["abcd", "Abcd", "добр", "бодр", "你好世界", "世界你好", "안녕하세", "😀😁😂", "😂😁😀", "ＡＢＣ", "\ua000\uabff\ue000"]
    found = [tuple(quality_model.CHARACTERS.of(np.array([ord(c) for c in t]))) for t in texts]
    assert len(set(found)) == len(texts) and max(map(max, found)) < quality_model.CHARACTERS.symbols
    assert len(found[7]) == 6 and len(found[6]) == 4


def test_quality_model_on_held_out_labels(spark):
    """Trained on half of the good documents, it parts the other half from the bad ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trusted = labels.filter("quality = 1 AND toxic = 0 AND doc_id % 2 = 0").select("doc_id")
    rows = quality_model.quality(docs, trusted).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_quality_model_edges(docs, none):
    ids = docs.select("doc_id").filter("doc_id % 2 = 0")
    rows = quality_model.quality(docs, ids).collect()
    assert len(rows) == len(ROWS) and all(not r.kept for r in rows if r.perplexity is None)
    assert quality_model.quality(none, ids).count() == 0
    assert not any(r.kept for r in quality_model.quality(docs, ids.filter("false")).collect())


def test_pipeline_stages(spark, docs, none, folder, tmp_path):
    """Each stage against its operator's brute force, on what the one before it kept."""
    path = f"{tmp_path}/in"
    rows = [(r[0], " ".join([r[1] or ""] * (3 if r[0] is not None and r[0] % 3 else 1)) + ".", *r[2:]) for r in ROWS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    frame = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in frame.collect()]
        out = stage(spark, frame, path)
        after = out.collect()
        if name != "sentence_pieces":
            assert out.columns == docs.columns
        if name == "near_dedup":
            assert key(r.doc_id for r in after) == key(r[0] for r in brute_components(before) if r[3])
        if name == "substring_dedup":
            got = [(r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest()) for r in after]
            assert key(got) == key((r[0], r[3]) for r in brute_removed(before))
        if name == "sentence_pieces":
            held = sentence_pieces.load()
            assert after and all(sentence_pieces.decode(held, r.ids) == r.text for r in after)
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert stage(spark, none, path).count() == 0
    assert corpus_pipeline.run(spark, path).count() == frame.count()


def test_passages_meet_their_words_across_batches():
    """Words that come twice, for a passage nobody asked for, or in the batch after the passage."""
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("lo", pa.int64()), ("j", pa.int32()), ("w", pa.list_(pa.int64()))])
    rows = [(1, 1, 5, None), (1, 2, None, [2]), (1, 3, 7, None), (1, 3, None, [3]), (1, 3, None, [3]), (2, 3, None, [4]), (2, 4, 0, None), (2, 4, None, [6])]
    # The first passage has no words of its own: they belong to another one.
    expected = [(1, 3, 7, [3]), (2, 4, 0, [6])]
    for size in range(1, len(rows) + 1):
        parts = [[(h, h, f, lo, 0, w) for h, f, lo, w in rows[i : i + size]] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in part], schema) for part in parts]
        found = [r for b in substring_dedup._with_words(lambda x: x)(iter(batches)) for r in b.to_pylist()]
        assert [(r["h"], r["f"], r["lo"], r["w"]) for r in found] == expected


def test_substring_dedup_joins_no_passages_with_their_words(spark, monkeypatch):
    """Words meet their passages in the shards; only anchors of very many passages are joined."""
    plans = []
    monkeypatch.setattr(substring_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    rng = random.Random(3)
    shared = " ".join(f"p{i}" for i in range(14))
    rows = [(i, f"a{rng.random()} {shared} b{rng.random()}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring_dedup.without_repeats(frame, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(map(tuple, found.collect())) == key(brute_removed(rows))
    assert plans and not any("first(w" in p for p in plans)


def test_word_hashes_travel_in_small_batches(spark, monkeypatch):
    anchors, setting = substring_dedup._all_anchors, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def counted(batches):
        for batch in batches:
            assert batch.num_rows <= 7
            yield from anchors(iter([batch]))

    monkeypatch.setattr(common, "LIST_ROWS", 7)
    monkeypatch.setattr(substring_dedup, "_all_anchors", counted)
    rows = [(i, " ".join(f"w{j + i % 40}" for j in range(40))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = substring_dedup.without_repeats(frame, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(map(tuple, found.collect())) == key(brute_removed(rows))
    assert spark.conf.get(setting) == before


def test_texts_of_one_portion_become_strings(monkeypatch):
    """Not those of the whole batch: a worker holds the Python strings of some texts only."""
    held, most, asked = sentence_pieces.load(), 0, sentence_pieces.encode_texts

    def counted(vocabulary, texts):
        nonlocal most
        most = max(most, sum(len(t or "") for t in texts))
        return asked(vocabulary, texts)

    monkeypatch.setattr(sentence_pieces, "CHUNK_CHARS", 50)
    monkeypatch.setattr(sentence_pieces, "encode_texts", counted)
    texts = [r[1] for r in ROWS] + ["é😀 x", None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})

    class Unlisted:
        schema, num_rows, slice = batch.schema, batch.num_rows, batch.slice

        def column(self, name):
            found = batch.column(name)
            return found if name != "text" else _NoList(found)

    class _NoList:
        def __init__(self, found):
            self.found = found

        def __len__(self):
            return len(self.found)

        def __arrow_c_array__(self, requested_schema=None):
            return self.found.__arrow_c_array__(requested_schema)

        def to_pylist(self):
            raise AssertionError("the whole batch became Python strings")

    monkeypatch.setattr(sentence_pieces.pc, "utf8_length", lambda c, f=sentence_pieces.pc.utf8_length: f(pa.array(c)))
    parts = list(sentence_pieces._encoded(type("Held", (), {"value": held}), "text", "ids", False)(iter([Unlisted()])))
    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert [r["ids"] for b in parts for r in b.to_pylist()] == [model.encode(t or "") for t in texts]
    assert len(parts) > 1 and most < 50 + max(len(t or "") for t in texts)


def test_exploded_signatures_are_not_broadcast(spark):
    """Spark sizes the file as if a signature had one entry, so the posting lists seem small enough to send to all."""
    classes = cut(spark.range(300).selectExpr("id AS c", "transform(sequence(0, 63), i -> CAST((id * 31 + i) % 97 AS INT)) AS sign"))
    plan = near_dedup._prefixes(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    pairs = cut(spark.range(299).selectExpr("id AS a", "id + 1 AS b"))
    plan = near_dedup._agreeing(pairs, classes.withColumn("n", F.lit(64)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastExchange" not in plan


def test_search_holds_one_shard_and_few_documents_at_once(spark, monkeypatch):
    """A shard is one row of many MB, so rows by the thousand would put all shards of a task into one batch."""
    shards, searched, seen = topk_search._shards, topk_search._searched, spark.sparkContext.accumulator(0)

    def built(batches):
        for batch in batches:
            assert batch.num_rows <= 7
            yield from shards(iter([batch]))

    def counted(*args):
        def each(batches):
            for batch in batches:
                assert batch.num_rows == 1
                seen.add(1)
                yield batch

        return lambda batches: searched(*args)(each(batches))

    monkeypatch.setattr(common, "LIST_ROWS", 7)
    monkeypatch.setattr(topk_search, "_shards", built)
    monkeypatch.setattr(topk_search, "_searched", counted)
    rows = [(i, f"red w{i} w{i % 5} " + "fox " * (i % 4)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = topk_search.search(topk_search.build_index(frame), frame.filter("doc_id % 9 = 0"), top=3)
    expected = brute_search(rows, [r for r in rows if r[0] % 9 == 0], 3)
    assert [(q, r, i) for q, r, i, _ in sorted(map(tuple, got.collect()))] == [(q, r, i) for q, r, i, _ in sorted(expected)]
    assert seen.value >= 9


def test_shards_leave_out_what_earlier_ones_surpass():
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array([[7, 7], [7, 7], [7, 9, 9, 9, 9], [7, 7]], pa.list_(pa.int64()))], ["doc", "w"])
    index = [next(topk_search._shards(iter([part]))) for part in (batch.slice(0, 2), batch.slice(2, 2))]

    class Held:
        value = np.array([5]), np.array([0, 1]), np.array([7]), np.array([1.0])

    found = [b.column("doc_id").to_pylist() for b in topk_search._searched(Held, 2.0, 2)(iter(index))]
    assert found == [[1, 2], [4]]

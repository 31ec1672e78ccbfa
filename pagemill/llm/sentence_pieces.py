"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which makes them a trie in depth-first order: the
states of all prefixes that a word shares with the one before it are kept, and only the rest is
computed. A state is the best last piece of a prefix.

In a unigram model that is the piece of the best score (Viterbi). In a BPE model the merged pieces of a
prefix do not depend on what follows, so its last piece is the one piece that may follow the pieces of
the shorter prefix; two pieces may stand side by side if no merge across their border comes before
the merges that make them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters that are worked on at once.
CHUNK_CHARS = 1_000_000
#: Pairs of pieces whose fit a task remembers at most.
MOST_PAIRS = 1_000_000
#: Words, of at most so many characters, whose ids a task remembers at most.
MOST_WORDS, LONGEST_WORD = 300_000, 40
_NEVER = 1 << 40


@dataclass
class Pieces:
    """A vocabulary. ``ends`` has every ending of a piece: its id if it is a piece that the model can
    give, else -1. ``spans`` has, for BPE, per id the symbols at the left and at the right border while
    the piece is merged, each with the rank of the merge that replaces it."""

    bpe: bool
    pieces: list[str]
    scores: list[float]
    raw: list[bytes]
    byte_ids: list[int]
    ends: dict[str, int]
    rank: dict[str, int]
    spans: dict[int, tuple[list[tuple[str, int]], list[tuple[str, int]]]]
    barriers: str
    worst: float
    fits: dict[int, bool] = field(default_factory=dict)
    known: dict[str, list[int]] = field(default_factory=dict)

    def fit(self, a: int, b: int) -> bool:
        """Whether BPE leaves pieces ``a`` and ``b`` apart. Of equal ranks the left one merges first."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            rank = self.rank
            known = self.fits[key] = not any(
                (r := rank.get(x + y, _NEVER)) < until_x and r <= until_y
                for x, until_x in self.spans[a][1]
                for y, until_y in self.spans[b][0]
            )
        return known


def _merge(word: str, rank: dict[str, int]) -> tuple[list[str], list[tuple[str, int]], list[tuple[str, int]]]:
    """BPE of a short word: its pieces, and the symbols its left and right border had."""
    symbols, left, right = list(word), [], []
    while True:
        best = min(((rank.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(_NEVER, 0))
        if best[0] == _NEVER:
            return symbols, [*left, (symbols[0], _NEVER)], [*right, (symbols[-1], _NEVER)]
        at = best[1]
        if at == 0:
            left.append((symbols[0], best[0]))
        if at == len(symbols) - 2:
            right.append((symbols[-1], best[0]))
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def load(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file with identity normalisation, a space put in front, and bytes for
    unknown characters."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    scores = [model.get_score(i) for i in ids]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)} | set(byte_ids)
    usable = [i for i in ids if i not in special]
    # A unigram model scores by log probability, a BPE model by whole negative ranks.
    bpe = all(float(scores[i]).is_integer() for i in usable)
    order = {s: n for n, s in enumerate(sorted({scores[i] for i in usable}, reverse=True))}
    rank = {pieces[i]: order[scores[i]] for i in usable if len(pieces[i]) > 1} if bpe else {}
    spans, ends = {}, {}
    for i in usable:
        if bpe:
            merged, left, right = _merge(pieces[i], rank)
            if len(merged) > 1:
                continue
            spans[i] = (left, right)
        for at in range(1, len(pieces[i])):
            ends.setdefault(pieces[i][at:], -1)
        ends[pieces[i]] = i
    raw = [b"" if i in special else pieces[i].replace(MARK, " ").encode() for i in ids]
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    letters = {c for i in usable for c in pieces[i]}
    barriers = "".join(c for c in "\t\n\v\f\r" if c not in letters)
    return Pieces(bpe, pieces, scores, raw, byte_ids, ends, rank, spans, barriers, min(scores[i] for i in usable) - 10.0)


def splitter(held: Pieces) -> re.Pattern:
    """Cuts a marked text where no piece can reach across: before marks, and around barriers."""
    stop = re.escape(held.barriers)
    return re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|[{stop}]" if stop else ""))


def encode_sorted(held: Pieces, words: list[str]) -> list[list[int]]:
    """Piece ids of each word; the words come sorted. An unknown character gives its bytes' ids."""
    ends, pieces, scores, bpe, fit, fits = held.ends, held.pieces, held.scores, held.bpe, held.fit, held.fits
    last, best, before, out = [-1], [0.0], "", []
    for word in words:
        same, most = 0, min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        del last[same + 1 :], best[same + 1 :]
        for i in range(same + 1, len(word) + 1):
            found, score = -1, best[i - 1] + held.worst if not bpe else 0.0
            for j in range(i - 1, -1, -1):
                piece = ends.get(word[j:i])
                if piece is None:
                    break
                if piece < 0:
                    continue
                if bpe:
                    left = last[j]
                    if left < 0:
                        found = piece
                        break
                    fits_here = fits.get(left << 20 | piece)
                    if fits_here or fits_here is None and fit(left, piece):
                        found = piece
                        break
                elif best[j] + scores[piece] > score or found < 0 and best[j] + scores[piece] == score:
                    found, score = piece, best[j] + scores[piece]
            last.append(found)
            best.append(score)
        ids, i = [], len(word)
        while i:
            if last[i] < 0:
                ids += [held.byte_ids[b] for b in reversed(word[i - 1].encode())]
                i -= 1
            else:
                ids.append(last[i])
                i -= len(pieces[last[i]])
        out.append(ids[::-1])
        before = word
    return out


def encode_texts(held: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, offsets of the texts in them)."""
    cut = splitter(held)
    units, ends = [], [0]
    for text in texts:
        if text:
            units += cut.findall((" " + text).replace(" ", MARK))
        ends.append(len(units))
    coded = pa.array(units, pa.large_string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    # Words met in earlier portions are not walked again.
    known = held.known
    lists: list[list[int]] = [known.get(w, []) for w in words]
    order = sorted([i for i, w in enumerate(words) if w not in known], key=words.__getitem__)
    if len(known) + len(order) > MOST_WORDS:
        known.clear()
    for at, ids in zip(order, encode_sorted(held, [words[i] for i in order])):
        lists[at] = ids
        if len(words[at]) <= LONGEST_WORD and len(known) < MOST_WORDS:
            known[words[at]] = ids
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = np.array([i for x in lists for i in x], np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    which = coded.indices.to_numpy()
    count = lengths[which]
    sums = np.concatenate([[0], np.cumsum(count)])
    places = np.arange(sums[-1]) + np.repeat(starts[which] - sums[:-1], count)
    return flat[places], sums[np.array(ends)]


def decode(held: Pieces, ids: list[int]) -> str:
    """The text of the ids; the space that encoding put in front is taken off. Bytes that are no
    valid text become replacement characters."""
    raw = held.raw
    whole = b"".join([raw[i] for i in ids])
    return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def _portions(column: pa.Array) -> Iterator[slice]:
    start = size = 0
    for i, n in enumerate(pc.utf8_length(column).fill_null(0).to_pylist()):
        size += n
        if size >= CHUNK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(column):
        yield slice(start, len(column))


def _encoded(held: Broadcast, text: str, name: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for batch in batches:
            for part in _portions(batch.column(text)):
                rows = batch.slice(part.start, part.stop - part.start)
                # Texts of a portion only, not of the batch, become Python strings.
                texts = rows.column(text).to_pylist()
                ids, offsets = encode_texts(vocabulary, texts)
                if digest:
                    listed, bounds = ids.tolist(), offsets.tolist()
                    same = [
                        decode(vocabulary, listed[a:z]) == (t or "") for t, a, z in zip(texts, bounds, bounds[1:])
                    ]
                    prints = [hashlib.sha256(ids[a:z].astype("<i4").tobytes()).hexdigest() for a, z in zip(bounds, bounds[1:])]
                    names = [n for n in rows.schema.names if n != text]
                    new = [pa.array(np.diff(offsets)), pa.array(prints, pa.string()), pa.array(same)]
                    names_new = ["n_tokens", "ids_sha256", "round_trip"]
                else:
                    names = list(rows.schema.names)
                    new = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                    names_new = [name]
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], *new], [*names, *names_new])

    return run


def encode(docs: DataFrame, text: str = "text", name: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the piece ids of the text as an array. A null or empty text has no ids. Rows are
    encoded one by one, equal ones alike; a column called ``name`` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(load(model))
    rest = docs.drop(name)
    schema = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    return rest.mapInArrow(_encoded(held, text, name, False), f"{schema}, `{name}` array<int>")


def decode_column(rows: DataFrame, ids: str = "ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of the ids; null ids give null."""
    held = rows.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(held.value, x) for x in batch.column(ids).to_pylist()]
            names = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, name])

    rest = rows.drop(name)
    schema = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    return rest.mapInArrow(run, f"{schema}, `{name}` string")


def op7_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole document encoded and decoded again: number of ids, their digest (as little-endian
    32-bit integers), and whether decoding gives the text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = spark.sparkContext.broadcast(load())
    return docs.mapInArrow(
        _encoded(held, "text", "ids", True), "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean"
    ).select("doc_id", "n_tokens", "ids_sha256", F.col("round_trip"))


QUERIES = {"op7_sentence_pieces": (op7_sentence_pieces, None)}

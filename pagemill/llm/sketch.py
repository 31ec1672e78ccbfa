"""Hashing of word runs in numpy, and fixed-size filters that are small enough to broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are worked on at once.
CHUNK_WORDS = 100_000
#: Bits of a filter, as a power of two, at most: 16 MB. Past that, more keys only let more rows pass.
FILTER_BITS = 27
#: A filter of few keys is folded to so many bits for each bit that is set, or somewhat more.
SPARE = 32
_PART_BITS = 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> _S)) * _MUL
    x = (x ^ (x >> _S)) * _MUL
    return x ^ (x >> _S)


def grams(flat: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` values."""
    m = len(flat) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(n if m > 0 else 0):
        out = (out ^ (out >> _S)) * _ODD + flat[i : i + m]
    return mix(out)


def chunks(batch: pa.RecordBatch, listed: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, values, offsets) for runs of rows with about ``CHUNK_WORDS`` list entries."""
    column = batch.column(listed)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_WORDS, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield row, values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _bits(keys: np.ndarray, bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in a filter of 2 ** ``bits`` bits: those of a smaller filter are the first bits of
    those of a larger one."""
    spread = mix(keys)
    return spread >> np.uint64(64 - bits), mix(spread ^ _ODD) >> np.uint64(64 - bits)


def _folded(whole: np.ndarray) -> np.ndarray:
    """A filter as small as its keys allow: neighbouring bytes become one bit, and so on while bits are spare."""
    needed = SPARE * int(sum(np.unpackbits(part).sum() for part in np.array_split(whole, 64)))
    while len(whole) >= needed and len(whole) > 128:
        whole = np.packbits(whole > 0)
    return whole


def filter_of(keys: DataFrame) -> Broadcast:
    """A Bloom filter of the one bigint column of ``keys``, broadcast. Its parts are built by as many
    tasks as the keys need; the driver sees 2 ** FILTER_BITS bits at most. Who has written what needed the filter
    should ``destroy`` it."""
    name = keys.columns[0]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(_bits(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["_bit"])

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _PART_BITS, np.uint8)
        bits[rows["_bit"].to_numpy() & ((1 << _PART_BITS) - 1)] = 1
        return pd.DataFrame({"part": [int(rows["_bit"].iloc[0]) >> _PART_BITS], "bits": [np.packbits(bits).tobytes()]})

    marked = keys.select(F.col(name).cast("bigint")).mapInArrow(places, "_bit bigint").distinct()
    parts = marked.groupBy(F.shiftright("_bit", _PART_BITS).alias("_p")).applyInPandas(part, "part int, bits binary")
    whole = np.zeros((1 << FILTER_BITS) >> 3, np.uint8)
    for row in parts.toLocalIterator():
        got = np.frombuffer(row["bits"], np.uint8)
        whole[row["part"] * len(got) : (row["part"] + 1) * len(got)] = got
    return keys.sparkSession.sparkContext.broadcast(_folded(whole))


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; false only for keys that are not."""
    out = np.ones(len(keys), bool)
    for place in _bits(keys, len(bits).bit_length() + 2):
        place = place.astype(np.int64)
        out &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
    return out


def held_rows(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which of a column of bigints may be in the filter. Null is not."""
    known = keys.is_valid().to_numpy(zero_copy_only=False)
    return may_hold(bits, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & known


def filter_column(held: Broadcast):
    """A function of a bigint column: whether the value may be in the filter. Null is not."""

    @F.arrow_udf("boolean")
    def hit(keys: pa.Array) -> pa.Array:
        return pa.array(held_rows(held.value, keys))

    return hit

"""Hashes of words for Arrow batches of texts, and of five-word shingles for batches of word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.llm.common import ws_words

WORDS = 5
MOST_WORDS = 1 << 20
_rng = np.random.default_rng(20240607)
#: Odd multipliers, one for each place in a shingle.
PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHORT = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes whose words are hashed at once.
MOST_BYTES = 1 << 20
#: A factor for each byte, of A-Z that of a-z, and 0 for ASCII white space.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
BYTE[[32, *range(9, 14)]] = 0


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""
    return F.transform(ws_words(text), lambda w: F.xxhash64(w))


def hashed(column: pa.StringArray | pa.LargeStringArray) -> pa.ListArray:
    """64-bit hashes of each text's words, as many and equal where those of word_hashes are; null as empty."""
    column = column.fill_null("")
    _, ends, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, counts, start = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while start < len(column):
        stop = min(len(column), max(start + 1, int(np.searchsorted(ends, ends[start] + MOST_BYTES, side="right")) - 1))
        text, rows = data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop
        solid = (text != 32) & ((text - np.uint8(9)) > 4)
        new = solid.copy()
        new[1:] &= ~solid[:-1]
        heads = rows[:-1][rows[1:] > rows[:-1]]
        new[heads] = solid[heads]
        at = np.flatnonzero(new)
        counts.append(np.diff(np.searchsorted(at, rows)))
        if len(at):
            first, size = at - at[0], np.diff(at, append=len(text))
            place = np.ones(len(text) - at[0], np.int64)
            place[first] -= np.concatenate(([1], size[:-1]))
            place = np.cumsum(place)  # in the word and the gap after it
            by = mixed(np.arange(1, int(size.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)  # a factor for each place in a word
            out.append(mixed(np.add.reduceat(BYTE[text[at[0] :]] * by[place], first)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(out).view(np.int64)))


def with_words(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches with the word hashes of a column of texts, as w, in its place."""
    for batch in batches:
        others = [n for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), hashed(batch.column(column))], [*others, "w"])


def mixed(x: np.ndarray, by: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets) of a list column without nulls; values of 32 bits are widened."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.view(np.uint64) if values.dtype.itemsize == 8 else values.view(np.uint32).astype(np.uint64), offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most MOST_WORDS words, or of one row, so that long texts do not multiply what a task holds."""
    for batch in batches:
        offsets, start = batch.column(column).offsets.to_numpy(), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + MOST_WORDS, side="right")) - 1)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = min(stop, batch.num_rows)


def places(values: np.ndarray) -> np.ndarray:
    """Hash of the shingle that starts at each place; the last four places are short."""
    if len(values) < WORDS:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - WORDS + 1, np.uint64)
    for j in range(WORDS):
        out += values[j : len(values) - WORDS + 1 + j] * PLACE[j]
    return mixed(out)


def whole(values: np.ndarray) -> np.ndarray:
    """The one shingle of a sequence of one to four words."""
    n = len(values)
    return mixed((values * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + SHORT[n - 1])


def sets(column: pa.ListArray) -> list[np.ndarray]:
    """For each row its distinct shingles, ascending; empty without words."""
    values, offsets = flat(column)
    every, out = places(values), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(distinct(every[a : b - WORDS + 1]))
        else:
            out.append(whole(values[a:b]) if b > a else every[:0])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays without repeats."""
    z = np.concatenate((x, y))
    z.sort(kind="stable")
    return int((z[1:] == z[:-1]).sum())

"""Shared pieces: reading tables, batches of bounded size, words and their hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Numpy passes hold about 60 bytes for each byte of text, so this bounds a task's memory.
SLICE_BYTES = 2 << 20
#: For passes with more than one array of numbers for each word.
SMALL_SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as make it differ from all that are taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads each input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept between batches."""
    if not _powers or len(_powers[0]) < n:
        step = SMALL_SLICE_BYTES
        size = max(1, -(-(n - 1) // step)) * step + 1  # whole small slices, so that few lengths make them anew
        _powers[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers[0], _powers[1]


class Words:
    """The words of a slice of texts. ``start`` and ``end`` are byte places in ``data``.

    Words are runs of bytes for which ``inside`` holds; by default, all but ASCII white space.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``text`` is each word's text.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray = ~_SPACE):
        raw, first_byte, ends = _bytes(texts)
        self.data = _LOWER[raw] if lower else raw
        self.offsets = np.concatenate([[0], ends - first_byte])
        n = len(self.data)
        inside = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.start, self.offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes between the places, the same wherever they stand."""
        power, inverse = _power_tables(len(self.data) + 1)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            terms = self._sums[1:]  # in place: eight bytes for each byte of text, once
            np.take(_BYTE_CODE, self.data, out=terms, mode="clip")
            terms *= power[: len(self.data)]
            np.cumsum(terms, out=terms)
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; the last ``n - 1`` places of the array have none."""
    if len(word) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word[k : k + len(out)]
    return mix(out)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, int, np.ndarray]:
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.empty(0, np.uint8), 0, np.empty(0, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[places[0] : places[-1]], int(places[0]), places[1:]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has at most ``rows`` texts of at most ``most`` bytes, or one longer text."""
    where = None
    for batch in batches:
        where = batch.schema.get_field_index(column) if where is None else where
        _, begin, ends = _bytes(batch.column(where))
        low = 0
        while low < len(ends):
            base = int(ends[low - 1]) if low else begin
            high = min(low + rows, max(low + 1, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(low, high - low)
            low = high


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())

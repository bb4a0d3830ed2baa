"""Helpers that several text operators share: scratch tables and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import fresh_path

#: Bytes of text that one vectorised pass holds; a longer single text makes a pass of its own.
PASS_BYTES = 1 << 19
#: Bits of a sieve for each key, as a power of two, and in all at most.
SIEVE_SPARE, SIEVE_BITS = 4, 27
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared scratch folder, reread: later steps start from the files, so a lost
    executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PASS_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a run of texts, in order.

    text: each word's text (index into the run); start, end: its bytes in data; hash: 64 bits of its
    lower-cased bytes; first[i]:first[i + 1] are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        if lower:
            data = _LOWER[data]
        self.data = data
        solid = np.ones(n + 1, np.int8)
        solid[:n] = ~_BLANK[data]
        solid[n] = 0
        edge = np.diff(solid, prepend=np.int8(0))
        # a text's first byte starts a word even where the text before it ends in one
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        inner = cut[(solid[cut] == 1) & (solid[cut - 1] == 1)]
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(inner):
            inner = np.unique(inner)
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self._total, self._inverse = total, inverse
        self.hash = self.span_hash(start, end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the bytes start:end of data, for many spans at once."""
        return mix((self._total[end] - self._total[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def _columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def text_runs(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about PASS_BYTES of text: first row, last row (exclusive), bytes, offsets from 0."""
    if not batch.num_rows:
        return
    data, offsets = _columns(batch, name)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PASS_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each window of k words; a text of fewer words (one at least) is one shorter window."""
    count = np.diff(words.first)
    at = np.arange(len(words.hash))
    left = words.first[1:][words.text] - at  # words from here to the text's end
    keep = (left >= k) | (at == words.first[:-1][words.text])
    at, left = at[keep], np.minimum(left[keep], k)
    out = np.zeros(len(at), np.uint64)
    factor = np.uint64(1)
    for j in range(k):
        factor = np.uint64((int(factor) * 0xD1342543DE82EF95 + 2 * j + 1) % (1 << 64)) | np.uint64(1)
        inside = left > j
        out[inside] += words.hash[at[inside] + j] * factor
    out = mix(out + count[words.text[at]].clip(max=k).astype(np.uint64))
    return out, words.text[at]


def sieve(keys: DataFrame) -> np.ndarray:
    """Two bits for each hash of keys(key), gathered in Spark."""
    bits = min(SIEVE_BITS, max(10, int(keys.count()).bit_length() + SIEVE_SPARE))
    low, high = f"key & {(1 << bits) - 1}L", f"shiftrightunsigned(key, 32) & {(1 << bits) - 1}L"
    found = keys.selectExpr(f"explode(array({low}, {high})) AS spot").selectExpr("shiftright(spot, 6) AS at", "shiftleft(1L, CAST(spot & 63 AS int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the keys may be among the sieve's."""
    size = np.uint64(64 * len(bits) - 1)
    held = lambda spot: (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
    out = held(key & size)
    some = np.flatnonzero(out)
    out[some] = held(key[some] >> np.uint64(32) & size)
    return out

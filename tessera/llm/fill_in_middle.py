"""Fill-in-middle over a sparse checkpoint index.

A text's units ([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+, left to right) are counted in hops of a
fixed number of units; each hop leaves one checkpoint, the bytes and code points before it. A cut is then found by
binary search among the checkpoints, by units, code points or bytes, and a rescan of less than one hop. So a text of
any length costs one pass and one checkpoint a hop, never a list of its units.

Defined results: a null text is empty; an empty text and one that holds a sentinel stay as they are (plain); a null id
counts as the empty string in the hash; repeated rows are cut alike; an empty table gives an empty one; further
columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import PASS_BYTES

#: What marks the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints.
EVERY = 256

_UNIT = rb"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
_ONE = re.compile(_UNIT + rb"|[\x20\x09-\x0D]++")


@lru_cache
def _hop(n: int) -> re.Pattern[bytes]:
    """Matches just n units that end in a word; only a text's last unit can be blank."""
    return re.compile(rb"(?:%b){%d}" % (_UNIT, n))


def _points(data: bytes) -> int:
    return len(data.decode())


@dataclass(frozen=True)
class Place:
    """What lies before a place between two units."""

    units: int
    points: int
    bytes: int


class Checkpoints:
    """The index of one text, given as UTF-8."""

    def __init__(self, data: bytes, every: int = EVERY):
        self.data, self.every = data, every
        self.bytes, self.points = [0], [0]
        hop, at = _hop(every), 0
        while found := hop.match(data, at):
            self.points.append(self.points[-1] + _points(data[at : found.end()]))
            self.bytes.append(at := found.end())
        self.units = range(0, every * len(self.bytes), every)
        self.n = self.units[-1] + sum(1 for _ in _ONE.finditer(data, at))

    def cut(self, units: int | None = None, points: int | None = None, bytes: int | None = None) -> Place:
        """The last place between two units that has at most so many units, code points or bytes before it."""
        held, most = (self.units, units) if units is not None else (self.points, points) if points is not None else (self.bytes, bytes)
        k = bisect_right(held, most) - 1
        place = Place(self.units[k], self.points[k], self.bytes[k])
        start, at, done = place.bytes, place.bytes, place.units
        while found := _ONE.match(self.data, at):
            ahead = done + 1 if units is not None else found.end() if bytes is not None else place.points + _points(self.data[start : found.end()])
            if ahead > most:
                break
            at, done = found.end(), done + 1
        return Place(done, place.points + _points(self.data[start:at]), at)


@dataclass(frozen=True)
class Cuts:
    """rate of 100 documents are cut, spm of 100 of those suffix first; the seed goes into the hash of the id."""

    rate: int = 50
    spm: int = 80
    seed: str = "42"
    every: int = EVERY


def transformed(data: bytes, doc_id: object, how: Cuts = Cuts()) -> tuple[int, str, int | None, int | None, bytes]:
    """units, form, prefix and middle in code points (none if plain), and the output."""
    index = Checkpoints(data, how.every)
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or h3 % 100 >= how.rate or any(mark in data for mark in (p, s, m)):
        return index.n, "plain", None, None, data
    a, b = (index.cut(units=k) for k in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix = data[: a.bytes], data[a.bytes : b.bytes], data[b.bytes :]
    form, output = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < how.spm else ("psm", (p, prefix, s, suffix, m, middle))
    return index.n, form, a.points, b.points - a.points, b"".join(output)


def filled(docs: DataFrame, how: Cuts = Cuts()) -> DataFrame:
    """docs(doc_id, text) to doc_id, n, form, prefix_chars, middle_chars, output: each row by itself, no shuffle."""
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), *(T.StructField(k, T.StringType() if k in ("form", "output") else T.LongType()) for k in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, held, first = [], 0, 0
            for i in range(batch.num_rows):
                buffer = texts[i].as_buffer() if texts[i].is_valid else None
                row = transformed(buffer.to_pybytes() if buffer is not None else b"", ids[i].as_py(), how)
                rows.append(row)
                held += len(row[-1])
                if held >= PASS_BYTES or i == batch.num_rows - 1:
                    n, form, prefix, middle, output = zip(*rows)
                    arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *arrays], names=["doc_id", *names])
                    rows, held, first = [], 0, i + 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form. The text of a cut document holds no sentinel and none can arise at a seam
    (each begins with < and ends with >), so the sentinels are where the output is split."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)

"""Concatenate-and-cut packing of tokenized documents.

Two passes over partition token totals: the first tokenizes, writes the tokens with each document's place in its
partition and yields one total per partition; exclusive prefix sums over these totals give every document its global
token offset. The second cuts the one long token line at multiples of the window, document by document, so a boundary
record is one (document, window) piece and no task needs its neighbours' tokens.

Defined results: a null text is empty and packs as its end token alone; repeated rows are packed each on its own; an
empty table gives no pieces; further columns are ignored. Rows keep the order of the scan, so the last sequence alone
is shorter than the window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import written

WINDOW = 2048
END_ID = 1
#: Distinct words after which a worker process begins to remember others, the longest it remembers, and new words that
#: are encoded at a time. It remembers them with their ids from task to task; of the words before only those that it met
#: again stay, so it holds twice as many at most, some 200 bytes each.
CACHE_WORDS, CACHE_BYTES, AT_ONCE = 1 << 19, 48, 400

#: A run of these marks at the end of a word is encoded apart from the letter or digit before it.
MARKS, ALNUM = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """The little-endian uint32 ids of texts, by a tokenizer file.

    The tokenizer's pre-tokenizer never joins characters across white space, its normalizer maps white space to one
    space and lowers letters, and a run of ASCII letters ends before punctuation; so a text's ids are the ids of its
    blank-separated lower-cased words in order, and each distinct word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encodes some distinct words as one text and cuts its ids at the words' places."""
        for at in range(0, len(new), AT_ONCE):
            some = [w.decode() for w in new[at : at + AT_ONCE]]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            cuts = np.searchsorted(np.array([x for x, _ in found.offsets], np.int64), starts)
            for word, i, j in zip(new[at : at + AT_ONCE], cuts[:-1].tolist(), cuts[1:].tolist()):
                self.known[word] = ids[i:j].tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        raw = [t.encode() if t else b"" for t in texts]
        lists = [(x if b"<|" in x else x.lower()).split() for x in raw]  # special tokens are lower-case as they are
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set().union(*lists).difference(known)
        if before:
            again = new.intersection(before)
            known.update((w, before[w]) for w in again)
            new -= again
        if new:
            odd = [w for w in new if len(w) > CACHE_BYTES or b"<|" in w]
            plain = new.difference(odd)
            tailed = [(w, w[: len(c)], w[len(c) :]) for w in plain if len(c := w.rstrip(MARKS)) < len(w) and c and c[-1] in ALNUM]
            plain.difference_update(w for w, _, _ in tailed)
            parts = {c for w in tailed for c in w[1:]}.difference(known, plain)
            again = parts.intersection(before)
            known.update((c, before[c]) for c in again)
            self._learn([*plain, *(parts - again)])
            for w, c, tail in tailed:
                known[w] = known[c] + known[tail]
            for w in odd:
                known[w] = self._alone(w)
        out = [b"".join(map(known.__getitem__, words)) for words in lists]
        if new:
            for w in odd:
                del known[w]
        return out


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = word_ids(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids = [x + end for x in words.of(some.column(1).to_pylist())]
                count = np.array([len(x) // 4 for x in ids], np.int64)
                first = before + np.cumsum(count) - count
                before += int(count.sum())
                # ids stay below 2^16 in the public vocabularies of 49k words, which halves the table
                small = [np.frombuffer(x, "<u4") for x in ids]
                stored = [x.astype("<u2").tobytes() if x.max(initial=0) < 65536 else x.tobytes() for x in small]
                yield pa.record_batch({"doc_id": some.column(0).cast(pa.int64()), "part": pa.array([part] * len(ids), pa.int32()), "first": first, "n_tokens": count, "ids": pa.array(stored, pa.binary())})

    return run


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """First pass: doc_id, part, first (tokens before it in its partition), n_tokens, ids (binary), written once so
    that both uses and any retry see the same places."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_tokenized(tokenizer), "doc_id long, part int, first long, n_tokens long, ids binary"), "tokens")


def _cut(window: int, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, part, first, n, ids in zip(*(batch.column(k).to_pylist() for k in range(5))):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                begin, at = base[part] + first, 0
                while at < n:
                    sequence, offset = divmod(begin + at, window)
                    length = min(window - offset, n - at)
                    out.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, sequence, offset))
                    at += length
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    What the driver holds is one total per partition of the scan, not per document."""
    tokens = tokenized(docs, tokenizer)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, before = {}, 0
    for row in totals:
        base[row.part] = before
        before += row.n
    return tokens.select("doc_id", "part", "first", "n_tokens", "ids").mapInArrow(_cut(window, base), PIECES)

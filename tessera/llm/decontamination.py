"""Benchmark decontamination by spaced-seed hashing.

Fixed masks slide over the words of benchmark items and documents; a mask ignores some of its places, so a window with
substituted words there still hashes alike. Hash hits are aligned to the item they came from, and the whole overlap
around the hit is compared word by word; an item counts as leaked where enough of its words, or RUN in a row, stand at
their places.

No such item is missed, wherever the other words were substituted: the masks are all those of 3 words within 5, and of
4 within 6 for items of LONG words or more. Were there no 3 standing words in any 5 places, at most 2 * ceil(n / 5) of n
words stood, fewer than max(LEAST, SHARE * n) for each n; without 4 in any 6, at most 3 * (n // 6) + min(n % 6, 3),
fewer than SHARE * n for each n from 16. RUN words in a row hold 4 in a row.

Words are [^\\x20\\x09-\\x0D]+ of the lower-cased text, ASCII punctuation stripped at both ends; words of nothing else are
left out. Seed hashes of items and documents meet in a join, behind a sieve of bounded size; documents are read twice,
whatever the benchmark's size.

Defined results: null or empty texts and items match nothing, and so do items of fewer than LEAST words, which say too
little to be told from chance; a repeated document row reports its own matches;
repeated items report each under its own item_id; a null doc_id or item_id is kept as null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, passes, sieve, text_runs, written

#: Items of so many words have masks of four words, shorter ones of three.
LONG = 16
#: Masks by the least number of words of the items they serve: the places of the words that count.
MASKS = {LONG: [(0, *m) for m in combinations(range(1, 6), 3)], 1: [(0, *m) for m in combinations(range(1, 5), 2)]}
#: Share of an item's words, and their number, that must stand at their places.
SHARE, LEAST = 0.6, 5
#: Words in a row that are a leak whatever the item's length.
RUN = 13
#: Alignments shifted by SHIFT words at most complete each other, if each has LEAST standing words within NEAR places.
SHIFT, NEAR = 8, 8
#: Words compared at once.
CELLS = 1 << 21
_FACTORS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

MATCHES = "doc_id long, key long, item long, item_words long, matched_words long, first_word long"
#: Leaking documents whose keys are broadcast at most, when documents are filtered; bytes of alignments, likewise.
BROADCAST_KEYS, BROADCAST_BYTES = 500_000, 64 << 20

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def bare(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of the words without punctuation around them."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(int((end - start).max(initial=0))):
        tail = (end > start) & _PUNCT[words.data[np.maximum(end - 1, 0)]]
        head = (end > start) & _PUNCT[words.data[np.minimum(start, len(words.data) - 1)]] & ~tail
        if not (tail.any() or head.any()):
            break
        end[tail] -= 1
        start[head] += 1
    keep = end > start
    return words.span_hash(start[keep], end[keep]), words.text[keep]


def seeds(h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each mask the least length of the items it serves, the place of its last word, and its hash at each place
    where it fits into h; hashes of different masks differ."""
    product = [h * f for f in _FACTORS]
    for k, (least, mask) in enumerate((least, mask) for least, masks in MASKS.items() for mask in masks):
        n = max(len(h) - mask[-1], 0)
        out = product[0][:n] + np.uint64((k + 1) * 0xA0761D6478BD642F % (1 << 64))
        for j, x in zip(mask[1:], product[1:]):
            out += x[j : j + n]
        yield least, mask[-1], out


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, words: the word hashes of texts."""
    for batch in batches:
        for i, j, data, offsets in text_runs(batch):
            h, text = bare(Words(data, offsets))
            first = np.searchsorted(text, np.arange(j - i + 1))
            yield pa.record_batch({"item": batch.column(0).slice(i, j - i), "words": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))})


def _seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seed, item, place of the items' words."""
    for batch in batches:
        size = batch.column(1).value_lengths().to_numpy().astype(np.int64)
        h, own, names = batch.column(1).flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(size)), size), batch.column(0).to_numpy()
        place = np.arange(len(h)) - (np.cumsum(size) - size)[own]
        length = size[own]
        for least, last, s in seeds(h):
            serves = (length >= LONG) if least == LONG else (length < LONG) & (length >= LEAST)
            at = np.flatnonzero(((place + last < length) & serves)[: len(s)])
            if len(at):
                yield pa.record_batch({"seed": s[at].view(np.int64), "item": names[own[at]], "place": place[at].astype(np.int32)})


def _hits(known):
    """key, seed, at: where windows of the texts may meet an item's seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, j, data, offsets in text_runs(batch):
                h, text = bare(Words(data, offsets))
                first = np.searchsorted(text, np.arange(j - i + 1))
                for _, last, s in seeds(h):
                    p = np.flatnonzero(passes(bits, s))
                    p = p[text[p] == text[p + last]]
                    if len(p):
                        yield pa.record_batch({"key": keys[i + text[p]], "seed": s[p].view(np.int64), "at": (p - first[text[p]]).astype(np.int32)})

    return run


class Items:
    """Some items' words, one after the other, and how they compare with the words h of texts that begin at first."""

    def __init__(self, h: np.ndarray, size: np.ndarray):
        self.h, self.size = h, size
        self.first = np.concatenate([[0], np.cumsum(size)])

    def compared(self, h: np.ndarray, first: np.ndarray, t: np.ndarray, item: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each alignment 2 where it tells a leak, 1 where it may complete others, 0 otherwise; and the words that stand."""
        told, standing = np.zeros(len(t), np.int8), np.zeros(len(t), np.int64)
        order, i = np.argsort(self.size[item], kind="stable"), 0
        while i < len(order):
            # as many of like length as fit into CELLS
            j = min(len(order), i + max(1, CELLS // int(self.size[item[order[i]]])))
            j = min(j, i + max(1, CELLS // int(self.size[item[order[j - 1]]])))
            some, i = order[i:j], j
            same = self.same(h, first, t[some], item[some], begin[some])
            n = same.sum(1)
            total = np.zeros((len(some), same.shape[1] + NEAR + 1), np.int16 if same.shape[1] < 30_000 else np.int64)
            np.cumsum(same, 1, out=total[:, 1 : same.shape[1] + 1], dtype=total.dtype)
            total[:, same.shape[1] + 1 :] = total[:, same.shape[1], None]
            near = (total[:, NEAR:] - total[:, :-NEAR]).max(1) >= LEAST
            leak = n >= np.maximum(LEAST, SHARE * self.size[item[some]])
            if same.shape[1] >= RUN:
                leak |= (total[:, RUN:] - total[:, :-RUN]).max(1) >= RUN
            told[some], standing[some] = np.where(leak, 2, near), n
        return told, standing

    def same(self, h: np.ndarray, first: np.ndarray, t: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether each word of the items stands at its place in the alignments."""
        j = np.arange(int(self.size[item].max(initial=1)))
        at = begin[:, None] + j
        inside = (j < self.size[item][:, None]) & (at >= first[t][:, None]) & (at < first[t + 1][:, None])
        return inside & (h[np.clip(at, 0, len(h) - 1)] == self.h[np.minimum(self.first[item][:, None] + j, len(self.h) - 1)])

    def matches(self, h: np.ndarray, first: np.ndarray, t: np.ndarray, item: np.ndarray, begin: np.ndarray) -> dict[int, tuple[int, int]]:
        """item to (words matched, first word in its text), the best of its alignments first."""
        told, standing = self.compared(h, first, t, item, begin)
        good = np.flatnonzero(told)
        spots: dict[int, list[tuple[int, np.ndarray]]] = {}
        best: dict[int, tuple[int, int]] = {}
        for k, start, text, leak in sorted(zip(item[good].tolist(), begin[good].tolist(), t[good].tolist(), told[good].tolist())):
            own = self.same(h, first, np.array([text]), np.array([k]), np.array([start]))[0]
            # alignments shifted by a few words (insertions, deletions) complete each other
            near = [s for b, s in spots.get(k, []) if abs(b - start) <= SHIFT]
            spots.setdefault(k, []).append((start, own))
            n = int(np.logical_or.reduce([own, *near]).sum())
            if (leak == 2 or n >= max(LEAST, SHARE * len(own))) and n > best.get(k, (0, 0))[0]:
                best[k] = (n, max(start - int(first[text]), 0))
        return best


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, item, item_words, matched_words, first_word, from rows of doc_id, key, text, found."""
    for batch in batches:
        out = []
        for i, j, data, offsets in text_runs(batch):
            h, text = bare(Words(data, offsets))
            first = np.searchsorted(text, np.arange(j - i + 1))
            found = batch.column(3).slice(i, j - i)
            row = np.repeat(np.arange(j - i), found.value_lengths().to_numpy())
            names, words, begins = found.flatten().flatten()
            items = Items(words.flatten().to_numpy().view(np.uint64), words.value_lengths().to_numpy().astype(np.int64))
            item = np.repeat(np.arange(len(names)), begins.value_lengths().to_numpy())
            begin = begins.flatten().to_numpy().astype(np.int64) + first[row[item]]
            for k, (n, at) in items.matches(h, first, row[item], item, begin).items():
                r = i + int(row[k])
                out.append((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), names[k].as_py(), int(items.size[k]), n, at))
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in MATCHES.split(", ")])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and benchmark item it holds: doc_id, item_id, item_words, matched_words,
    first_word (the place in the document, in words, where the overlap begins)."""
    return _leaks(docs, benchmark).drop("key")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same with key, a hash of the document's text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.lower(F.col("text").cast("string")).alias("text"))
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    named = named.withColumn("item", F.xxhash64("text"))
    items = written(named.select("item", "text").dropDuplicates(["item"]).mapInArrow(_words_of, "item long, words array<long>"), "items")
    known = written(items.mapInArrow(_seeds_of, "seed long, item long, place int"), "seeds")
    bits = spark.sparkContext.broadcast(sieve(known.select(F.col("seed").alias("key"))))

    hits = rows.select("key", "text").mapInArrow(_hits(bits), "key long, seed long, at int").distinct()
    lines = hits.join(known, "seed").groupBy("key", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("begins"))
    found = lines.join(items, "item").groupBy("key").agg(F.collect_list(F.struct("item", "words", "begins")).alias("found"))
    found = written(found, "alignments")
    size = found.agg(F.sum(F.aggregate("found", F.lit(64), lambda n, x: n + 8 * F.size(x["words"]) + 4 * F.size(x["begins"]) + 48))).first()[0] or 0
    texts = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "key").select("doc_id", "key", "text", "found")
    matches = texts.mapInArrow(_verified, MATCHES)
    return matches.join(named.select("item_id", "item"), "item").select("doc_id", "item_id", "item_words", "matched_words", "first_word", "key")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns as in docs. Rows go by id and text, so of rows that
    share an id, or have none, only those go that hold an item."""
    found = written(_leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "leaks")
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["_key"])
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, same, "left_anti")

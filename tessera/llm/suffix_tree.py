"""Probabilistic suffix tree over words, learnt and applied in Spark.

States are contexts of up to DEPTH words, counted from the texts for each depth. A context is a candidate where it
occurs LEAST_COUNT times at least, whether or not its shorter ones are states; it is retained where its next-symbol
distribution diverges enough from what the tree without it would say there (its longest retained suffix). A retained
state keeps the symbols that follow it LEAST_NEXT times at least, and leaves the rest of its mass, and a smoothing mass,
to its suffix; the root is the smoothed unigram distribution over all words. So each state's distribution sums to one,
and scoring uses the longest retained suffix of what precedes a token. All least counts are absolute: the tree grows
with the corpus.

Neither the vocabulary nor the tree is ever on one machine: documents are written once with their block, and each block
asks for the counts of its own words and for the states and symbols of its own contexts. Keys are dealt out by their
first bits, in buckets of bounded size. What a block asks of a bucket is one row of sorted keys, and the answer is the
values alone, in the order of the keys, which the block finds again in its texts. Pairs to be counted also go to their
bucket by the row of many. What goes to all tasks is sieves of bounded size; they only spare the shuffle keys that count
for nothing, and where they are too full to, no result changes.

A sequence of words has one hash of 64 bits, made from those of its words without the last and without the first; so a
context followed by a symbol has the hash of the longer context that it may be.

Defined results: a null text is empty, so its end token alone is scored; a null doc_id is trained on and not held out;
repeated rows count and are scored each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import dropped
from .shared import SIEVE_BITS, SIEVE_SPARE, Words, mix, passes, text_runs, written

BLOCK_ROWS = 8192
DEPTH = 3
#: Occurrences from which a context is a candidate, and from which a symbol after it is kept.
LEAST_COUNT, LEAST_NEXT = 8, 2
#: Gain over the suffix, in nats for each occurrence and in all, from which a context is retained.
LEAST_GAIN, LEAST_TOTAL_GAIN = 0.01, 12.0
#: Pairs that a task gathers before it counts them.
GATHERED = 1_500_000
#: Documents that are shuffled as one.
TEXTS = 64
#: Keys of a bucket, about; and the type of its values: counts of words, what states leave, shares of symbols.
BUCKET_KEYS = 1 << 19
VALUES = ("<f8", "<f4", "<f4")
#: Parts of a sieve that are made apart, as a power of two.
SIEVE_PARTS = 6
END, START = np.uint64(0x7F4A7C15F39CC060), np.uint64(0x2545F4914F6CDD1D)
_LINK = np.uint64(0xA0761D6478BD642F)

ASKS, TEXT_ROWS = "bucket long, block long, kind int, data binary", "block long, kind int, bucket long, answer binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words and one end for each text: hashes, and where each text's begin."""
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    h = np.full(len(words.hash) + n, END, np.uint64)
    h[np.arange(len(words.hash)) + words.text] = words.hash
    return h, first


def joined(without_last: np.ndarray, without_first: np.ndarray) -> np.ndarray:
    """The hash of a sequence of two words or more, by those of its words without the last and without the first."""
    return mix(without_last * _LINK + without_first)


def contexts(h: np.ndarray, first: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth from 1 the tokens that have a context of so many words, a text's start being one; the hashes of
    these contexts, and of the sequences of so many words that end with the tokens."""
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    before, here = np.where(place == 0, START, np.concatenate([[START], h[:-1]])), h
    for d in range(1, depth + 1):
        at = np.flatnonzero(place >= d - 1)
        yield at, before[at], here[at]
        here = joined(before, here)
        before = np.concatenate([[START], here[:-1]])


def found_at(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Index of each wanted value in sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(want), -1)
    # values in order are found several times faster, as they meet keys that are near each other
    order, at = np.argsort(want), np.empty(len(want), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, want[order]), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


def _starts(changed: np.ndarray) -> np.ndarray:
    """Where runs begin, by whether each value but the first differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], changed]))


def _unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[_starts(values[1:] != values[:-1])] if len(values) else values


def _add(some: list[np.ndarray], values: np.ndarray) -> None:
    """Adds values to those gathered, of which each is kept once when they become many."""
    some.append(values)
    if sum(map(len, some[1:])) > GATHERED:
        some[:] = [_unique(np.concatenate(some))]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes: of each column all first bytes, all second ones and so on, compressed."""
    data = b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw, out, at = pa.decompress(data[8:], size, codec="zstd", asbytes=True), [], 0
    n = size // sum(np.dtype(t).itemsize for t in types)
    for t in map(np.dtype, types):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Keys as their differences, which in sorted ones are small, so that packed removes their high bytes; summed they
    are the keys again, sorted or not."""
    return np.diff(keys, prepend=np.uint64(0))


def unsteps(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)


def _buckets(keys: int) -> int:
    """Bits that number the buckets of so many keys."""
    return max(3, (keys // BUCKET_KEYS).bit_length())


def _dealt(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """bucket, first, last (exclusive) of sorted keys."""
    if len(keys):
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        at = _starts(bucket[1:] != bucket[:-1])
        yield from zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)])


def _plain(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy().view(np.uint64)


def _of_facts(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([unsteps(unpacked(x, "<u8", VALUES[2])[0]) for x in batch.column(0).to_pylist()])


def _sieve(keys: DataFrame, count: int | None = None, read: Callable[[pa.RecordBatch], np.ndarray] = _plain) -> np.ndarray:
    """shared.sieve, whose spots are shuffled by the row of many; of count keys, as read finds them in the one column."""
    bits = min(SIEVE_BITS, max(10, int(keys.count() if count is None else count).bit_length() + SIEVE_SPARE))
    part = bits - SIEVE_PARTS

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = _unique(np.concatenate(some))
            some.clear()
            of = found >> np.uint64(part)
            at = _starts(of[1:] != of[:-1])
            rows = [packed(steps(x)) for x in np.split(found, at[1:])]
            return pa.record_batch({"part": of[at].astype(np.int64), "spots": pa.array(rows, pa.binary())})

        some: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                key = read(batch)
                some += [key & np.uint64((1 << bits) - 1), key >> np.uint64(32) & np.uint64((1 << bits) - 1)]
            if sum(map(len, some)) > GATHERED:
                yield out()
        if some:
            yield out()

    def merged(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << part, np.uint8)
        for x in table.column("spots").to_pylist():
            marks[unsteps(unpacked(x, "<u8")[0]) & np.uint64((1 << part) - 1)] = 1
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    found = keys.mapInArrow(spots, "part long, spots binary").groupBy("part").applyInArrow(merged, "part long, bits binary").toArrow()
    out = np.zeros((1 << SIEVE_PARTS, 1 << part - 3), np.uint8)
    for k, x in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
        out[k] = np.frombuffer(x, np.uint8)
    return out.ravel().view(np.uint64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, kind (3), bucket, answer: some documents of a block as a compressed Arrow stream, so that later steps read
    and shuffle few rows."""
    for batch in batches:
        for block, rows in _by_block(batch):
            for at in range(0, rows.num_rows, TEXTS):
                some, sink = rows.slice(at, TEXTS).select([1, 2, 3]), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(some)
                yield pa.record_batch({"block": np.array([block]), "kind": np.array([3], np.int32), "bucket": np.array([0]), "answer": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _opened(batches: Iterator[pa.RecordBatch], train: bool = False) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks and documents of what _texts gave, block and answer; those to learn from, or all."""
    for batch in batches:
        for block, answer in zip(batch.column(0).to_pylist(), batch.column(1)):
            for some in pa.ipc.open_stream(answer.as_buffer()):
                yield block, some.filter(pa.compute.invert(some.column(1))) if train else some


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one block, which is the first column."""
    block = batch.column(0).to_numpy()
    if len(block):
        at = _starts(block[1:] != block[:-1]).tolist()
        for lo, hi in zip(at, [*at[1:], len(block)]):
            yield int(block[lo]), batch.slice(lo, hi - lo)


def _count_words(bits: int):
    """bucket, words: some training texts' words, or end, and how often they hold each."""

    def counted(some: list[np.ndarray]) -> pa.RecordBatch:
        words = np.sort(np.concatenate(some))
        some.clear()
        at = _starts(words[1:] != words[:-1])
        words, n = words[at], np.diff(np.append(at, len(words))).astype(np.uint32)
        rows = [(b, packed(steps(words[i:j]), n[i:j])) for b, i, j in _dealt(words, bits)]
        return pa.record_batch({"bucket": np.array([b for b, _ in rows], np.int64), "words": pa.array([x for _, x in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[np.ndarray] = []
        for _, texts in _opened(batches, train=True):
            some += [tokens_of(Words(data, offsets))[0] for _, _, data, offsets in text_runs(texts)]
            if sum(map(len, some)) >= GATHERED:
                yield counted(some)
        if some:
            yield counted(some)

    return run


def _sum_words(table: pa.Table) -> pa.Table:
    """word, cw: a bucket's words with their counts."""
    words, n = (np.concatenate(x) for x in zip(*((unsteps(w), n) for w, n in (unpacked(x, "<u8", "<u4") for x in table.column("words").to_pylist()))))
    order = np.argsort(words)
    words, n = words[order], n[order]
    at = _starts(words[1:] != words[:-1])
    return pa.table({"word": words[at].view(np.int64), "cw": np.add.reduceat(n.astype(np.int64), at)})


@dataclass
class States:
    """What a block asks for, by the hash of a context or of a context with its symbol, sorted: what the state leaves to
    its suffix, and the symbol's share in its state; not a number where there is no such state, or symbol."""

    keys: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def apply(self, context: np.ndarray, both: np.ndarray, p: np.ndarray) -> np.ndarray:
        """p after the states of these contexts; both are the hashes of the contexts with their symbols."""
        s = found_at(self.keys, context)
        left = np.where(s >= 0, self.left[s], np.nan) if len(self.keys) else np.full(len(context), np.nan)
        known = np.flatnonzero(~np.isnan(left))
        if not len(known):
            return p
        w = found_at(self.keys, both[known])
        share = np.where(w >= 0, self.share[w], np.nan)
        p = p.copy()
        p[known] = np.nan_to_num(share) + left[known] * p[known]
        return p


@dataclass
class Tree:
    tokens: int
    vocabulary: int

    def root(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))


def _count_next(candidates, shorter, depth: int, bits: int):
    """bucket, pairs: context, low (the sequence without the context's first word) and n over contexts that pass
    candidates where low passes shorter, as bytes of these columns."""

    def counted(some: list) -> pa.RecordBatch:
        context, low = (np.concatenate(x) for x in zip(*some))
        some.clear()
        key = joined(context, low)
        order = np.argsort(key)
        key, context, low = key[order], context[order], low[order]
        at = _starts((low[1:] != low[:-1]) | (context[1:] != context[:-1]))
        n = np.diff(np.append(at, len(low))).astype(np.uint32)
        key, context, low = key[at], context[at], low[at]
        bucket, pairs = [], []
        for b, i, j in _dealt(key, bits):
            bucket.append(b)
            pairs.append(context[i:j].tobytes() + low[i:j].tobytes() + n[i:j].tobytes())
        return pa.record_batch({"bucket": np.array(bucket, np.int64), "pairs": pa.array(pairs, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, known = candidates.value, shorter.value
        some, size = [], 0
        for _, texts in _opened(batches, train=True):
            for _, _, data, offsets in text_runs(texts):
                *_, (_, context, low) = contexts(*tokens_of(Words(data, offsets)), depth)
                mine = np.flatnonzero(passes(want, context))
                mine = mine[passes(known, low[mine])]
                if len(mine):
                    some.append((context[mine], low[mine]))
                    size += len(mine)
                if size >= GATHERED:
                    yield counted(some)
                    size = 0
        if some:
            yield counted(some)

    return run


def _sum_pairs(table: pa.Table) -> pa.Table:
    """context, low, n: a bucket's pairs that occur often enough."""
    parts = []
    for x in table.column("pairs").to_pylist():
        m = len(x) // 20
        parts.append((np.frombuffer(x, np.uint64, m), np.frombuffer(x, np.uint64, m, 8 * m), np.frombuffer(x, np.uint32, m, 16 * m)))
    context, low, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(joined(context, low))
    context, low, n = context[order], low[order], n[order]
    at = _starts((low[1:] != low[:-1]) | (context[1:] != context[:-1]))
    n = np.add.reduceat(n.astype(np.int64), at)
    kept = n >= LEAST_NEXT
    return pa.table({"context": context[at][kept].view(np.int64), "low": low[at][kept].view(np.int64), "n": n[kept]})


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of context and symbol in place of context and low; the other columns stay."""
    for batch in batches:
        context, low = (batch.column(k).to_numpy().view(np.uint64) for k in range(2))
        yield pa.record_batch([pa.array(joined(context, low).view(np.int64)), *batch.columns[2:]], names=["key", *batch.schema.names[2:]])


def held(doc_id: Column, part: int, of: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == part, F.lit(False))


def _settled(df: DataFrame, name: str) -> DataFrame:
    """written, after which the shuffle files of what was written go at once: they need no room beside later ones'."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def _grow(tree: Tree, texts: DataFrame, heads: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, int]:
    """The retained states, key and value: what each leaves to its suffix; and, as _facts gives them, their symbols by the
    hash of context and symbol: the share of each; and how many these are. heads(word, cw): the words with their counts."""
    spark = texts.sparkSession
    send = spark.sparkContext.broadcast
    end, start = int(END.view(np.int64)), int(START.view(np.int64))
    bits = _buckets(tree.tokens)
    # as many texts start as end
    seen = heads.where(F.col("cw") >= LEAST_COUNT).selectExpr(f"IF(word = {end}L, {start}L, word) AS context", "cw AS c")
    lower = heads.where(F.col("cw") >= LEAST_NEXT).selectExpr("word AS low", f"(cw + 0.5D) / {tree.tokens + 0.5 * (tree.vocabulary + 1)}D AS q")
    states, symbols = (spark.createDataFrame([], kind) for kind in ("key long, value float", ASKS))
    old, n_symbols = None, 0
    for d in range(1, depth + 1):
        sieves = send(_sieve(seen.selectExpr("context AS key"))), send(_sieve(lower.selectExpr("low AS key")))
        counts = texts.select("block", "answer").mapInArrow(_count_next(*sieves, d, bits), "bucket long, pairs binary")
        kept = counts.groupBy("bucket").applyInArrow(_sum_pairs, "context long, low long, n long")
        # what the tree without the state says of each symbol; low's own context is a candidate as well, and has all these
        base = _settled(kept.join(lower, "low").select("context", "low", "n", "q"), "symbols")
        for x in sieves:
            x.destroy()
        told = base.groupBy("context").agg(F.sum("n").alias("inside"), F.count("*").alias("kinds"), F.sum("q").alias("share"), F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("gain")).join(seen, "context")
        rest = F.col("c") - F.col("inside")
        gain = F.col("gain") - F.col("inside") * F.log("c") + F.when(rest > 0, rest * F.log(rest / F.col("c") / F.greatest(1 - F.col("share"), F.lit(1e-12)))).otherwise(0.0)
        good = told.where((gain >= LEAST_TOTAL_GAIN) & (gain >= LEAST_GAIN * F.col("c")))
        good = _settled(good.selectExpr("context", "c + 1 + 0.5D * kinds AS total", "(c - inside + 1 + 0.5D * kinds) / (c + 1 + 0.5D * kinds) AS left"), "retained")
        level = base.join(good, "context", "left").selectExpr("context", "low", "n", "coalesce(n / total + left * q, q) AS q", "CAST(n / total AS float) AS share")
        if d == depth:
            level = level.where("share IS NOT NULL")
        level = _settled(level.mapInArrow(_keyed, "key long, n long, q double, share float"), "level")
        for x in (base, old) if old else (base,):
            dropped(x)
        old = level
        states = states.unionByName(good.selectExpr("context AS key", "CAST(left AS float) AS value"))
        n_symbols += level.where("share IS NOT NULL").count()
        symbols = symbols.unionByName(_settled(level.where("share IS NOT NULL").select("key", "share").mapInArrow(_facts(2, bits), ASKS), "shares"))
        seen = level.where(F.col("n") >= LEAST_COUNT).selectExpr("key AS context", "n AS c")
        lower = level.selectExpr("key AS low", "q")
    if old:
        dropped(old)
    return states, symbols, n_symbols


class Asked:
    """What texts ask for, of each kind: their words, the contexts that may be states, these with their next tokens that
    may be symbols."""

    def __init__(self, sieves: tuple[np.ndarray, np.ndarray], depth: int):
        self.sieves, self.depth, self.some = sieves, depth, [[], [], []]

    def add(self, h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each depth, which of the tokens that have a context may have a state, as bits."""
        kinds, bits = ([h], [], []), []
        for _, context, low in contexts(h, first, self.depth):
            some = passes(self.sieves[0], context)
            bits.append(np.packbits(some))
            some = np.flatnonzero(some)
            context, both = context[some], joined(context[some], low[some])
            kinds[1].append(context)
            kinds[2].append(both[passes(self.sieves[1], both)])
        for some, new in zip(self.some, kinds):
            _add(some, _unique(np.concatenate(new)))
        return bits

    def keys(self) -> Iterator[np.ndarray]:
        """Of each kind what was asked for, once and sorted, and no longer kept here."""
        for some in self.some:
            new = _unique(np.concatenate([np.zeros(0, np.uint64), *some]))
            some.clear()
            yield new


def _ask(sieves, depth: int, bits: int):
    """bucket, block, kind, data: what the texts of a block that a task has ask of a bucket, as sorted keys."""

    def out(block: int, asked: Asked) -> Iterator[pa.RecordBatch]:
        for kind, keys in enumerate(asked.keys()):
            rows = [(b, packed(steps(keys[i:j]))) for b, i, j in _dealt(keys, bits)]
            yield pa.record_batch({"bucket": np.array([b for b, _ in rows], np.int64), "block": np.full(len(rows), block, np.int64), "kind": np.full(len(rows), kind, np.int32), "data": pa.array([x for _, x in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = None, None
        for b, texts in _opened(batches):
            if b != block:
                if asked:
                    yield from out(block, asked)
                block, asked = b, Asked(sieves.value, depth)
            for _, _, data, offsets in text_runs(texts):
                asked.add(*tokens_of(Words(data, offsets)))
        if asked:
            yield from out(block, asked)

    return run


def _facts(kind: int, bits: int):
    """bucket, block (-1), kind, data: keys and values of a kind, as sorted keys and bytes of values."""

    def out(some: list) -> pa.RecordBatch:
        keys, values = (np.concatenate(x) for x in zip(*some))
        some.clear()
        order = np.argsort(keys)
        keys, values = keys[order], values[order].astype(VALUES[kind])
        rows = [(b, packed(steps(keys[i:j]), values[i:j])) for b, i, j in _dealt(keys, bits)]
        return pa.record_batch({"bucket": np.array([b for b, _ in rows], np.int64), "block": np.full(len(rows), -1, np.int64), "kind": np.full(len(rows), kind, np.int32), "data": pa.array([x for _, x in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for batch in batches:
            some.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in some) >= GATHERED:
                yield out(some)
        if some:
            yield out(some)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """block, kind, bucket, answer: of all keys that a block asks of this bucket, each once and sorted, the values; not a
    number where there is none."""
    block, kind = (table.column(k).to_numpy() for k in ("block", "kind"))
    data, order = table.column("data"), np.lexsort((block, kind))
    at = _starts((np.diff(block[order]) != 0) | (np.diff(kind[order]) != 0))
    out, known = [], {}
    for rows in np.split(order, at[1:]):
        b, k = int(block[rows[0]]), int(kind[rows[0]])
        some = [data[int(r)].as_py() for r in rows]
        if b < 0:
            keys, values = (np.concatenate(x) for x in zip(*((unsteps(d), v) for d, v in (unpacked(x, "<u8", VALUES[k]) for x in some))))
            by = np.argsort(keys)
            known[k] = keys[by], values[by]
            continue
        keys = _unique(np.concatenate([unsteps(unpacked(x, "<u8")[0]) for x in some]))
        values = np.full(len(keys), np.nan, VALUES[k])
        if k in known:
            found = found_at(known[k][0], keys)
            values[found >= 0] = known[k][1][found[found >= 0]]
        out.append((b, k, packed(values)))
    bucket = table.column("bucket")[0].as_py() if len(table) else 0
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int64()), "answer": pa.array([x[2] for x in out], pa.binary())})


def _score_block(model: Tree, asked: Asked, answers: list[list[np.ndarray]], runs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The scores of a block's texts by what it was answered, the kinds each in the order of its keys. runs: ids, whether
    held out, tokens, where each text's begin, and which may have states."""
    keys, values = list(asked.keys()), [np.concatenate([np.zeros(0, v), *x]) for x, v in zip(answers, VALUES)]
    if [len(k) for k in keys] != [len(v) for v in values]:
        raise RuntimeError("a block was not answered what it asked for")
    # words that no training document has are counted 0 times
    counts, both = np.nan_to_num(values[0]), np.union1d(keys[1], keys[2])
    left, share = (np.full(len(both), np.nan, np.float32) for _ in range(2))
    left[np.searchsorted(both, keys[1])], share[np.searchsorted(both, keys[2])] = values[1], values[2]
    states = States(both, left, share)
    for doc_id, held_out, h, first, bits in runs:
        c = counts[found_at(keys[0], h)]
        base = model.root(c)
        p = base.copy()
        for (at, context, low), some in zip(contexts(h, first, asked.depth), bits):
            some = np.flatnonzero(np.unpackbits(some, count=len(at)))
            at, context = at[some], context[some]
            p[at] = states.apply(context, joined(context, low[some]), p[at])
        total_of = lambda x: np.add.reduceat(x, first[:-1])
        yield pa.record_batch({
            "doc_id": doc_id, "held_out": held_out, "n_tokens": np.diff(first).astype(np.int64), "n_known": total_of((c > 0).astype(np.int64)),
            "train_tokens": np.full(len(doc_id), model.tokens), "base_score": total_of(np.log10(base)), "score": total_of(np.log10(p)),
        })


def _score(tree, sieves, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: (Asked(sieves.value, depth), [[], [], []], [])
        block, (asked, answers, runs) = None, fresh()
        for batch in batches:
            for b, rows in _by_block(batch):
                if b != block:
                    yield from _score_block(tree.value, asked, answers, runs)
                    block, (asked, answers, runs) = b, fresh()
                for kind, x in zip(rows.column(1).to_pylist(), rows.column(3)):
                    if kind < 3:
                        answers[kind].append(unpacked(x.as_py(), VALUES[kind])[0])
                        continue
                    for part in pa.ipc.open_stream(x.as_buffer()):
                        for i, j, data, offsets in text_runs(part):
                            h, first = tokens_of(Words(data, offsets))
                            runs.append((part.column(0).slice(i, j - i), part.column(1).slice(i, j - i), h, first, asked.add(h, first)))
        yield from _score_block(tree.value, asked, answers, runs)

    return run


def scored(docs: DataFrame, part: int = 1, of: int = 5, depth: int = DEPTH) -> DataFrame:
    """Learns from the documents whose crc32 of doc_id modulo of is not part, and scores all: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score."""
    send = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.floor(F.monotonically_increasing_id() / BLOCK_ROWS).alias("block"), held(F.col("doc_id"), part, of).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # written, so a row keeps its block, whatever order its input comes in
    texts = written(rows.select("block", "doc_id", "held_out", "text").mapInArrow(_texts, TEXT_ROWS), "rows", **{"parquet.page.size.row.check.min": "10"})
    heads = _settled(texts.select("block", "answer").mapInArrow(_count_words(_buckets(texts.count() * TEXTS * 64)), "bucket long, words binary").groupBy("bucket").applyInArrow(_sum_words, "word long, cw long"), "vocabulary")
    size = heads.agg(F.sum("cw").alias("n"), F.count("*").alias("v")).first()
    tree = Tree(size.n or 0, size.v or 0)
    states, symbols, n_symbols = _grow(tree, texts, heads, depth)
    sieves = send((_sieve(states.select("key")), _sieve(symbols.select("data"), n_symbols, _of_facts)))
    bits = _buckets(tree.tokens)
    asked = texts.select("block", "answer").mapInArrow(_ask(sieves, depth, bits), ASKS).unionByName(symbols)
    for kind, facts in enumerate((heads, states)):
        asked = asked.unionByName(facts.mapInArrow(_facts(kind, bits), ASKS))
    # written, so that what was asked, and the tree, are gone before texts and answers meet
    answers = _settled(asked.groupBy("bucket").applyInArrow(_answers, TEXT_ROWS), "answers")
    for x in (heads, states, symbols):
        dropped(x)
    lined = answers.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind", "bucket")
    return lined.mapInArrow(_score(send(tree), sieves, depth), SCORES)

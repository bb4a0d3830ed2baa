"""Toxicity after noisy-channel deobfuscation.

A character trigram model, and how often each short piece stands alone, are counted over all texts. Words with digits
or symbols where letters belong or with letters in long runs, and runs of short pieces that seldom stand alone, are
decoded, and so are words with unseen characters, full-width letters or letters of two alphabets and words that begin
with a mark for a letter: each character opens the letters it may stand for in a lattice, separators and blanks may vanish, blanks may
also begin a new word, and runs may shorten; Viterbi search over all states, in one pass however long the word, takes
the likeliest letters under the character model. The restored words then feed a logistic model over words and word
beginnings, learnt from a bounded sample of labelled documents.

Defined results: null and empty texts have no words and get the model's score of an empty document; repeated rows are
scored each on its own; labels that are null are not learnt from; without any label every score is 0; an empty table
gives no rows. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, text_runs, written
from .suffix_tree import held

#: The labelled documents learnt from, at most: those with the least hash of the id.
SAMPLE = 8000
#: Labelled documents that must hold a feature of the logistic model at least, and its likelihood ratio (twice the log).
LEAST_DOCS, LEAST_RATIO = 4, 9.0
PREFIXES = range(3, 9)
THRESHOLD = 0.3
CACHE_WORDS, CACHE_CHARS = 1 << 18, 40
#: Letters of a short piece at most; share of all words below which one seldom stands alone; how many such pieces in a run
#: of short pieces call for its decoding.
PIECE, SELDOM, PIECES = 3, 5e-5, 2

# The letters that a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "×": "x", "¢": "c", "§": "s", "µ": "u"}
#: Letters of other alphabets that look like one of a to z, and characters that are not seen.
ALIKE = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ı": "i"}
UNSEEN = "\u00ad\u180e\u200b\u200c\u200d\u2060\ufeff"
FILLERS = set(".-_*~'`^#%&=/\\,:;\"")
#: Costs in nats: a symbol for a letter, a separator left out, a letter of a run left out, a character as it is, a blank left
#: out, and more for each further letter of the pieces beside it and for one of them that often stands alone.
COST_LEET, COST_SKIP, COST_RUN, COST_LITERAL, COST_JOIN, COST_LONGER, COST_ALONE = 1.2, 0.5, 0.4, 6.0, 0.7, 1.0, 1.5
#: A letter of the usual width or alphabet for one that looks like it.
COST_ALIKE = 0.3

_EDGE = re.compile(r"^[^\w@$+(<€£¢§µ]+|[^\w@$+€£¢§µ]+$")
_ODD = re.compile(r"[^\W\d_][^\w\s]|[^\w\s][^\W\d_]|[^\W\d_]\d|\d[^\W\d_]|_|([^\W\d_])\1\1")
#: Full-width letters and what is not seen; letters that look alike beside letters of a to z; a mark for a first letter.
_HIDDEN = re.compile(f"[{UNSEEN}\uff10-\uff19\uff21-\uff3a\uff41-\uff5a]")
_MIXED = re.compile(f"[a-z][^\\s]*[{''.join(ALIKE)}]|[{''.join(ALIKE)}][^\\s]*[a-z]")
_MARKED = re.compile(r"^[^\w@$+(<€£¢§µ]*[!|](?=[a-z])")

#: Character classes of the model: 0 a word's edge, 1-26 letters, 27 other letters (each byte of them).
KINDS = 28
_CLASS = np.full(256, 255, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, n: trigrams of characters from 0; below, at -1 all words, and short pieces of the letters a to z from -2."""
    total, pieces = np.zeros(KINDS**3, np.int64), np.zeros(1 + 27**PIECE, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_runs(batch):
            c = _CLASS[data].astype(np.int32)
            code = (c[:-2] * KINDS + c[1:-1]) * KINDS + c[2:]
            total += np.bincount(code[(c[:-2] < KINDS) & (c[1:-1] < KINDS) & (c[2:] < KINDS)], minlength=KINDS**3)
            words = Words(data, offsets)
            pieces[0] += len(words.start)
            size = words.end - words.start
            short = np.flatnonzero(size <= PIECE)
            start, size, code, plain = words.start[short], size[short], np.zeros(len(short), np.int64), np.ones(len(short), bool)
            for k in range(PIECE):
                x = np.where(k < size, c[np.minimum(start + k, len(c) - 1)], 0)
                plain &= (x <= 26) & ((x > 0) | (k >= size))
                code = code * 27 + x
            pieces[1:] += np.bincount(code[plain], minlength=27**PIECE)
    at, short = np.flatnonzero(total), np.flatnonzero(pieces)
    yield pa.record_batch({"code": np.concatenate([at, -1 - short]).astype(np.int32), "n": np.concatenate([total[at], pieces[short]])})


class Channel:
    """The character model's costs, the short pieces that stand alone often, and the decoder."""

    def __init__(self, counts: np.ndarray, alone: set[str]):
        three = counts.reshape(KINDS, KINDS, KINDS).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + KINDS)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 20 * p2) / (three.sum(2, keepdims=True) + 20)
        self.cost, self.alone = (-np.log(p3)).tolist(), alone

    def arcs(self, ch: str, before: str) -> list[tuple[str, float]]:
        """What a character after another may stand for, with its cost; "" leaves it out."""
        if ch in UNSEEN:
            return [("", 0.0)]
        if "\uff10" <= ch <= "\uff5a":
            ch = unicodedata.normalize("NFKC", ch)
        if ch.isalpha():
            out = [(ch, 0.0), (ALIKE[ch], COST_ALIKE)] if ch in ALIKE else [(ch, 0.0)]
            return [*out, ("", COST_RUN)] if ch == before else out
        out = [(x, COST_LEET) for x in LEET.get(ch, "")]
        if ch in FILLERS or ch in "!|+(<" or (ch == before and ch in LEET):
            out.append(("", COST_SKIP))
        return [*out, (ch, COST_LITERAL)]

    def join_cost(self, left: str, right: str) -> float:
        """The cost of leaving out the blank between two short pieces."""
        return COST_JOIN + COST_LONGER * (len(left) + len(right) - 2) + COST_ALONE * (left in self.alone or right in self.alone)

    def decode(self, word: str, joins: Iterator[float] = iter(())) -> str:
        """The likeliest letters of lower-cased characters, blanks included; joins has what it costs to leave each out."""
        # a state is the last two letters' kinds; its path is a chain of (path before, letters), shared between states
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for ch in word:
            if ch == " ":
                arcs = [(" ", 0.0, 0), ("", next(joins), -1)]
            else:
                arcs = [(x, more, ord(x) - 96 if "a" <= x <= "z" else 27) if x else (x, more, -1) for x, more in self.arcs(ch, before)]
            before = ch
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                row = self.cost[a][b]
                for x, more, k in arcs:
                    key, total = ((a, b), cost + more) if k < 0 else ((b, k), cost + more + row[k])
                    if key not in new or total < new[key][0]:
                        new[key] = (total, path if k < 0 else (path, x))
            states = new
        path, out = min((cost + (self.cost[a][b][0] if b else 0.0), k, path) for k, ((a, b), (cost, path)) in enumerate(states.items()))[2], []
        while path is not None:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def restore(self, token: str) -> str:
        """One blank-separated lower-cased token: as it is without its punctuation, or decoded where it looks odd."""
        core = _EDGE.sub("", token)
        if core and _MARKED.match(token):
            return self.decode(token[token.index(core) - 1] + core)
        return self.decode(core) if core and (_ODD.search(core) or core[0] in "@$+(<€£" or core[-1] in "@$+€£" or (not core.isascii() and (_HIDDEN.search(core) or _MIXED.search(core)))) else core

    def kind(self, token: str) -> int:
        """0 for a token that is no short piece of ASCII, 1 for one that often stands alone, 2 for one that seldom does, 3 for
        marks without letters or digits."""
        core = token if len(token) <= PIECE and token.isalpha() else _EDGE.sub("", token)
        return 3 if not core else 0 if len(core) > PIECE or not core.isascii() else 1 if core in self.alone or core.isdigit() else 2

    def spelled(self, tokens: list[str], kinds: dict[str, int]) -> list[str]:
        """Words restored from runs of short pieces, marks between them left out; kinds has each token's."""
        out: list[str] = []
        run: list[str] = []
        rare = 0
        for t in [*tokens, ""]:
            kind = kinds[t] if t else 0
            if kind:
                if kind < 3:
                    run.append(t)
                    rare += kind == 2
                continue
            if rare >= PIECES:
                pieces = [_EDGE.sub("", x).strip("(<+|!") or x for x in run]
                out += sorted(set(self.decode(" ".join(pieces), map(self.join_cost, pieces, pieces[1:])).split()).difference(pieces))
                # letters that stand one by one, but for words of one letter at their ends, may be one word as well
                for single in re.findall(r"(?<!\S)\S(?: \S)+(?!\S)", " ".join(pieces)):
                    letters = single.split()
                    while letters and letters[0] in self.alone:
                        letters.pop(0)
                    while letters and letters[-1] in self.alone:
                        letters.pop()
                    if len(letters) > 2:
                        out.append(self.decode("".join(letters)))
            run, rare = [], 0
        return out


def _features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if n < len(word))] if word else []


class Reader:
    """Feature sets of texts; of, if given, are the features that count, with their numbers."""

    def __init__(self, channel: Channel, of: dict[str, int] | None = None):
        self.channel, self.of, self.known, self.kinds = channel, of, {}, {}

    def _learn(self, token: str) -> tuple:
        found = _features(self.channel.restore(token))
        found = tuple(found if self.of is None else [self.of[f] for f in found if f in self.of])
        if len(token) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[token] = found
        return found

    def read(self, text: str | None) -> set:
        out: set = set()
        if text:
            tokens, kinds = text.lower().split(), {}
            get, get_kind = self.known.get, self.kinds.get
            for token in set(tokens):
                kind = get_kind(token)
                if kind is None:
                    if len(self.kinds) >= CACHE_WORDS:
                        self.kinds.clear()
                    kind = self.kinds[token] = self.channel.kind(token)
                kinds[token] = kind
                found = get(token)
                if found is None:
                    found = self._learn(token)
                if found:
                    out.update(found)
            for word in self.channel.spelled(tokens, kinds) if 2 in kinds.values() else []:
                found = _features(word)
                out.update(found if self.of is None else [self.of[f] for f in found if f in self.of])
        return out


def _tally(channel):
    """feature, pos, neg over the sample's documents of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(channel.value), (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(label > 0)].update(reader.read(text))
        names = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.record_batch({"feature": pa.array(some, pa.string()), "pos": pa.array([counts[1][f] for f in some], pa.int64()), "neg": pa.array([counts[0][f] for f in some], pa.int64())})

    return run


def _rows_of(channel, chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(channel.value, chosen)
        for batch in batches:
            got = [sorted(reader.read(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"label": batch.column(0).cast(pa.int32()), "at": pa.array(got, pa.list_(pa.int32()))})

    return run


def fit_logistic(rows: list[tuple[int, list[int]]], n: int, l2: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularised logistic model over sparse binary rows (full-batch, Adam steps)."""
    y = np.array([r[0] for r in rows], float)
    at = np.concatenate([np.array(r[1], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    w = np.zeros(n + 1)
    w[n] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(rows)) + w[n], -30, 30)))
        g = np.append(np.bincount(at, (p - y)[row], n) + l2 * w[:n], (p - y).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w[:n], float(w[n])


def _score(channel, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weight, bias = model.value
        reader = Reader(channel.value, chosen)
        for batch in batches:
            z = np.array([bias + sum(weight[k] for k in reader.read(t)) for t in batch.column(2).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    return run


def scored(docs: DataFrame, labels: DataFrame, part: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels(doc_id, toxic) are learnt from only where crc32
    of doc_id modulo of is not part."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id"), part, of).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.select("text").mapInArrow(_count_characters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts, pieces = np.zeros(KINDS**3, np.int64), {}
    for r in counted:
        if r.code >= 0:
            counts[r.code] = r.n
        else:
            pieces[-1 - r.code] = r.n
    words = pieces.pop(0, 0)
    letters = lambda code: "".join(chr(96 + k) for p in range(PIECE - 1, -1, -1) if (k := code // 27**p % 27))
    alone = {letters(code - 1) for code, n in pieces.items() if n >= SELDOM * words}
    channel = spark.sparkContext.broadcast(Channel(counts, alone))

    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held(F.col("doc_id"), part, of))
    sample = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    texts = rows.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # one text for each label, so that rows which repeat an id leave the sample's bound
    texts = written(texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text"), "sample")
    tally = texts.mapInArrow(_tally(channel), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    size = sample.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = size.n or 0, size.pos or 0
    base = (pos + 1) / (n + 2)
    # signed root of the likelihood ratio of the feature's rate against the base rate
    both = F.col("pos") + F.col("neg")
    part_of = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * q))).otherwise(0.0)
    told = tally.where(both >= LEAST_DOCS).withColumn("gain", 2 * (part_of("pos", base) + part_of("neg", 1 - base)))
    told = told.where((F.col("pos") > base * both) & (F.col("gain") > LEAST_RATIO)).orderBy("feature").collect()
    chosen = {r.feature: k for k, r in enumerate(told)}
    learnt = [(r.label, r["at"]) for r in texts.mapInArrow(_rows_of(channel, chosen), "label int, at array<int>").collect()] if n else []
    weight, bias = fit_logistic(learnt, len(chosen)) if learnt and pos else (np.zeros(len(chosen)), -40.0)
    model = spark.sparkContext.broadcast((chosen, weight.tolist(), bias))
    return rows.mapInArrow(_score(channel, model), "doc_id long, held_out boolean, score double, predicted int")

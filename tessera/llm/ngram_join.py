"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles. Two sets of sizes x <= y with Jaccard similarity t or more share so
many shingles that, in any one order of all shingles, the first x - ceil(t x) + l of the one and y - ceil(t y) + l of
the other share l at least. Shingles are ordered from rare to common, and each document takes the l for which its
estimated cost is least: longer prefixes list more postings but need more shared shingles before a verification. A
pair is verified once it shares min(l, l') shingles of the two prefixes, on the whole sets. What comes before the first
shingle that a document's prefix shares with any other prefix can be in no linked document, and the parities of a set's
hashes in 256 buckets differ in no more buckets than two sets differ in shingles; both bound a pair before it is made.

Groups of near copies are never expanded into all pairs. Equal sets are one node. Each posting list first links
neighbours only, in a few different orders; then only pairs across the components so found are looked at, and of those
only pairs with a member outside the list's largest component. So every link between different components is verified
and none is lost.

Sets are held as 64-bit hashes of the shingles, and a node's name is 64 bits of its set's signature: at n documents
about n^2 / 2^65 unrelated pairs would be expected to share a name.

Defined results: a text without words, or a null text, has size 0 and is linked with nothing; repeated rows are equal
sets, so linked; rows that share a doc_id with different texts are documents of their own; a row with a null doc_id
can link others but has itself no id to give to its component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import Words, mix, text_runs, windows, written

#: Shingles whose frequency is told to all tasks: the most frequent ones found, 12 bytes each. Only the order of the
#: others, and so only speed, depends on it.
COMMON = 1 << 18
#: A shingle is counted where this many different sets hold it at least, of those that have GATHERED shingles together;
#: so any shingle in more than a few of some thousand documents is counted, up to an error of the number of such parts.
COUNTED_FROM, GATHERED = 2, 1 << 21
MAX_MATCHES = 6
#: Cost of verifying a candidate, in posting rows read.
VERIFY_COST = 12.0
#: Different orders in which posting lists link neighbours.
ORDERS = 3
#: Document ids that are broadcast at most.
BROADCAST_IDS = 500_000


def sets_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    h, text = windows(words, k)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(words.first)))


def _signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, full = len(first) - 1, np.flatnonzero(np.diff(first))
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(full):
        a[full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first[full])
        b[full] = np.bitwise_xor.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), first[full])
    return mix(a ^ (np.diff(first).astype(np.uint64) << np.uint64(40))), b


PARITY = ("p0", "p1", "p2", "p3")


def _parities(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each text 4 words of 64 bits: the parity of its set's hashes in each of 256 buckets."""
    spot = mix(h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(56)
    bit, lane, full, out = np.uint64(1) << (spot & np.uint64(63)), spot >> np.uint64(6), np.flatnonzero(np.diff(first)), []
    for k in range(4):
        words = np.zeros(len(first) - 1, np.uint64)
        if len(full):
            words[full] = np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), first[full])
        out.append(words.view(np.int64))
    return out


#: Words of 64 bits in the wider parities that candidate pairs are held to before their sets are fetched.
WIDE = 32


def _wide_parities(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same over 64 * WIDE buckets, a row of WIDE words for each text."""
    spot = mix(h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 6 - WIDE.bit_length() + 1)
    out = np.zeros((len(first) - 1) * WIDE, np.uint64)
    lane = np.repeat(np.arange(len(first) - 1), np.diff(first)) * WIDE + (spot >> np.uint64(6)).astype(np.int64)
    order = np.argsort(lane, kind="stable")
    lane, bit = lane[order], (np.uint64(1) << (spot & np.uint64(63)))[order]
    if len(lane):
        at = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        out[lane[at]] = np.bitwise_xor.reduceat(bit, at)
    return out.view(np.int64).reshape(-1, WIDE)


def _rows_of(words: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))


def _survey(k: int):
    """Rows of kind 0, one per document: doc_id, size, two signatures; of kind 1: a shingle and how many of some
    documents hold it."""

    def counted(h: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.sort(np.concatenate(h))
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(h)))
        often = count >= COUNTED_FROM
        if often.any():
            h, count = h[at[often]], count[often]
            yield pa.record_batch({"kind": np.ones(len(h), np.int32), "doc_id": pa.nulls(len(h), pa.int64()), "key": pa.nulls(len(h), pa.int64()), "n": count.astype(np.int64), "a": h.view(np.int64), "b": np.zeros(len(h), np.int64), **{name: np.zeros(len(h), np.int64) for name in PARITY}, "wide": _rows_of(np.zeros((len(h), 0), np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size, seen = [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for i, j, data, offsets in text_runs(batch):
                h, first = sets_of(Words(data, offsets), k)
                n = np.diff(first)
                a, b = _signatures(h, first)
                yield pa.record_batch({"kind": np.zeros(len(n), np.int32), "doc_id": batch.column(0).slice(i, j - i), "key": batch.column(2).slice(i, j - i), "n": n.astype(np.int64), "a": a.view(np.int64), "b": b.view(np.int64), **dict(zip(PARITY, _parities(h, first))), "wide": _rows_of(_wide_parities(h, first))})
                # copies of a set count once
                once = np.zeros(len(a), bool)
                once[np.unique(a, return_index=True)[1]] = True
                once &= ~np.isin(a, seen)
                seen = np.union1d(seen, a)
                gathered.append(h[np.repeat(once, n)])
                size += len(gathered[-1])
                if size >= GATHERED:
                    yield from counted(gathered)
                    gathered, size, seen = [], 0, np.zeros(0, np.uint64)
        if size:
            yield from counted(gathered)

    return run


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100) in whole numbers: what a set of n must share at least with any it is linked to."""
    return -((-percent * n) // 100)


def matches_wanted(df: np.ndarray, base: int) -> int:
    """The l of least estimated cost for a document whose shingles, from rare to common, have these frequencies and
    whose prefix has base shingles for l = 1: postings read, plus candidates, each holding l of the prefix, verified."""
    best, least = 1, np.inf
    total = np.cumsum(df[: base + MAX_MATCHES - 1])
    for l in range(1, MAX_MATCHES + 1):
        if base + l - 1 > len(df):
            break
        read = float(total[base + l - 2])
        cost = read + VERIFY_COST * read / l
        if cost < least - 1e-9:
            best, least = l, cost
    return best


def _postings(k: int, percent: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = common.value
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offsets in text_runs(batch):
                h, first = sets_of(Words(data, offsets), k)
                name = _signatures(h, first)[0].view(np.int64)
                at = np.searchsorted(tokens, h) if len(tokens) else np.zeros(len(h), np.int64)
                df = np.ones(len(h))
                if len(tokens):
                    at = np.minimum(at, len(tokens) - 1)
                    hit = tokens[at] == h
                    df[hit] = counts[at[hit]]
                out: list[tuple[np.ndarray, int, int, int]] = []
                base_all = np.diff(first) - needed(np.diff(first), percent) + 1
                for d in np.flatnonzero(np.diff(first)).tolist():
                    node = int(name[d])
                    if node in seen:  # a copy in this partition
                        continue
                    seen.add(node)
                    a, b = first[d], first[d + 1]
                    w, base = df[a:b], int(base_all[d])
                    order = np.lexsort((h[a:b], w)) if w.max() > 1 else np.arange(b - a)
                    l = matches_wanted(w[order[: base + MAX_MATCHES - 1]], base)
                    out.append((h[a:b][order[: base + l - 1]], node, b - a, l))
                if out:
                    reps = np.array([len(x[0]) for x in out])
                    spread = lambda k, t: np.repeat(np.array([x[k] for x in out], t), reps)
                    yield pa.record_batch({"token": np.concatenate([x[0] for x in out]).view(np.int64), "node": spread(1, np.int64), "packed": (spread(2, np.int64) << 32) | (np.concatenate([np.arange(r) for r in reps]) << 3) | spread(3, np.int64)})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offsets in text_runs(batch):
                h, first = sets_of(Words(data, offsets), k)
                name = _signatures(h, first)[0].view(np.int64)
                new = np.array([d for d in range(j - i) if first[d + 1] > first[d] and not (int(name[d]) in seen or seen.add(int(name[d])))], np.int64)
                if len(new):
                    own = np.zeros(j - i, bool)
                    own[new] = True
                    held, ends = h[np.repeat(own, np.diff(first))].view(np.int64), np.cumsum(np.diff(first)[new])
                    yield pa.record_batch({"node": name[new], "shingles": pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(held))})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("su", "sv"))
    joined = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", both.alias("i"), (F.size("su") + F.size("sv")).alias("xy"))
    return joined.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("xy") - F.col("i"))).select("u", "v")


def _may_link(x: str, y: str, percent: int) -> str:
    """Whether sets of sizes n that share nothing before their place free can still be similar enough."""
    return f"100 * (n{x} - free{x}) >= {percent} * (n{y} + free{x}) AND 100 * (n{y} - free{y}) >= {percent} * (n{x} + free{y})"


def _in_prefixes(x: str, y: str, percent: int) -> str:
    """Whether a shared shingle, at these places of the two orders, is in the prefixes that the sizes of both ask for: what
    the smaller l of the two counts is there already. They are about half as long as those for a partner of any size."""
    least = f"({percent} * (n{x} + n{y}) + {99 + percent}) DIV {100 + percent} - least(l{x}, l{y})"
    return f"at{x} < n{x} - ({least}) AND at{y} < n{y} - ({least})"


def _across(some: DataFrame, percent: int) -> DataFrame:
    """A row for each shared shingle of two nodes of different components that may be linked. A pair that shares a great
    part of its prefixes has a row for each such shingle, so only the prefixes that the pair's own sizes ask for count."""
    left = some.where("root <> largest").selectExpr("token", "node AS x", "n AS nx", "l AS lx", "place AS atx", "free AS freex", "root AS rx", *(f"{c} AS {c}x" for c in PARITY))
    right = some.selectExpr("token", "node AS y", "n AS ny", "l AS ly", "place AS aty", "free AS freey", "root AS ry", "root = largest AS inside", *(f"{c} AS {c}y" for c in PARITY))
    apart = " + ".join(f"bit_count({c}x ^ {c}y)" for c in PARITY)
    return left.join(right, "token").where(f"rx <> ry AND (inside OR x < y) AND {_may_link('x', 'y', percent)} AND {_in_prefixes('x', 'y', percent)} AND ({apart}) * {100 + percent} <= {100 - percent} * (nx + ny)")


def _sharing(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs that share as many prefix shingles as their l's ask for, by the nodes' shared prefix shingles."""
    own = lists.groupBy("node").agg(F.collect_set("token").alias("t"), F.min("l").alias("l"), F.min("n").alias("n"), F.min("free").alias("free"))
    side = lambda c: own.select(F.col("node").alias(c), *(F.col(k).alias(f"{k}{c}") for k in ("t", "l", "n", "free")))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(_may_link("u", "v", percent))
    return both.where(F.size(F.array_intersect("tu", "tv")) >= F.least("lu", "lv")).select("u", "v")


def _close(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wider parities allow a link. wide: node, n, wide, once or more for each node."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    own = wide.join(ends, "node", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.first("wide").alias("w"))
    side = lambda c: own.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("w").alias(f"w{c}"))
    apart = F.aggregate(F.zip_with("wu", "wv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return pairs.join(side("u"), "u").join(side("v"), "v").where(apart * (100 + percent) <= F.lit(100 - percent) * (F.col("nu") + F.col("nv"))).select("u", "v")


def _sets_for(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the nodes in the pairs, written, from one text of each. The ids are broadcast where a count
    shows them to be few; otherwise the texts are joined with them."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes, "node").select("key").distinct()
    wanted = written(wanted, "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").select("text")
    sets = written(texts.mapInArrow(_sets(k), "node long, shingles array<long>"), "sets")
    # only rows that share a key can give a node twice
    repeated = sets.groupBy("node").count().where("count > 1")
    return sets if repeated.isEmpty() else written(sets.dropDuplicates(["node"]), "sets")


def _most_common(counts: DataFrame) -> DataFrame:
    """The shingles from the least frequency on that COMMON of them reach at most: a histogram of some hundred rows
    finds it, so the driver gets no more than it keeps."""
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in sizes:
        total += row.k
        if total > COMMON:
            break
        least = row.step
    return counts.where(step >= least) if least is not None else counts.where("false")


def linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (the set's name), root (of its component), component_id, for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))  # by which a text is found again
    survey = written(rows.mapInArrow(_survey(k), "kind int, doc_id long, key long, n long, a long, b long, " + ", ".join(f"{c} long" for c in PARITY) + ", wide array<long>"), "survey")
    ids = survey.where("kind = 0").select("doc_id", "key", "n", F.col("a").alias("node"), *PARITY)
    wide = survey.where("kind = 0 AND n > 0").select(F.col("a").alias("node"), "n", "wide")
    top = _most_common(written(survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")), "counts")).toPandas()
    tokens = top["a"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    common = spark.sparkContext.broadcast((tokens[order], top["n"].to_numpy(np.int32)[order]))

    nodes = ids.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *(F.min(c).alias(c) for c in PARITY))
    postings = rows.select("text").mapInArrow(_postings(k, percent, common), "token long, node long, packed long")
    over = "OVER (PARTITION BY token)"
    lists = postings.selectExpr("token", "node", "packed", f"min(node) {over} AS lo", f"max(node) {over} AS hi", f"min(packed & 7) {over} AS least_l", f"ln(count(*) {over}) AS spread")
    lists = written(lists.where("lo <> hi").drop("lo", "hi"), "lists")
    # a linked pair shares min(l, l') shingles, so each of them is in a list whose least l its members' counts reach
    each = lists.repartition("node").groupBy("node", "token").agg(F.min("packed").alias("packed"), F.min("least_l").alias("least_l"), F.min("spread").alias("spread"))
    each = each.selectExpr("token", "node", "CAST(packed >> 32 AS INT) AS n", "CAST(packed & 7 AS INT) AS l", "CAST((packed >> 3) & 536870911 AS INT) AS place", "least_l", "CAST(min((packed >> 3) & 536870911) OVER (PARTITION BY node) AS INT) AS free", "count(*) OVER (PARTITION BY node) AS listed", "sum(spread) OVER (PARTITION BY node) AS spread")
    lists = written(each.where("listed >= least_l").drop("least_l", "listed"), "lists")

    ratio = -np.log(percent / 100.0)
    lists = lists.withColumn("band", F.floor(F.log("n") / ratio))
    spot, band = f"OVER (PARTITION BY token ORDER BY band, xxhash64(node, pmod(token, {ORDERS})), node)", "OVER (PARTITION BY token, band)"
    # the hub of a list's sizes: the node whose prefix others share most, as of near copies the one with fewest changes
    mates = lists.selectExpr("node AS x", "n AS nx", "free AS freex", f"lead(struct(node, n, free)) {spot} AS next", f"IF(count(*) {band} > 2, max(struct(spread / (n - ({percent} * n + 99) DIV 100 + l) AS typical, node, n, free)) {band}, NULL) AS hub")
    mates = mates.select("x", "nx", "freex", F.explode(F.array(F.col("next"), F.struct("hub.node", "hub.n", "hub.free"))).alias("y")).selectExpr("x", "nx", "freex", "y.node AS y", "y.n AS ny", "y.free AS freey")
    near = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) AND {_may_link('x', 'y', percent)}"
    first = mates.where(f"x <> y AND {near}").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()

    first = written(_close(_sharing(first, lists, percent), wide, percent), "first")
    sets = _sets_for(first, nodes, rows, k)
    links = written(_verified(first, sets, percent), "links")
    roots = connected_components(links)

    # what lies across components: only pairs with a member outside the list's largest component
    member = written(lists.drop("band", "spread").join(roots, "node", "left").select("token", "node", "n", "l", "place", "free", F.coalesce("root", "node").alias("root")), "members")
    parts = member.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    some = written(member.join(parts.select("token", "largest"), "token").join(nodes.drop("least", "key"), "node"), "some")
    across = _across(some, percent)
    second = across.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.count("*").alias("shared"), F.min(F.least("lx", "ly")).alias("wanted")).where("shared >= wanted")
    second = written(_close(second.select("u", "v"), wide, percent), "second")
    more = _sets_for(second, nodes, rows, k)
    links = links.unionByName(_verified(second, more, percent))
    roots = written(connected_components(links), "roots")

    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(component, "root").select("node", "root", "component_id"), "named")
    return ids.join(named, (ids["node"] == named["node"]) & (ids["n"] > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), ids["node"], named["root"], F.coalesce("component_id", "doc_id").alias("component_id"))


def _held(ids: DataFrame) -> DataFrame:
    """ids, written; broadcast where a count shows them to be few, else left to a shuffle."""
    ids = written(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the document with the least id stays, once. Documents without
    words and rows without id stay; rows that share an id stay or go together, equal ones become one. Columns as in
    docs. Only ids are joined; texts are shuffled where these are too many to broadcast."""
    found = linked(docs, k, percent)
    stays = F.when(F.expr("n_shingles = 0 OR doc_id = component_id"), 1).otherwise(0)
    gone = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(stays).alias("stays")).where("stays = 0").select("doc_id")
    kept = docs.join(_held(gone), "doc_id", "left_anti")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = _held(repeated)
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)

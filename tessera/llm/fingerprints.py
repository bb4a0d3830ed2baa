"""Document fingerprints by a threshold-scaled sketch, with built-in functions only.

Of a text's distinct word shingles every hash below a fixed fraction of the hash range stays (one in SCALE on average),
whatever the text's length. Two sketches are cut at the same threshold, so the sketch of a union is the union of the
sketches (merged), and shared hashes over a side's hashes estimate how much of it the other contains, also where one
text is a thousand times the other. A text none of whose hashes is below the threshold keeps its least one; a merge
keeps it likewise, only while nothing is below the threshold.

A document's successor in the order of ids is found without a global sort: ids at percentiles, all of them ids of the
table, cut the order into ranges, and the row at a range's beginning goes into the range before it as well.

Defined results: a null text is empty; a text without words has the empty fingerprint; two empty fingerprints have a
likeness of 1, an empty and another of 0; a text of fewer words than a shingle is one shingle; rows without id come
after all others; rows that share an id follow each other in the order of their texts; a table of one row follows
itself; an empty table gives an empty one; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality_rules import let, words_of

#: Words of a shingle, and the part of all hashes that stays: one in SCALE.
WORDS, SCALE = 5, 8
#: Rows of a range of ids, and ranges at most; beyond, ranges grow.
RANGE_ROWS, RANGES = 64, 1 << 16
LAST = (1 << 63) - 1


def threshold(scale: int = SCALE) -> int:
    """The signed hash below which one hash in scale lies."""
    return -(1 << 63) + (1 << 64) // scale


def _kept(hashes: Column, scale: int) -> Column:
    """Sorted distinct hashes below the threshold, or the least one."""
    some = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(threshold(scale)))))
    return let(some, lambda s: F.when((F.size(s) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(s))


def sketch(text: Column, k: int = WORDS, scale: int = SCALE) -> Column:
    """array<long>: the sketch of the text's shingles of k words, letter case aside."""

    def hashes(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
        rows = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, whole).otherwise(rows)

    return let(let(words_of(F.lower(text)), hashes), lambda h: _kept(h, scale))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both texts' shingles together, from their sketches."""
    return let(F.array_union(a, b), lambda h: _kept(h, scale))


def contained(a: Column, b: Column) -> Column:
    """The estimated part of a's shingles that b has; an empty sketch is contained in any."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity; 1 between two empty sketches."""
    both = let(F.array_intersect(a, b), F.size)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def shown(found: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(docs: DataFrame, k: int = WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, text, sketch: each row by itself, no shuffle."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text"), k, scale))


def with_next(rows: DataFrame, carried: list[str], rows_a_range: int = RANGE_ROWS) -> DataFrame:
    """rows(doc_id, text, ...) with next, a struct of the carried columns of the row after it, the first after the last.

    One shuffle by range of ids; the ids at the ranges' beginnings, a bounded number, pass the driver."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    ids = rows.select(key.alias("k"))
    ranges = max(1, min(RANGES, ids.count() // rows_a_range))
    shares = ", ".join(f"{i / ranges:.8f}D" for i in range(1, ranges)) or "0.5D"
    found = ids.agg(F.min("k").alias("first"), F.expr(f"percentile_approx(k, array({shares}), {max(10_000, 20 * ranges)})").alias("at")).first()
    starts = [] if found is None or found["first"] is None else sorted({found["first"], *(found["at"] if ranges > 1 else ())})
    starts = starts or [0]
    # a literal that is parsed once: one expression, not one for each range
    begin = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    halves = F.array(*(F.lit(1 << b) for b in reversed(range(len(starts).bit_length()))))
    step = lambda p, h: F.when((p + h < len(starts)) & (F.get(begin, F.least(p + h, F.lit(len(starts) - 1))) <= F.col("_k")), p + h).otherwise(p)
    placed = rows.withColumn("_k", key).withColumn("_r", F.aggregate(halves, F.lit(0), step))
    guest = F.struct(F.pmod(F.col("_r") - 1, F.lit(len(starts))).alias("r"), F.lit(1).alias("guest"))
    own = F.struct(F.col("_r").alias("r"), F.lit(0).alias("guest"))
    places = F.when(F.get(begin, F.col("_r")) == F.col("_k"), F.array(own, guest)).otherwise(F.array(own))
    dealt = placed.withColumn("_p", F.explode(places)).drop("_r")
    order = Window.partitionBy("_p.r").orderBy("_p.guest", "_k", "text")
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("_p.guest = 0").drop("_k", "_p")


def edited(docs: DataFrame, k: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each document, its text with the last half of its code points replaced by as many first ones of the next
    document's, the sketches of it, of that and of the next document, and what they say of each other."""
    rows = with_next(fingerprints(docs, k, scale), ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    # explode of one element keeps the edited text and its sketch from being computed once for each use
    out = rows.select("doc_id", "text", "sketch", F.col("next.sketch").alias("next_sketch"), F.explode(F.array(changed)).alias("edited"))
    out = out.withColumn("e", F.explode(F.array(sketch(F.col("edited"), k, scale))))
    return out.select(
        "doc_id", "text", "edited", "sketch", F.col("e").alias("edited_sketch"),
        likeness(F.col("sketch"), F.col("e")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        contained(F.col("sketch"), F.col("e")).alias("kept_in_edited"), contained(F.col("sketch"), F.col("next_sketch")).alias("kept_in_next"),
    )

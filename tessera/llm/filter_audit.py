"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Each document's failures become flags; flags and part are counted together first (2 ** filters rows a part at most),
and a CUBE over the flags and the part then counts every subset of the filters at once: a grouping-set row whose
selected flags are all false holds the documents that survive that subset. A step of an order is the pair of subsets
before and after it, so two rows of the cube per step say what it kept and removed, whatever the number of documents.

Identical texts: a text's least id is aggregated by its digest, partial sums first, and met again by digest and id
together, so a text with a third of all rows is no hot key of the join.

Defined results: a null text is empty, a null part the empty string; rows without id count as after all others, so
they are copies where a row with an id has their text; rows that share id and text are no copies of each other; an id
with several labels is good (toxic) if one says so; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality_rules import let, words_of
from .shared import written

#: The filters in the order of their bits; the last one is that of identical texts.
LETTERS = "ABCDE"


def failures(docs: DataFrame, part: Column) -> DataFrame:
    """doc_id, part, digest, and the flags of the filters that one text decides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = let(words_of(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    read = docs.select(
        "doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        counted.alias("w"), (capitals.cast("long") * 100 > F.length(text).cast("long") * 5).alias("C"), text.rlike("[#$%&*|]").alias("D"),
    )
    words, distinct = F.col("w.words").cast("long"), F.col("w.distinct").cast("long")
    return read.select("doc_id", "part", "digest", (words < 50).alias("A"), (distinct * 100 < words * 65).alias("B"), "C", "D")


def flagged(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, the flags A to E, good and toxic, a row for each document; texts are read once."""
    read = written(failures(docs, part), "filter-flags")
    least = read.groupBy("digest").agg(F.min("doc_id").alias("_least")).withColumnRenamed("digest", "_digest").withColumn("_first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = read.join(least, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_least")), "left").join(known, F.col("doc_id") == F.col("_id"), "left")
    return met.select("part", "A", "B", "C", "D", F.col("_first").isNull().alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def survivors(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, subset (bits of filters), n, good, toxic: the documents that fail no filter of the subset; zeros included."""
    names = list(letters)
    patterns = flags.groupBy("part", *names).agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")))
    cube = patterns.cube(*names, "part").agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "toxic")),
        sum(((F.lit(1) - F.grouping(c).cast("int")) * (1 << k) for k, c in enumerate(names)), F.lit(0)).alias("subset"),
        F.grouping("part").alias("_all"),
    )
    none = F.lit(True)
    for c in names:
        none = none & ~F.coalesce(F.col(c), F.lit(False))
    found = cube.where((F.col("_all") == 0) & none).select("part", "subset", "n", "good", "toxic")
    subsets = F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset")
    every = flags.select("part").distinct().select("part", subsets)
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")))


def steps(letters: str = LETTERS) -> list[tuple[str, int, int, int]]:
    """order, step, the step's filter (bit), and the subset before it, for every order."""
    bit = {c: 1 << k for k, c in enumerate(letters)}
    return [("".join(order), k + 1, bit[c], sum(bit[x] for x in order[:k])) for order in permutations(letters) for k, c in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame, part: Column, letters: str = LETTERS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(written(survivors(flagged(docs, labels, part), letters), "filter-survivors"), letters)


def interactions(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """From the survivors of all subsets: pairs of subsets one filter apart, then every order's steps over them."""
    n, full = len(letters), (1 << len(letters)) - 1
    bits = F.explode(F.array(*(F.lit(1 << k) for k in range(n)))).alias("filter")
    before = found.select("part", F.col("subset").alias("before"), bits, F.col("n").alias("n0"), F.col("good").alias("g0"), F.col("toxic").alias("t0")).where("before & filter = 0")
    after = found.select("part", F.col("subset").alias("after"), "n", "good", "toxic")
    pairs = before.withColumn("after", F.expr("before | filter")).join(after, ["part", "after"])
    removed, mine = F.col("removed"), Window.partitionBy("part", "filter")
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n))), F.expr("bit_count(before)") + 1)
    pairs = pairs.select("part", "filter", "before", F.col("n").alias("kept"), (F.col("n0") - F.col("n")).alias("removed"), (F.col("g0") - F.col("good")).alias("good_lost"), (F.col("t0") - F.col("toxic")).alias("toxic_lost"))
    at = lambda subset: F.sum(F.when(subset, removed).otherwise(0)).over(mine)
    pairs = pairs.select("*", at(F.col("before") == 0).alias("fails"), at(F.expr(f"before = {full} - filter")).alias("unique_fails"), F.sum(removed * weight).over(mine).alias("shapley"))
    orders = found.sparkSession.createDataFrame(steps(letters), "filter_order string, step int, filter int, before int")
    return pairs.join(F.broadcast(orders), ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - removed).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")

"""Rule bitmask ledger: every rule is evaluated once per document; its failure sets a bit, its measurement stays.

Policies are versioned bit masks applied to the ledger afterwards, so a changed policy never reads a text again, and
ablations come from bitwise tests on the ledger's distinct bit patterns. Built-in functions only; each array stays in
its row, so there is no shuffle until an ablation report asks for one.

Defined results: a null text is empty (no words, every count 0, the word-count rule fails); repeated rows are judged
each on its own; an empty table gives an empty ledger; further columns of the input are left out unless named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Distinct repeated windows up to which membership is looked up directly; beyond it, by sorting.
DIRECT = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, although body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def _windows(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))


def _covered(at: Column) -> Column:
    """Words in the union of the 3-word windows that start at the ascending places at."""
    steps = F.transform(at, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - at[k - 1])))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _by_lookup(h: Column, twice: Column) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, h[i]))
    return let(at, _covered)


def _by_sorting(h: Column) -> Column:
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        same = lambda x, k: ((k > 0) & (x["h"] == p[F.greatest(k - 1, F.lit(0))]["h"])) | ((k < F.size(p) - 1) & (x["h"] == p[F.least(k + 1, F.size(p) - 1)]["h"]))
        return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

    return let(let(pairs, places), _covered)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more, the first included."""

    def of(h: Column) -> Column:
        def sorted_windows(s: Column) -> Column:
            return F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == s[F.greatest(k - 1, F.lit(0))])))

        return let(let(F.sort_array(h), sorted_windows), lambda twice: F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= DIRECT, _by_lookup(h, twice)).otherwise(_by_sorting(h)))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(_windows(w), of))


def duplicate_lines(text: Column) -> Column:
    filled = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(filled, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("again"), F.size(x).alias("lines")))


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and one column for each measurement; the texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    first = docs.select(
        *keep,
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("repeat"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"), only("!").alias("n_bangs"),
        only("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), only("abcdefghijklmnopqrstuvwxyz").alias("n_lower"),
        duplicate_lines(text).alias("l"),
    )
    long = lambda c: F.col(c).cast("long").alias(c.split(".")[-1])
    return first.select(*keep, long("w.n_words"), long("word_chars"), long("n_symbols"), F.col("l.again").cast("long").alias("n_dup_lines"), F.col("w.repeat").cast("long").alias("n_repeat_words"), F.col("l.lines").cast("long").alias("n_lines"), long("n_bangs"), long("n_upper"), long("n_lower"))


@dataclass(frozen=True)
class Rule:
    """A document fails when the expression over the measurements holds; bit is its place in the ledger for good."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 8 * word_chars"),
    Rule(3, "exclamations", "100 * n_bangs > 8 * word_chars"),
    Rule(4, "capitals", "n_upper + n_lower > 100 AND 100 * n_upper > 60 * (n_upper + n_lower)"),
    Rule(5, "duplicate_lines", "n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(6, "long_words", "n_words > 0 AND word_chars > 40 * n_words"),
)
#: Versioned policies: the bits that reject a document.
POLICIES = {"base-1": 0b11, "web-1": 0b1111111}


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the measurements, and fail_bits (long)."""
    bits = " + ".join(f"IF({r.fails}, {1 << r.bit}L, 0L)" for r in rules)
    return measured(docs, keep).withColumn("fail_bits", F.expr(bits))


def apply_policy(book: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    return book.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablations(book: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: rule, failed (documents whose bit is set), only (rejected by no other rule, so kept
    without it), and met_by (the bits that fail together with it somewhere). At most 2 ** rules patterns leave the
    first aggregation."""
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if mask >> r.bit & 1]
    listed = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    each = patterns.select("bits", "n", F.explode(listed).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only"),
        F.bit_or(F.when(has, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("met_by"),
    ).drop("bit")

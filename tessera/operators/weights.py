"""Weights of held names, pairs of formulas by correlation, and counts of consecutive periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.registry import rolling
from ..sources.tables import written_table
from .store import capped_weights


def inverse_volatility(panel: DataFrame, held: Column, ret: Column, n: int, cap: float) -> DataFrame:
    """panel(di, sym, ...) to (di, sym, w): per date, held names weighted by one over the deviation of their last n
    returns, capped; names without a deviation, or not held, weigh nothing."""
    w = rolling(n)
    vol = F.when(F.count(ret).over(w) >= max(2, n // 2), F.stddev_samp(ret).over(w))
    df = panel.select("di", "sym", F.coalesce(held, F.lit(False)).alias("_h"), vol.alias("_v"))
    own = df.select("di", "sym", F.when(F.col("_h") & (F.col("_v") > 0), 1 / F.when(F.col("_v") > 0, F.col("_v"))).alias("w"))
    capped = capped_weights(own.where("w IS NOT NULL").withColumnRenamed("sym", "id"), "di", cap).withColumnRenamed("id", "sym")
    return own.select("di", "sym").join(capped, ["di", "sym"], "left").select("di", "sym", F.coalesce("w", F.lit(0.0)).alias("w"))


def next_day(weights: DataFrame) -> DataFrame:
    """Weights as they can be traded: those of the date before; the first date has none."""
    return weights.withColumn("w", F.coalesce(F.lag("w").over(Window.partitionBy("sym").orderBy("di")), F.lit(0.0)))


#: Pairs that one task makes, about.
TASK_PAIRS = 4_000_000
#: And partitions at most, which bounds what a shuffle keeps of each; beyond them a task makes more pairs, one block after another.
MOST_TASKS = 20_000


def _paired(left: DataFrame, right: DataFrame, kind: str, where: str | None = None) -> DataFrame:
    """left(a, kind) and right(b, kind) by kind. The pairs of a kind grow with the square of it, so they are dealt out: a
    kind's left rows go to as many blocks as it has pairs for, and each block meets all the kind's right rows. The number
    of partitions is stated, as small inputs would otherwise be put together in one task whatever comes out of it."""
    spark = left.sparkSession
    count = lambda df, n: df.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias(n))
    blocks = count(left, "_l").join(count(right, "_r"), kind).select(kind, F.ceil(F.col("_l").cast("double") * F.col("_r") / TASK_PAIRS).alias("_blocks"))
    blocks = written_table(blocks, "blocks")
    tasks = min(blocks.agg(F.coalesce(F.sum("_blocks"), F.lit(1))).first()[0], MOST_TASKS)
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = left.join(F.broadcast(blocks), kind).withColumn("_block", F.pmod(F.xxhash64("a"), F.col("_blocks")))
    all_of = right.join(F.broadcast(blocks), kind).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    keys = [kind, "_block"]
    pairs = one.drop("_blocks").repartition(tasks, *keys).join(all_of.drop("_blocks").repartition(tasks, *keys), keys)
    return (pairs.where(where) if where else pairs).select("a", kind, "b")


def cross_pairs(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """Pairs of two groups of formulas(id, <kind>) that agree in kind; by equality, so no kind meets another."""
    return _paired(left.select(F.col("id").alias("a"), kind), right.select(F.col("id").alias("b"), kind), kind)


def inner_pairs(formulas: DataFrame, kind: str) -> DataFrame:
    """Unordered pairs within a kind."""
    return _paired(formulas.select(F.col("id").alias("a"), kind), formulas.select(F.col("id").alias("b"), kind), kind, "a < b")


def split_by_correlation(corrs: DataFrame, share: float) -> DataFrame:
    """corrs(a, b, corr) with near: whether the absolute correlation reaches its quantile at share; a missing one does not."""
    size = F.abs(F.col("corr"))
    cut = corrs.agg(F.percentile(size, F.lit(share)).alias("_cut"))
    return corrs.crossJoin(F.broadcast(cut)).withColumn("near", F.coalesce(size >= F.col("_cut"), F.lit(False))).drop("_cut")


def consecutive(periods: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """periods(key, place, value), places whole numbers without gaps: for each row how many periods in a row, up to it,
    have a value above nought."""
    w = Window.partitionBy(key).orderBy(place)
    last = F.max(F.when(F.coalesce(F.col(value), F.lit(0)) <= 0, F.col(place))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(place).over(Window.partitionBy(key))
    return periods.withColumn("run", F.col(place) - F.coalesce(last, first - 1))

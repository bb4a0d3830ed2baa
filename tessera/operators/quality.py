"""Checks of values against themselves and each other, and plain statistics of results: grouped aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("date", "sym")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def profile(values: DataFrame, column: str) -> DataFrame:
    """One row: rows, dates, symbols, missing, infinite, repeated keys, and the fewest days between a symbol's dates."""
    x = F.col(column)
    gap = F.date_diff("date", F.lag("date").over(Window.partitionBy("sym").orderBy("date")))
    keyed = values.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.when(x.isNull() | F.isnan(x), 1).otherwise(0)).alias("missing"), F.sum(F.when(F.abs(x) == float("inf"), 1).otherwise(0)).alias("infinite"))
    return keyed.withColumn("gap", gap).agg(
        F.sum("n").alias("rows"), F.count_distinct("date").alias("dates"), F.count_distinct("sym").alias("symbols"), F.sum("missing").alias("missing"), F.sum("infinite").alias("infinite"),
        F.sum(F.col("n") - 1).alias("repeated"), F.min("gap").alias("least_gap"),
    )


def compared(a: DataFrame, b: DataFrame, column: str, tolerance: float = 1e-6) -> DataFrame:
    """One row over two tables of (date, sym, column), one row a key: rows of each and their ratio, keys in both and
    their share of all keys, whether as many are missing, the share of equal values among those known in both, and
    their correlation."""
    side = lambda df, c: df.select(*KEYS, F.when(_finite(F.col(column)), F.col(column)).alias(c), F.lit(1).alias(f"in_{c}"))
    both = side(a, "x").join(side(b, "y"), list(KEYS), "full_outer")
    n = both.agg(
        F.count("in_x").alias("rows_a"), F.count("in_y").alias("rows_b"), F.count(F.when(F.col("in_x").isNotNull() & F.col("in_y").isNotNull(), 1)).alias("common"), F.count("*").alias("all"),
        (F.count("in_x") - F.count("x")).alias("missing_a"), (F.count("in_y") - F.count("y")).alias("missing_b"),
        F.avg(F.when(F.abs(F.col("x") - F.col("y")) < tolerance, 1.0).when(F.col("x").isNotNull() & F.col("y").isNotNull(), 0.0)).alias("equal_share"), F.corr("x", "y").alias("corr"),
    )
    ratio = F.try_divide(F.least("rows_a", "rows_b"), F.greatest("rows_a", "rows_b"))
    return n.select("rows_a", "rows_b", ratio.alias("row_ratio"), F.try_divide("common", "all").alias("overlap"), (F.col("missing_a") == F.col("missing_b")).alias("missing_equal"), "equal_share", "corr")


def concentration(daily: DataFrame, column: str, tops: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: the share of all absolute values that the greatest ones hold. Only the greatest are ordered."""
    x = F.abs(F.col(column))
    known = daily.where(_finite(F.col(column))).select(x.alias("x"))
    best = known.orderBy(F.desc("x")).limit(max(tops)).agg(F.sort_array(F.collect_list("x"), asc=False).alias("best"))
    top = lambda k: F.aggregate(F.slice("best", 1, k), F.lit(0.0), lambda s, v: s + v)
    return known.agg(F.sum("x").alias("total")).crossJoin(F.broadcast(best)).select(*(F.try_divide(top(k), F.col("total")).alias(f"top{k}") for k in tops))


def draw(*parts: Column) -> Column:
    """A whole number below 2^32 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def bootstrap(values: DataFrame, column: str, draws: int = 5000, seed: int = 20260625) -> DataFrame:
    """One row: mean, and the 2.5 % and 97.5 % points of the means of resamples drawn with replacement. A resample is
    dealt by its number, so the draws run side by side; values is a column of results (a row a date), not raw data."""
    x = F.col(column)
    known = values.where(_finite(x)).select(x.alias("x"), (F.row_number().over(Window.orderBy(x)) - 1).alias("at"))
    n = known.count()
    drawn = values.sparkSession.range(0, draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")) if n else values.sparkSession.createDataFrame([], "draw long, i int")
    drawn = drawn.select("draw", (draw(F.lit(seed), F.col("draw"), F.col("i")) % max(n, 1)).cast("int").alias("at"))
    means = drawn.join(known, "at").groupBy("draw").agg(F.avg("x").alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).crossJoin(F.broadcast(known.agg(F.avg("x").alias("mean"))))


def sign_test(positive: Column, n: Column) -> Column:
    """Two-sided exact binomial probability of a split as uneven as positive of n."""
    k = F.least(positive, n - positive).cast("int")
    # log of binomial(n, j) grows term by term
    start = F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.ln(F.lit(2.0))).alias("sum"))
    step = lambda s, j: F.struct((s["log"] + F.ln((n - j + 1) / j)).alias("log"), (s["sum"] + F.exp(s["log"] + F.ln((n - j + 1) / j) - n * F.ln(F.lit(2.0)))).alias("sum"))
    places = F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(n > 0, F.least(F.aggregate(places, start, step)["sum"] * 2, F.lit(1.0)))


def by_blocks(daily: DataFrame, column: str, blocks: int = 5) -> DataFrame:
    """Per block of equally many dates: first and last date, mean, share above nought, and the sign test."""
    x = F.col(column)
    cut = daily.where(x.isNotNull()).withColumn("block", F.ntile(blocks).over(Window.orderBy("di")))
    out = cut.groupBy("block").agg(F.min("di").alias("first"), F.max("di").alias("last"), F.avg(x).alias("mean"), F.sum(F.when(x > 0, 1).otherwise(0)).alias("wins"), F.count("*").alias("n"))
    return out.select("block", "first", "last", "mean", (F.col("wins") / F.col("n")).alias("win_rate"), sign_test(F.col("wins"), F.col("n")).alias("p"))


def passes(df: DataFrame, rules: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether each column lies within its bounds; a missing value fails."""
    out = F.lit(True)
    for name, (low, high) in rules.items():
        x = F.col(name)
        ok = _finite(x)
        ok = ok if low is None else ok & (x >= low)
        out = out & (ok if high is None else ok & (x <= high))
    return F.coalesce(out, F.lit(False))

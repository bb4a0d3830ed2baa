"""Factor portfolios: breakpoints at each rebalancing, membership until the next, and daily differences of their returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Sort:
    """signal's lower part goes up to its quantile low, the upper part from high on (beyond it where both are the same);
    sign 1 is upper less lower. within: a column that splits a period's symbols before they are sorted."""

    signal: str
    low: float = 0.3
    high: float = 0.7
    sign: int = 1
    within: str | None = None


def signal_rows(panel: DataFrame, period: Column, valid: Column) -> DataFrame:
    """The rows from which each period's portfolios are made: those of the last date before its first one. The calendar,
    a row for each date, says which dates they are; a period that begins the panel has none."""
    cal = panel.select("di", period.alias("period")).distinct()
    first = cal.groupBy("period").agg((F.min("di") - 1).alias("di"))
    return panel.join(F.broadcast(first), "di").where(F.coalesce(valid, F.lit(False)))


def halves(signals: DataFrame, signal: str, name: str) -> DataFrame:
    """signals with name: 0 up to the period's median, 1 above; NULL without signal."""
    cut = signals.groupBy("period").agg(F.percentile(signal, F.lit(0.5)).alias("_m"))
    return signals.join(cut, "period").withColumn(name, F.when(F.col(signal).isNotNull(), F.when(F.col(signal) <= F.col("_m"), 0).otherwise(1))).drop("_m")


def members(signals: DataFrame, sorts: dict[str, Sort], least: int = 40) -> DataFrame:
    """period, sym, factor, part (-1 lower, 1 upper), cell: what each symbol is in for a period. Periods (and cells) with
    fewer than `least` signals have no portfolio. Breakpoints are an aggregate, a row a period and cell."""
    out = None
    for name, s in sorts.items():
        cell = F.coalesce(F.col(s.within).cast("int"), F.lit(-1)) if s.within else F.lit(-1)
        rows = signals.where(F.col(s.signal).isNotNull() if not s.within else F.col(s.signal).isNotNull() & F.col(s.within).isNotNull()).select("period", "sym", F.col(s.signal).alias("_s"), cell.alias("cell"))
        cuts = rows.groupBy("period", "cell").agg(F.percentile("_s", F.array(F.lit(s.low), F.lit(s.high))).alias("_q"), F.count("*").alias("_n")).where(F.col("_n") >= least)
        upper = F.col("_s") > F.col("_q")[1] if s.low == s.high else F.col("_s") >= F.col("_q")[1]
        part = F.when(F.col("_s") <= F.col("_q")[0], -1).when(upper, 1)
        one = rows.join(cuts, ["period", "cell"]).withColumn("part", part).where("part IS NOT NULL").select("period", "sym", F.lit(name).alias("factor"), "part", "cell")
        out = one if out is None else out.unionByName(one)
    return out


def factor_returns(panel: DataFrame, period: Column, ret: str, held: DataFrame, sorts: dict[str, Sort]) -> DataFrame:
    """Per date one column for each factor: the mean return of one part less that of the other, averaged over cells; 0 where
    there is no portfolio. A membership holds for all dates of its period, so dates meet it by period and symbol; means
    are made per date before anything is put side by side."""
    days = panel.select("date", "di", "sym", F.col(ret).alias("_r"), period.alias("period"))
    joined = days.join(held, ["period", "sym"])
    means = joined.groupBy("date", "factor", "cell").agg(F.avg(F.when(F.col("part") == 1, F.col("_r"))).alias("up"), F.avg(F.when(F.col("part") == -1, F.col("_r"))).alias("down"))
    wide = means.groupBy("date").agg(*(F.avg(F.when(F.col("factor") == name, (F.col("up") - F.col("down")) * s.sign)).alias(name) for name, s in sorts.items()))
    # a portfolio whose returns are all missing gives a missing return, no portfolio gives 0
    there = held.groupBy("period").agg(*(F.max(F.when(F.col("factor") == name, 1)).alias(f"_{name}") for name in sorts))
    have = days.select("date", "di", "period").distinct().join(F.broadcast(there), "period", "left").join(wide, "date", "left")
    return have.select("date", "di", *(F.when(F.col(f"_{name}").isNull(), 0.0).otherwise(F.col(name)).alias(name) for name in sorts))


def rolled(series: DataFrame, columns: list[str], lengths: tuple[int, ...]) -> DataFrame:
    """series(date, di, columns) with sums over the last lengths dates, full windows only: one row a date."""
    w = lambda n: Window.orderBy("di").rowsBetween(-(n - 1), 0)
    return series.select("*", *(F.when(F.count(c).over(w(n)) == n, F.sum(c).over(w(n))).alias(f"{c}_{n}") for c in columns for n in lengths))

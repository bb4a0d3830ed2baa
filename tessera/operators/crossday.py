"""Daily features of minute bars, and how unusual each is against the days before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.panels import densify
from .minute import DAY

EPS = 1e-8
FEATURES = ["amihud", "tail_vol_share", "high_to_close", "order_imbalance", "path_efficiency"]


def day_features(bars: DataFrame, tail_from: int = 1410) -> DataFrame:
    """bars(date, sym, minute, open, high, close, volume, amount) to one row for each day and symbol: absolute return over
    amount, the tail's share of the volume, how far the close is below the high, signed over whole volume, and how
    straight the price went. The order within a day and the sums over it share one shuffle by day and symbol."""
    order = Window.partitionBy(*DAY).orderBy("minute")
    moved = F.abs(F.col("close") - F.lag("close").over(order))
    ret = F.try_divide("close", "open") - 1
    df = bars.select(*DAY, "minute", "open", "high", "close", "volume", "amount", ret.alias("_r"), moved.alias("_d"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total, first, last, top = zero(F.sum("volume")), F.min_by("open", "minute"), F.max_by("close", "minute"), F.max("high")
    return df.groupBy(*DAY).agg(
        F.avg(F.abs("_r") / (F.col("amount") + EPS)).alias("amihud"), (zero(F.sum(F.when(F.col("minute") >= tail_from, F.col("volume")))) / (total + EPS)).alias("tail_vol_share"),
        ((top - last) / (F.abs(top - first) + EPS)).alias("high_to_close"), (zero(F.sum(F.signum("_r") * F.col("volume"))) / (total + EPS)).alias("order_imbalance"),
        (F.abs(last - first) / (zero(F.sum("_d")) + EPS)).alias("path_efficiency"),
    )


def past_zscores(daily: DataFrame, columns: list[str], window: int = 20, least: int = 5) -> DataFrame:
    """columns against the window of dates before each date, today left out: one sort of a symbol's dates for all of them.
    0 where today is missing or too few days are known."""
    w = Window.partitionBy("sym").orderBy("di").rowsBetween(-window, -1)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.sqrt(F.greatest(F.var_pop(c).over(w), F.lit(EPS)))
    return daily.select("date", "di", "sym", *(F.when(F.col(c).isNotNull() & (F.count(c).over(w) >= least), z(c)).otherwise(0.0).alias(f"anom_{c}_z{window}") for c in columns))


def anomaly_panels(bars: DataFrame, window: int = 20, least: int = 5, tail_from: int = 1410) -> DataFrame:
    """All features' panels out of one scan of the bars; only a row for each day and symbol is shuffled again."""
    return past_zscores(densify(day_features(bars, tail_from)), FEATURES, window, least)

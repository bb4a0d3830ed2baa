"""As-of joins, event panels, trailing sums, and incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def backward(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row of the same key at or before (strict: before) its time. One shuffle
    by key: both sides are lined up by time and the last event is carried on; a NULL value in the event is carried too."""
    event = F.struct(*values)
    a = left.withColumns({"_e": F.lit(None).cast(right.select(event.alias("e")).schema["e"].dataType), "_s": F.lit(0 if strict else 1)})
    b = right.select(F.col(by), F.col(at), event.alias("_e"), F.lit(1 if strict else 0).alias("_s"))
    w = Window.partitionBy(by).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_l", F.last("_e", ignorenulls=True).over(w))
    mine = F.col("_s") == (0 if strict else 1)
    return both.where(mine).select(*left.columns, *(F.col("_l")[v].alias(v) for v in values))


def next_date(events: DataFrame, at: str, calendar: DataFrame, date: str = "date") -> DataFrame:
    """events with effective: the first calendar date strictly after their own. The calendar's dates pair up with their
    successors, so each event meets one range; the calendar is one row per date."""
    spans = calendar.select(F.col(date).alias("_a")).distinct().withColumn("_b", F.lead("_a").over(Window.orderBy("_a")))
    first = calendar.agg(F.min(date).alias("_first"))
    day = F.to_date(F.col(at))
    # every day of a span is a key of its own, so this is an equi-join
    days = spans.where("_b IS NOT NULL").select("_b", F.explode(F.sequence("_a", F.date_sub("_b", 1))).alias("_day"))
    joined = events.withColumn("_day", day).join(days, "_day", "left").crossJoin(F.broadcast(first))
    return joined.withColumn("effective", F.when(F.col("_day") < F.col("_first"), F.col("_first")).otherwise(F.col("_b"))).drop("_day", "_b", "_first")


def trailing(events: DataFrame, by: str, order: str, value: str, n: int = 4, name: str = "ttm") -> DataFrame:
    """The sum over the last n rows of a key; NULL until there are n."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)
    return events.withColumn(name, F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def single_periods(events: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Running totals within a year back to single periods."""
    return events.withColumn("single", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(order)), F.lit(0)))


def merged(old: DataFrame, new: DataFrame, date: str, start) -> DataFrame:
    """Rows of old before start, rows of new from start on."""
    return old.where(F.col(date) < F.lit(start)).unionByName(new.where(F.col(date) >= F.lit(start)))

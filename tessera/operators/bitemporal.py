"""Tables with two time axes: the period that a filing tells of, and the day on which it became known.

A filing restates any period at any later day, so every figure is a question with a day in it: the period as known on
that day. Keys are shuffled once; all windows and groups below are within a key and keep that partitioning. A key's
filings stream through one task's sorted windows (they spill), never through an array of them: per day at most `depth`
look-ups are made.

Periods are whole numbers, quarters counted through (4 * year + quarter - 1); flows are filed as totals of the year so
far, stocks as they stand. Missing periods stay missing, also in the sums over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dialects import safe_growth, safe_ratio
from .asof import backward, next_date

#: Quarters that a snapshot looks back: 12 yearly sums with room for gaps, each over 4 quarters and the one before.
DEPTH = 24


def as_known(filings: DataFrame, keys: list[str], period: str, known: str, values: list[str], depth: int = DEPTH) -> DataFrame:
    """filings(keys, period, known, values) to one row for each key and day with filings: latest, the last period known by
    then, and seen, an array of structs of the values of the periods latest, latest - 1, ... as known on that day, NULL
    where nothing was known. Of several filings of one period on one day the greatest values count."""
    day = [*keys, known]
    each = filings.repartition(*keys).groupBy(*day, period).agg(F.max(F.struct(*values)).alias("_v"))
    so_far = Window.partitionBy(*keys).orderBy(known).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumns({"latest": F.max(period).over(so_far), "_n": F.row_number().over(Window.partitionBy(*day).orderBy(period))})
    nothing = F.lit(None).cast(each.schema["_v"].dataType)
    row = lambda p, off, v: F.struct(p.alias("p"), off.cast("int").alias("off"), v.alias("v"))
    filed = F.array(row(F.col(period), F.lit(None), F.col("_v")))
    asked = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: row(F.col("latest") - i, i, nothing))
    rows = each.select(*day, "latest", F.explode(F.when(F.col("_n") == 1, F.concat(filed, asked)).otherwise(filed)).alias("_r")).select(*day, "latest", "_r.*")
    # a day's filings come before its questions
    to_here = Window.partitionBy(*keys, "p").orderBy(F.col(known), F.col("off").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    answers = rows.withColumn("_seen", F.last("v", ignorenulls=True).over(to_here)).where("off IS NOT NULL")
    seen = F.array_sort(F.collect_list(F.struct("off", F.col("_seen").alias("v"))))
    return answers.groupBy(*day, "latest").agg(F.transform(seen, lambda x: x["v"]).alias("seen"))


def single_quarters(seen: Column, latest: Column, field: str, depth: int = DEPTH) -> Column:
    """The flows of single quarters, back from the latest, out of totals of the year so far."""
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 2)), lambda i: F.when(F.pmod(latest - i, F.lit(4)) == 0, seen[i][field]).otherwise(seen[i][field] - seen[i + 1][field]))


def yearly_sums(single: Column, depth: int = DEPTH) -> Column:
    """Sums of four quarters each, back from the latest; NULL where one of them is missing."""
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 5)), lambda i: single[i] + single[i + 1] + single[i + 2] + single[i + 3])


def _last_few(values: Column, n: int, least: int) -> Column:
    """Sample deviation of the first n that are there, from `least` of them on."""
    some = F.slice(F.filter(values, lambda x: x.isNotNull()), 1, n)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    mean = lambda a: total(a, lambda x: x) / F.size(a)
    return F.when(F.size(some) >= least, F.sqrt(total(F.transform(some, lambda x: F.pow(x - mean(some), 2)), lambda x: x) / (F.size(some) - 1)))


#: Flows and stocks of a statement that the measures read.
FLOWS, STOCKS = ["profit", "revenue", "operating", "cost"], ["assets", "debt", "equity", "long_debt"]


def fundamentals(filings: DataFrame, keys: list[str], period: str = "period", known: str = "known", depth: int = DEPTH) -> DataFrame:
    """Per key and day with filings: yearly sums, ratios and growth of the latest period, as known on that day."""
    df = as_known(filings, keys, period, known, FLOWS + STOCKS, depth)
    df = df.withColumns({f"_{f}": single_quarters(F.col("seen"), F.col("latest"), f, depth) for f in FLOWS})
    df = df.withColumns({f"_{f}": yearly_sums(F.col(f"_{f}"), depth) for f in FLOWS})
    roe = F.transform(F.sequence(F.lit(0), F.lit(depth - 5)), lambda i: safe_ratio(F.col("_profit")[i], F.col("seen")[i]["equity"], -5.0, 5.0))
    df = df.withColumn("_roe", roe)
    now, ago = (lambda f: F.col(f"_{f}")[0]), (lambda f: F.col(f"_{f}")[4])
    stock = {f: F.col("seen")[0][f] for f in STOCKS}
    cost, cost_ago = safe_ratio(now("cost"), now("revenue"), 0.0, 5.0), safe_ratio(ago("cost"), ago("revenue"), 0.0, 5.0)
    return df.select(
        *keys, known, "latest", *(now(f).alias(f"{f}_ttm") for f in FLOWS), *(stock[f].alias(f) for f in STOCKS),
        safe_ratio(now("profit"), stock["equity"], -2.0, 2.0).alias("roe"), (safe_ratio(now("profit"), stock["equity"], -2.0, 2.0) - F.col("_roe")[4]).alias("roe_trend"), (-_last_few(F.col("_roe"), 12, 8)).alias("roe_stability"),
        safe_ratio(now("operating"), now("revenue"), -5.0, 5.0).alias("profit_margin"), safe_ratio(now("operating"), stock["debt"], -5.0, 5.0).alias("cash_coverage"), safe_ratio(stock["debt"], stock["assets"], 0.0, 2.0).alias("leverage"),
        safe_growth(stock["assets"], F.col("seen")[4]["assets"], -2.0, 10.0).alias("asset_growth"), safe_growth(now("revenue"), ago("revenue"), -2.0, 10.0).alias("revenue_growth"), safe_growth(now("profit"), ago("profit"), -3.0, 10.0, True).alias("earnings_growth"),
        safe_ratio(now("profit"), now("revenue"), -5.0, 5.0).alias("net_margin"), safe_ratio(now("revenue"), stock["assets"], 0.0, 20.0).alias("asset_turnover"),
        cost.alias("operating_cost_ratio"), (cost - cost_ago).alias("cost_ratio_trend"), safe_ratio(stock["long_debt"], stock["debt"], 0.0, 1.0).alias("long_term_debt_ratio"),
    )


def panel(events: DataFrame, days: DataFrame, key: str, known: str, calendar: DataFrame, values: list[str]) -> DataFrame:
    """days(key, date) with the values known by then: an event counts from the first day of the calendar after the one
    on which it became known; of several that count from one day the last known; a missing value of an event is carried
    on as missing."""
    timed = next_date(events, known, calendar).where("effective IS NOT NULL")
    last = timed.groupBy(key, F.col("effective").alias("date")).agg(F.max_by(F.struct(known, *values), known).alias("_e")).select(key, "date", "_e.*")
    return backward(days, last, key, "date", [known, *values])


def condensed(filings: DataFrame, keys: list[str], period: str, known: str, values: list[str], day) -> DataFrame:
    """What an update from `day` on needs of the filings: those known from then on, and of each period the last one known
    before. Figures as known on `day` or later come out the same as from all filings."""
    old = filings.where(F.col(known) < F.lit(day)).groupBy(*keys, period).agg(F.max(F.struct(known, *values)).alias("_v"))
    return old.select(*keys, period, f"_v.{known}", *(f"_v.{v}" for v in values)).unionByName(filings.where(F.col(known) >= F.lit(day)).select(*keys, period, known, *values))

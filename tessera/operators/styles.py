"""Derived style fields, exposures and feature preparation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.registry import cs, rolling
from .evaluation import safe_corr


def clipped(x: Column, lower: float = 0.05, upper: float = 0.95) -> Column:
    """x between the date's quantiles."""
    q = lambda p: F.percentile(x, F.lit(p)).over(cs())
    return F.when(x.isNotNull(), F.greatest(F.least(x, q(upper)), q(lower)))


def weighted_style(panel: DataFrame, fields: list[str], weight: str, name: str = "style") -> DataFrame:
    """Mean over the fields of their clipped values, centred on the weighted mean and scaled by the deviation."""
    df = panel.withColumns({f"_c{k}": clipped(F.col(f)) for k, f in enumerate(fields)})
    w = F.col(weight)
    for k in range(len(fields)):
        c = F.col(f"_c{k}")
        known = F.when(c.isNotNull(), w)
        mean = F.try_divide(F.sum(c * w).over(cs()), F.sum(known).over(cs()))
        df = df.withColumn(f"_z{k}", F.when(F.min(c).over(cs()) < F.max(c).over(cs()), (c - mean) / F.stddev_samp(c).over(cs())))
    zs = [F.col(f"_z{k}") for k in range(len(fields))]
    count = reduce(lambda a, b: a + b, (F.when(z.isNotNull(), 1).otherwise(0) for z in zs))
    total = reduce(lambda a, b: a + b, (F.coalesce(z, F.lit(0.0)) for z in zs))
    return df.withColumn(name, F.when(count > 0, total / count)).drop(*(f"_{p}{k}" for p in "cz" for k in range(len(fields))))


def exposures(values: DataFrame, styles: list[str]) -> DataFrame:
    """values(di, v, styles): per date the correlation of v with each style."""
    return values.groupBy("di").agg(*(safe_corr(F.col("v"), F.col(s)).alias(s) for s in styles))


def market_beta(panel: DataFrame, ret: str, weight: str, n: int, least: int) -> DataFrame:
    """panel with beta: rolling slope of a symbol's return on the weighted return of its date."""
    known = F.when(F.col(ret).isNotNull() & F.col(weight).isNotNull(), F.col(weight))
    market = panel.withColumn("_m", F.try_divide(F.sum(F.col(ret) * F.col(weight)).over(cs()), F.sum(known).over(cs())))
    both = F.col(ret).isNotNull() & F.col("_m").isNotNull()
    df = market.withColumns({"_x": F.when(both, F.col("_m")), "_y": F.when(both, F.col(ret))})
    w = rolling(n)
    ok = (F.count("_x").over(w) >= least) & (F.min("_x").over(w) < F.max("_x").over(w))
    return df.withColumn("beta", F.when(ok, F.try_divide(F.covar_samp("_x", "_y").over(w), F.var_samp("_x").over(w)))).drop("_m", "_x", "_y")


def row_ranked(df: DataFrame, fields: list[str]) -> DataFrame:
    """Each row's fields as (average rank - 0.5) / n within the row; a missing one is 0.5."""
    a = F.array(*(F.col(f).cast("double") for f in fields))
    present = F.filter(a, lambda v: v.isNotNull())

    def rank(x: Column) -> Column:
        below, same = F.size(F.filter(present, lambda v: v < x)), F.size(F.filter(present, lambda v: v == x))
        return F.when(x.isNull(), 0.5).otherwise((below + (same + 1) / 2 - 0.5) / F.size(present))

    return df.withColumns({f"{f}_r": rank(F.col(f).cast("double")) for f in fields})


def _booked(n1: int):
    """Streams names in order of book, date and rank; what stays is the names held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, day, held, today = object(), None, set(), []

        def closed() -> list[int]:
            kept = [i for i in today if i in held]
            return (kept + [i for i in today if i not in held])[:n1]

        for batch in batches:
            out: list[tuple] = []
            for b, d, i in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (b, d) != (book, day):
                    if today:
                        held = set(names := closed())
                        out += [(book, day, x) for x in names]
                    held, today = (held if b == book else set()), []
                    book, day = b, d
                today.append(i)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))], names=["book", "di", "id"])
        if today:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*((book, day, x) for x in closed())), (pa.int64(), pa.int32(), pa.int64()))], names=["book", "di", "id"])

    return run


def buffered(ranked: DataFrame, n1: int, n2: int, book: Column | None = None) -> DataFrame:
    """ranked(di, id, rank): held (di, id) of a book of n1 names that keeps a name while its rank is within n2; a date
    without names changes nothing. Only ranks within n2 matter. Dates of one book depend on each other, so they stream
    through one task in order, which holds one date's names; books (a column of whole numbers) run side by side and come
    first in the result."""
    rows = ranked.where(F.col("rank") <= n2).select((F.lit(0) if book is None else book).cast("long").alias("book"), F.col("di").cast("int").alias("di"), F.col("id").cast("long").alias("id"), "rank")
    held = rows.repartition("book").sortWithinPartitions("book", "di", "rank", "id").select("book", "di", "id").mapInArrow(_booked(n1), "book long, di int, id long")
    return held.drop("book") if book is None else held


def top_names(values: DataFrame, n: int) -> DataFrame:
    """values(di, sym, v): (di, id, rank) of each date's n best, ties by id."""
    w = Window.partitionBy("di").orderBy(F.desc("v"), "sym")
    return values.where("v IS NOT NULL").select("di", F.col("sym").alias("id"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def filled_in(panel: DataFrame, column: str, standard: Column, *others: Column) -> DataFrame:
    """panel with the column, missing values inside the standard universe taken from the first of the others that has one
    (windows that need less history, say)."""
    x = F.col(column)
    return panel.withColumn(column, F.when(x.isNull() & F.coalesce(standard, F.lit(False)), F.coalesce(*others)).otherwise(x))


def adjusted(panel: DataFrame, factor: str, columns: list[str]) -> DataFrame:
    """panel with prices times the adjustment factor of the date, as adj_<column>."""
    return panel.withColumns({f"adj_{c}": F.col(c) * F.col(factor) for c in columns})


#: Fields made of price c, volume v, amount a and return r (formulas).
PRICE_VOLUME = {
    "pvc5": "ts_corr(c,v,5)", "pvc20": "ts_corr(c,v,20)", "ema5": "ema1(c,5)", "ema20": "ema1(c,20)", "adv5": "ts_mean(v,5)", "adv20": "ts_mean(v,20)", "vol5": "ts_std(r,5)", "vol20": "ts_std(r,20)",
    "rvc5": "ts_corr(r,diff(log(v)),5)", "rvc20": "ts_corr(r,diff(log(v)),20)", "te": "div(abs(r),a)",
}

"""Train, validation and test ranges over a calendar, as a small table to join by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def walk_forward(spark: SparkSession, dates: int, train: int, validation: int, gap: int, test: int, step: int | None = None) -> DataFrame:
    """(fold, part, first, last): places in the calendar. Each fold trains on train dates, leaves gap dates, then
    validates, leaves gap dates again and tests; the next starts step (test by default) dates on."""
    step, rows, start, k = step or test, [], 0, 0
    while start + train + gap + validation + gap + test <= dates:
        a = start + train + gap
        b = a + validation + gap
        rows += [(k, "train", start, start + train - 1), (k, "validation", a, a + validation - 1), (k, "test", b, b + test - 1)]
        start, k = start + step, k + 1
    return spark.createDataFrame(rows, "fold int, part string, first int, last int")


def rolling_ranges(spark: SparkSession, dates: int, train: int, validation: int, gap: int, test: int, folds: int = 0) -> DataFrame:
    """The same table for tests that follow each other without gap; the last one ends with the calendar. A gap lies
    between validation and test only. folds: at most so many, 0 for all."""
    rows, begin, k = [], train + validation + gap, 0
    while begin < dates and not (folds and k >= folds):
        end = min(begin + test, dates)
        a, b = begin - gap - validation, begin - gap
        rows += [(k, "train", max(0, a - train), a - 1), (k, "validation", a, b - 1), (k, "test", begin, end - 1)]
        begin, k = end, k + 1
    return spark.createDataFrame([r for r in rows if r[2] <= r[3]], "fold int, part string, first int, last int")


def fixed_dates(panel: DataFrame, train: tuple[str, str], validation: tuple[str, str], test: tuple[str, str]) -> DataFrame:
    """panel(date, ...) with part, by the dates themselves; others go. The ranges must follow each other."""
    ends = [d for part in (train, validation, test) for d in part]
    if not (ends[0] <= ends[1] < ends[2] <= ends[3] < ends[4] <= ends[5]):
        raise ValueError("train, validation and test follow each other")
    within = lambda p: F.col("date").between(F.to_date(F.lit(p[0])), F.to_date(F.lit(p[1])))
    return panel.withColumn("part", F.when(within(train), "train").when(within(validation), "validation").when(within(test), "test")).where("part IS NOT NULL")


def labelled_parts(panel: DataFrame, ranges: DataFrame) -> DataFrame:
    """panel(di, ...) with fold and part: one row for each fold a date is in. The ranges grow with the calendar
    only; each becomes its dates, so the join is by equality."""
    return panel.join(ranges.select("fold", "part", F.explode(F.sequence("first", "last")).alias("di")), "di")

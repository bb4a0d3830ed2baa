"""Runs that compute only what new or changed dates can touch.

A refresh starts at a merge point, reads the source from as many dates before it as the formulas reach back (partition
pruning: dates are partitions), and replaces the target's partitions from the merge point on. A result store keeps each
formula's dates by a signature of everything they depend on: the formula, its version, and the content of the input
dates within its reach; a run computes the dates whose signature is new, and no others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.registry import ALL
from ..plans.formula import evaluate, parse
from ..sources.tables import exists, replace_partitions


def dates_of(df: DataFrame) -> list:
    """The calendar, one value a date: the partitions' own values, no rows."""
    return [r[0] for r in df.select("date").distinct().orderBy("date").collect()]


def span_of(formulas: dict[str, str]) -> tuple[float, float]:
    """Rows back and ahead that cover all formulas."""
    spans = [parse(f).span() for f in formulas.values()]
    return max((b for b, _ in spans), default=0), max((a for _, a in spans), default=0)


@dataclass(frozen=True)
class Refreshed:
    """The first date written, the first date read, and how many dates were read; none where all was up to date."""

    merged_from: object = None
    read_from: object = None
    dates_read: int = 0


def refresh(spark: SparkSession, source: str, target: str, transform: Callable[[DataFrame], DataFrame], span: tuple[float, float], changed_from=None) -> Refreshed:
    """Brings target up to source, both tables partitioned by date. transform gives rows with a date out of the source's
    rows, each depending on span (back, ahead) dates. Computed anew: dates from the first that target lacks or from
    changed_from, whichever is earlier, and the dates before that look ahead into them."""
    panel = spark.read.parquet(source)
    calendar = dates_of(panel)
    known = set(dates_of(spark.read.parquet(target))) if exists(spark, target) else set()
    first = next((k for k, d in enumerate(calendar) if d not in known or (changed_from is not None and d >= changed_from)), None)
    if first is None:
        return Refreshed()
    back, ahead = span
    merge = 0 if ahead == ALL else max(0, first - int(ahead))
    start = 0 if back == ALL else max(0, merge - int(back))
    values = transform(panel.where(F.col("date") >= F.lit(calendar[start]))).where(F.col("date") >= F.lit(calendar[merge]))
    replace_partitions(values, target, ["date"])
    return Refreshed(calendar[merge], calendar[start], len(calendar) - start)


def refresh_formulas(spark: SparkSession, source: str, target: str, formulas: dict[str, str], changed_from=None) -> Refreshed:
    """refresh() for formulas over a dense panel(date, di, sym, fields); they state themselves how far they reach."""
    return refresh(spark, source, target, lambda panel: evaluate(panel, formulas), span_of(formulas), changed_from)


@dataclass(frozen=True)
class ResultStore:
    """Results under a root folder, a table for each formula and version, a partition for each date."""

    root: str

    def path(self, formula: str, version: str) -> str:
        return f"{self.root}/{hashlib.sha256(f'{version}\n{parse(formula).text()}'.encode()).hexdigest()[:24]}"

    def signatures(self, panel: DataFrame, formula: str) -> DataFrame:
        """date, signature: one row a date. Each date's rows of the formula's fields are hashed and combined without
        order, then the dates within reach are; the second step has a row for each date of the calendar."""
        node = parse(formula)
        fields = sorted(node.fields())
        own = panel.groupBy("date").agg(F.bit_xor(F.xxhash64("sym", *fields)).alias("a"), F.sum(F.xxhash64(*fields, "sym") % 1_000_003).alias("b"), F.count("*").alias("n"))
        back, ahead = node.span()
        frame = Window.orderBy("date").rowsBetween(*(Window.unboundedPreceding if back == ALL else -int(back), Window.unboundedFollowing if ahead == ALL else int(ahead)))
        return own.select("date", F.xxhash64(F.bit_xor(F.xxhash64("date", "a", "b", "n")).over(frame), F.lit(formula)).alias("signature"))

    def run(self, panel: DataFrame, formula: str, version: str = "1", run: int = 0) -> tuple[DataFrame, list]:
        """The formula's values over all dates of panel(date, di, sym, fields), and the dates computed for it; the rest
        comes from the store. run is kept with what it computed."""
        spark, path = panel.sparkSession, self.path(formula, version)
        now = self.signatures(panel, formula)
        if exists(spark, path):
            kept = spark.read.parquet(path).groupBy("date").agg(F.first("signature").alias("kept"))
            now = now.join(kept, "date", "left").select("date", "signature", F.coalesce(F.col("signature") == F.col("kept"), F.lit(False)).alias("same"))
        else:
            now = now.withColumn("same", F.lit(False))
        signed = {r["date"]: (r["signature"], r["same"]) for r in now.collect()}  # one row a date
        calendar, todo = sorted(signed), sorted(d for d, (_, same) in signed.items() if not same)
        if todo:
            back, ahead = parse(formula).span()
            place = {d: k for k, d in enumerate(calendar)}
            reach = lambda k: range(0 if back == ALL else max(0, k - int(back)), len(calendar) if ahead == ALL else min(len(calendar), k + int(ahead) + 1))
            # a date's whole reach is there in one piece, so windows of rows see what they would see in the whole panel
            need = sorted({calendar[j] for d in todo for j in ((0, len(calendar) - 1) if math.inf in (back, ahead) else reach(place[d]))})
            part = panel if math.inf in (back, ahead) else panel.where(F.col("date").isin(need))
            marks = spark.createDataFrame([(d, signed[d][0], run) for d in todo], "date date, signature long, run int")
            replace_partitions(evaluate(part, {"v": formula}).join(F.broadcast(marks), "date"), path, ["date"])
        current = spark.createDataFrame([(d, s) for d, (s, _) in signed.items()], "date date, signature long")
        return spark.read.parquet(path).join(F.broadcast(current), ["date", "signature"], "left_semi").select("date", "di", "sym", "v", "run"), todo

"""Recurrences over the events of a key, as a stream with state and as a table.

The stream waits with each event until the watermark has passed it, so that events that come in any order within the
allowed lateness are taken in the order of their times (ties by id); later ones are dropped, as the watermark rules.
State of a key is its last value and the events still waiting; once a key has been idle for a while of event time its
state is given up. The batch forms compute the same with windows: a row whose predecessor is further back than the idle
time begins anew. A key's events are one task's by the nature of a recurrence; its state stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.registry import decayed
from ..operators.evaluation import run_stages

#: A step takes the last value (None at the beginning) and an event's x and con, and gives the next last value and the
#: event's result.
Step = Callable[[float | None, float | None, bool | None], tuple[float | None, float | None]]


class Blend:
    """x where the condition holds or nothing was held; else what was held, moved by q towards x. An event without x or
    condition has no result and changes nothing."""

    def __init__(self, q: float):
        self.q = q

    def __call__(self, last, x, con):
        if x is None or con is None:
            return last, None
        last = x if con or last is None else (1 - self.q) * last + self.q * x
        return last, last


class Hold:
    """1 from an event whose condition holds until one where it fails, 0 before the first; an unknown one changes nothing."""

    def __call__(self, last, x, con):
        last = last if con is None else float(con)
        return last, last or 0.0


class Ordered(StatefulProcessor):
    """Runs a step over each key's events in the order of event time."""

    def __init__(self, step: Step, key: str, idle_us: int):
        self.step, self.key, self.idle_us = step, key, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double, us long")
        self.waiting = handle.getListState("waiting", "us long, id long, x double, con boolean")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["us"], r["id"], r["x"], r["con"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= reached]
        value, us = self.last.get() if self.last.exists() else (None, None)
        for at, i, x, con in ready:
            if us is not None and at - us > self.idle_us:
                value = None
            value, out = self.step(value, x, con)
            us = at
            yield Row(**{self.key: key[0], "id": i, "us": at, "out": out})
        rest = rows[len(ready) :]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        if rest:
            self._wake(rest[0][0])
        if us is not None:
            if not rest and us + self.idle_us < reached:
                self.last.clear()  # nothing that may still come goes on from it
            else:
                self.last.update((value, us))
                self._wake(us + self.idle_us + 1000)


def streamed(events: DataFrame, step: Step, key: str = "user_id", at: str = "ts", late: str = "1 hour", idle_days: float = 30) -> DataFrame:
    """events(key, id, at, x, con), a stream, to key, id, at, out; append mode, each event once it is past the watermark.
    The state store must be one that keeps timers (RocksDB)."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(key, F.col("id").cast("long").alias("id"), F.unix_micros(at).alias("us"), F.col("x").cast("double").alias("x"), "con", at)
    kind = rows.schema[key].dataType.simpleString()
    out = rows.groupBy(key).transformWithState(Ordered(step, key, int(idle_days * 86_400_000_000)), f"{key} {kind}, id long, us long, out double", "append", "eventTime")
    return out.select(key, "id", F.timestamp_micros("us").alias(at), "out")


def _anew(rows: DataFrame, key: str, at: str, idle_days: float) -> tuple[DataFrame, list[Column]]:
    """Rows with _stretch: its number among the stretches of a key that no idle time breaks."""
    order = Window.partitionBy(key).orderBy(at, "id")
    us = F.unix_micros(F.col(at).cast("timestamp"))
    gap = us - F.lag(us).over(order) > F.lit(int(idle_days * 86_400_000_000))
    df = rows.withColumn("_new", F.when(gap, 1).otherwise(0))
    return df.withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new"), [F.col(at), F.col("id")]


def blended(rows: DataFrame, q: float, key: str = "user_id", at: str = "ts", idle_days: float = 30) -> DataFrame:
    """Blend over a table, by windows: each run from one setting to the next is a geometric sum."""
    df, order = _anew(rows, key, at, idle_days)
    ok = F.col("x").isNotNull() & F.col("con").isNotNull()
    df = df.withColumn("_ok", ok)
    among = Window.partitionBy(key, "_stretch", "_ok").orderBy(*order)
    start = F.when(F.col("_ok") & (F.col("con") | (F.row_number().over(among) == 1)), 1).otherwise(0)
    df = df.withColumn("_start", start).withColumn("_run", F.sum("_start").over(among.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_stretch", "_ok", "_run").orderBy(*order)) - 1)
    own = {"v": F.when(F.col("_place") == 0, F.col("x")).otherwise(F.col("x") * q)}
    df, out = run_stages(df, _moved(own, 1 - q, key))
    return df.select(key, "id", at, F.when(F.col("_ok"), out).alias("out"))


def _moved(own, beta: float, key: str):
    moved = yield from decayed(own, beta, F.col("_place"), key, F.col("_stretch"), F.col("_ok"), F.col("_run"))
    return moved["v"]


def held(rows: DataFrame, key: str = "user_id", at: str = "ts", idle_days: float = 30) -> DataFrame:
    """Hold over a table: the last known condition of the stretch."""
    df, order = _anew(rows, key, at, idle_days)
    to_here = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(key, "id", at, F.coalesce(F.last(F.col("con").cast("double"), ignorenulls=True).over(to_here), F.lit(0.0)).alias("out"))

"""Structured Streaming forms: minute bars with late data, and the last state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def streaming_bars(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Minute bars per user of a stream of events(ts, user_id, value): each closes once no later event can reach it."""
    timed = events.withWatermark("ts", late).where("value IS NOT NULL")
    return timed.groupBy(F.window("ts", "1 minute").alias("w"), F.col("user_id").alias("sym")).agg(F.count("*").alias("volume"), F.min("value").alias("low"), F.max("value").alias("high")).select(F.col("w.start").alias("minute"), "sym", "volume", "low", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions per user, from events apart by less than the gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def sliding(events: DataFrame, length: str = "5 days", step: str = "1 day", late: str = "1 day", keys: list[str] = ["event_type"]) -> DataFrame:
    """Counts and sums of events(ts, value, keys) over overlapping windows; a window of a stream closes once no event that
    is still allowed can fall into it. An event is in length / step windows and is counted in each before the shuffle."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", length, step).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", "total", "most")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each event once, though it is delivered again. Of a stream, the first to come within the allowed lateness; keys are
    forgotten after that, so state stays bounded. Of a table, the one with the least ts."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in (*keys, "ts")]
    kept = events.groupBy(*keys).agg(F.min(F.struct("ts", *rest)).alias("_e"))
    return kept.select(*keys, "_e.*").select(*events.columns)

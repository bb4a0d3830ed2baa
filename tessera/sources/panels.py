"""Panels in long form: one row for each date and symbol of the calendar and universe, missing values NULL.

Row-based windows need every date to have its row, so facts are left-joined onto calendar x universe; both sides of
that product are small next to the facts (dates, symbols), and each date and symbol meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def densify(facts: DataFrame, date: str = "date", sym: str = "sym") -> DataFrame:
    """facts on every (date, symbol) pair, with di: the date's place in the calendar, from 0."""
    dates = facts.select(date).distinct()
    # counting over one row per date: the calendar is the smallest table there is
    calendar = dates.selectExpr(date, f"CAST(row_number() OVER (ORDER BY {date}) - 1 AS INT) AS di")
    symbols = facts.select(sym).distinct()
    return calendar.crossJoin(symbols).join(facts, [date, sym], "left")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def monthly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of monthly_panel that lineitem has: one scan."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (
        read(spark, sf_dir, "lineitem")
        .select(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("sym"), cents.alias("c"), F.col("l_quantity").cast("long").alias("q"))
        .groupBy("date", "sym").agg(F.sum("c").alias("c"), F.sum("q").alias("q"), F.count("*").alias("n"))
        .select("date", "sym", (F.col("c") / F.lit(65536.0)).alias("x"), F.col("q").cast("double").alias("y"), F.col("n").cast("double").alias("w"))
    )


def supplier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(F.col("s_suppkey").alias("sym"), F.col("n_regionkey").cast("int").alias("g"))


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month x supplier from lineitem: x revenue (cents / 65536), y quantity, w lines, g region, con (y >= 200)."""
    panel = densify(monthly_facts(spark, sf_dir)).join(supplier_groups(spark, sf_dir), "sym", "left")
    return panel.withColumn("con", F.col("y") >= 200)


#: The same panel for an independent engine.
MONTHLY_SQL = """
m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS sym,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 65536.0 AS x, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem GROUP BY 1, 2),
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS di FROM (SELECT DISTINCT date FROM m)),
gr AS (SELECT s_suppkey AS sym, CAST(n_regionkey AS INT) AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT cal.date, di, s.sym, CAST(x AS DOUBLE) AS x, y, w, g, y >= 200 AS con
  FROM cal CROSS JOIN (SELECT DISTINCT sym FROM m) s LEFT JOIN m ON m.date = cal.date AND m.sym = s.sym LEFT JOIN gr ON gr.sym = s.sym)"""


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, minute, sym): open, close, high, low of events' values in the minute, volume (count), amount (sum)."""
    e = read(spark, sf_dir, "events").where("value IS NOT NULL")
    at = F.struct("ts", "event_id", "value")
    bars = e.groupBy(F.to_date("ts").alias("date"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), F.col("user_id").alias("sym"))
    return bars.agg(F.min(at)["value"].alias("open"), F.max(at)["value"].alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").cast("double").alias("volume"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("amount4"))


MINUTE_SQL = """
b AS (SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute, user_id AS sym,
  arg_min(value, {'t': ts, 'e': event_id}) AS open, arg_max(value, {'t': ts, 'e': event_id}) AS close, max(value) AS high, min(value) AS low,
  CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS BIGINT) AS amount4
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""

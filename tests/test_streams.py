"""Streams against the same work on tables: out-of-order and late rows, restarts, state given up, repeated events."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.streaming import bars, recurrence

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, id long, ts timestamp, x double, con boolean"


@pytest.fixture
def stateful(spark):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def _events(seed=4, n=240):
    rng, at, rows = random.Random(seed), START, []
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 1, 7, 7, 20, 3000 if i % 60 == 59 else 5]))
        rows.append((rng.randrange(4), i, at, None if rng.random() < 0.1 else round(rng.uniform(0, 9), 3), rng.choice([True, False, False, None])))
    return rows


def _arrival(rows, seed=5, minutes=40):
    """Rows in an order of arrival in which none is more than so many minutes behind."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.uniform(0, minutes)))


def _run(spark, make, top, name, mode="append"):
    """All that has come so far, then an end; the checkpoint goes on from the time before."""
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{top}/{name}").option("checkpointLocation", f"{top}/c-{name}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def _deliver(spark, top, rows, parts):
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{top}/in")


def _plain(rows, step, idle):
    out, last, seen = {}, {}, {}
    for user, i, at, x, con in sorted(rows, key=lambda r: (r[2], r[1])):
        if user in seen and at - seen[user] > idle:
            last[user] = None
        seen[user] = at
        last[user], out[i] = step(last.get(user), x, con)
    return out


def test_recurrences_over_tables(spark):
    rows, idle = _events(), dt.timedelta(days=1)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for batch, step in ((recurrence.blended(table, 0.2, idle_days=1), recurrence.Blend(0.2)), (recurrence.held(table, idle_days=1), recurrence.Hold())):
        got, want = {r.id: r.out for r in batch.collect()}, _plain(rows, step, idle)
        assert got.keys() == want.keys()
        assert all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("which", ["blend", "hold"])
def test_streams_equal_tables_through_a_restart(stateful, which):
    spark, top = stateful, tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows, step = _events(6, 160), recurrence.Blend(0.2) if which == "blend" else recurrence.Hold()
    end = max(r[2] for r in rows)
    flush = (99, 10_000, end + dt.timedelta(days=9), 1.0, True)  # moves the watermark past all others
    arrived = _arrival(rows)
    make = lambda s: recurrence.streamed(s, step, late="1 hour", idle_days=1)
    _deliver(spark, top, arrived[:90], 3)
    _run(spark, make, top, "out")
    before = spark.read.parquet(f"{top}/out").count()
    _deliver(spark, top, arrived[90:], 2)
    _deliver(spark, top, [flush], 1)
    too_late = (1, 20_000, START, 5.0, True)
    _run(spark, make, top, "out")
    _deliver(spark, top, [too_late, (99, 10_001, end + dt.timedelta(days=30), 1.0, True)], 1)
    _run(spark, make, top, "out")
    got = {r.id: r.out for r in spark.read.parquet(f"{top}/out").collect()}
    assert 0 < before < len(rows) and 20_000 not in got
    table = spark.createDataFrame([*rows, flush], SCHEMA)
    batch = recurrence.blended(table, 0.2, idle_days=1) if which == "blend" else recurrence.held(table, idle_days=1)
    want = {r.id: r.out for r in batch.collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-9 for i in got)


def test_sliding_windows_of_a_stream(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = _events(7, 200)
    end = max(r[2] for r in rows)
    make = lambda s: bars.sliding(s.withColumn("value", F.col("x")), "2 hours", "30 minutes", "1 hour", ["user_id"])
    _deliver(spark, top, _arrival(rows), 4)
    _deliver(spark, top, [(99, 1, end + dt.timedelta(days=9), 1.0, True)], 1)
    _run(spark, make, top, "out")
    _deliver(spark, top, [(1, 2, START, 5.0, True)], 1)  # too late for any window
    _run(spark, make, top, "out")
    shown = lambda df: sorted(str(tuple(r)) for r in df.withColumn("total", F.round("total", 6)).collect())
    got = shown(spark.read.parquet(f"{top}/out"))
    assert got == shown(make(spark.createDataFrame(rows, SCHEMA))) and got


def test_repeated_events_of_a_stream(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = _events(8, 120)
    again = [(u, i, at + dt.timedelta(minutes=i % 20), x, con) for u, i, at, x, con in rows if i % 3 == 0]
    _deliver(spark, top, _arrival(rows + again, minutes=15), 5)
    make = lambda s: bars.first_of_each(s, ["id"], "1 hour")
    _run(spark, make, top, "out")
    _deliver(spark, top, [r for r in rows if r[1] == 117], 1)  # delivered once more, after a restart
    _run(spark, make, top, "out")
    got = [r.id for r in spark.read.parquet(f"{top}/out").collect()]
    assert sorted(got) == [r[1] for r in rows]
    table = bars.first_of_each(spark.createDataFrame(rows + again, SCHEMA), ["id"])
    assert sorted(tuple(r) for r in table.select("id", "ts").collect()) == sorted((i, at) for _, i, at, *_ in rows)

import datetime
import math
import tempfile

from pyspark.sql import functions as F

from tessera.operators import asof, evaluation, quality, similarity, store, styles, weights
from tessera.plans.infix import parse_infix
from tessera.streaming.bars import streaming_bars


def test_greedy_matches_sequential(spark):
    ids = range(12)
    corr = {(a, b): ((a * 7 + b * 13) % 10) / 10 for a in ids for b in ids if a < b}
    score = {i: float((i * 5) % 7) for i in ids}
    kept = []
    for i in sorted(ids, key=lambda i: (-score[i], i)):
        if all(corr[min(i, k), max(i, k)] <= 0.6 for k in kept):
            kept.append(i)
    corrs = spark.createDataFrame([(a, b, c) for (a, b), c in corr.items()], "a int, b int, corr double")
    ranked = spark.createDataFrame(list(score.items()), "id int, score double")
    assert sorted(r.id for r in store.greedy_independent(ranked, corrs, 0.6).collect()) == sorted(kept)


def test_capped_weights(spark):
    w = spark.createDataFrame([(0, i, v) for i, v in enumerate([50.0, 20.0, 10.0, 10.0, 5.0, 5.0])], "key int, id int, w double")
    got = {r.id: r.w for r in store.capped_weights(w, "key", 0.3).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got.values()) <= 0.3 + 1e-9
    assert got[0] == 0.3 and abs(got[2] - got[3]) < 1e-12


def test_greedy_decides_long_chains(spark, monkeypatch):
    monkeypatch.setattr(store, "LAST_PAIRS", 60)  # so that rounds and the last pairs both take part
    corrs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(200)], "a int, b int, corr double")
    ranked = spark.createDataFrame([(i, float(-i)) for i in range(201)] + [(500, 1.0)], "id int, score double")
    assert sorted(r.id for r in store.greedy_independent(ranked, corrs, 0.6).collect()) == [*range(0, 201, 2), 500]


def test_caps_by_rounds(spark):
    rows = [(k, i, float((i * 37 + k * 11) % 101 + (i < 40) * 5000 / (i + 1))) for k in range(3) for i in range(60)] + [(3, 0, 0.0), (3, 1, 0.0), (4, 0, 5.0), (4, 1, 1.0)]
    got = {(r.key, r.id): r.w for r in store.capped_weights(spark.createDataFrame(rows, "key int, id int, w double"), "key", 0.03).collect()}
    for key in range(5):
        w = {i: v for k, i, v in rows if k == key}
        total = sum(w.values())
        now, fixed = {i: v / total if total else 0.0 for i, v in w.items()}, set()
        while over := {i for i, v in now.items() if i not in fixed and v >= 0.03}:
            fixed |= over
            free = sum(w[i] for i in w if i not in fixed)
            now = {i: 0.03 if i in fixed else w[i] * max(0.0, 1 - 0.03 * len(fixed)) / free for i in w}
        assert all(abs(got[key, i] - v) < 1e-9 for i, v in now.items())


def test_sign_test_is_exact(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (3, 10), (5, 10), (9, 10), (40, 100)], "k int, n int")
    got = {(r.k, r.n): r.p for r in df.select("k", "n", quality.sign_test(F.col("k"), F.col("n")).alias("p")).collect()}
    assert got.pop((0, 0)) is None
    for (k, n), p in got.items():
        assert abs(p - min(1.0, 2 * sum(math.comb(n, j) for j in range(min(k, n - k) + 1)) / 2**n)) < 1e-9


def test_runs_of_periods(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in enumerate([1, 1, 0, None, 2, 3])], "k string, y int, v int")
    assert [r.run for r in weights.consecutive(df, "k", "y", "v").orderBy("y").collect()] == [1, 2, 0, 0, 1, 2]


def test_holdings_by_loop(spark):
    rows = [(1, i, t, b, s) for i, (t, b, s) in enumerate([(True, False, True), (True, True, True), (False, True, False), (False, True, True), (True, True, False), (False, False, False)])]
    df = spark.createDataFrame(rows, "sym int, di int, target boolean, buyable boolean, sellable boolean")
    want, held = [], 0
    for _, _, t, b, s in rows:
        held = 1 if t and b else 0 if not t and s else held
        want.append(held)
    assert [r.held for r in evaluation.holdings(df).orderBy("di").collect()] == want


def test_asof_carries_null_events(spark):
    left = spark.createDataFrame([(1, 1), (1, 3), (1, 5), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 7.0), (1, 4, None)], "k int, t int, v double")
    got = {(r.k, r.t): r.v for r in asof.backward(left, right, "k", "t", ["v"]).collect()}
    assert got == {(1, 1): None, (1, 3): 7.0, (1, 5): None, (2, 1): None}


def test_next_date_is_strict(spark):
    d = datetime.date
    cal = spark.createDataFrame([(d(2024, 1, 5),), (d(2024, 1, 10),)], "date date")
    ev = spark.createDataFrame([(d(2024, 1, 1),), (d(2024, 1, 5),), (d(2024, 1, 9),), (d(2024, 1, 10),)], "at date")
    got = {r.at: r.effective for r in asof.next_date(ev, "at", cal).collect()}
    assert got == {d(2024, 1, 1): d(2024, 1, 5), d(2024, 1, 5): d(2024, 1, 10), d(2024, 1, 9): d(2024, 1, 10), d(2024, 1, 10): None}


def test_sampling_is_reproducible(spark):
    jobs = spark.range(100).withColumn("w", F.col("id") + 1.0)
    a = [r.id for r in store.sampled(jobs, "id", "w", 10).collect()]
    assert a == [r.id for r in store.sampled(jobs.repartition(3), "id", "w", 10).collect()] and len(set(a)) == 10


def test_top_k_in_blocks(spark):
    v = spark.range(40).select("id", F.array(*(F.sin(F.col("id") * (k + 1)).cast("float") for k in range(4))).alias("v"))
    q = v.where("id % 10 = 0").select(F.col("id").alias("qid"), "v")
    one = similarity.top_k(q, v).orderBy("qid", "rank").collect()
    assert one == similarity.top_k(q, v, queries_bytes=64).orderBy("qid", "rank").collect()


def test_top_k_matches_all_pairs(spark):
    v = {i: [math.sin(i * (k + 1)) for k in range(4)] for i in range(60)} | {60: [0.0] * 4, 61: [1.0], 62: None, 63: [math.sin(k + 1) for k in range(4)]}
    base = spark.createDataFrame(list(v.items()), "id long, v array<double>").repartition(3)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    got = {}
    for r in similarity.top_k(base.where("id % 5 = 0 OR id > 60").select(F.col("id").alias("qid"), "v"), base, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    for q in [i for i in v if (i % 5 == 0 or i > 60) and v[i] and len(v[i]) == 4 and any(v[i])]:
        near = sorted((-round(cos(v[q], v[i]), 12), i) for i in v if i != q and v[i] and len(v[i]) == 4 and any(v[i]) and cos(v[q], v[i]) > 0)
        assert got.get(q, []) == [i for _, i in near[:3]]


def test_streaming_bars(spark):
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    t = datetime.datetime(2024, 1, 1, 9, 30)
    rows = [(t + datetime.timedelta(seconds=20 * i), i % 2, float(i)) for i in range(30)]
    events = spark.createDataFrame(rows, "ts timestamp, user_id long, value double")
    events.write.parquet(f"{top}/in")
    stream = streaming_bars(spark.readStream.schema(events.schema).parquet(f"{top}/in"))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", f"{top}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(volume) FROM bars").first()[0] == 30


def test_buffered_book_by_loop(spark):
    ranks = {0: [3, 1, 4, 2, 5], 1: [1, 5, 2, 6, 3], 2: [5, 6, 4, 1, 2]}
    df = spark.createDataFrame([(d, i, r + 1) for d, ids in ranks.items() for r, i in enumerate(ids)], "di int, id long, rank int")
    held, want = [], set()
    for d, ids in ranks.items():
        near = ids[:4]
        kept = [i for i in near if i in held]
        held = (kept + [i for i in near if i not in kept])[:2]
        want |= {(d, i) for i in held}
    assert {tuple(r) for r in styles.buffered(df, 2, 4).collect()} == want


def test_infix_text():
    assert parse_infix("-a * (b + 2) >= RANK(c)").text() == "ge(mul(neg(a),add(b,2)),RANK(c))"
    assert parse_infix("x ** 2 if a > b else $y").text() == "WHERE(GT(a,b),power(x,2),y)"

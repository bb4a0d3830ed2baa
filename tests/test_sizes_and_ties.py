"""Equal values to the last digit, and steps whose cost must not outgrow their input."""

import itertools
import math
import random
import statistics
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from conftest import SF
from same import assert_same

from tessera import function_queries, history_queries, market_queries
from tessera.operators import evaluation, minute, similarity, store, weights


def test_score_divides_doubles(spark, tmp_path):
    part = spark.createDataFrame([(k, k % 51, 900.0 + k / 7) for k in range(1, 400)], "p_partkey long, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.score for r in market_queries.eval_score(spark, str(tmp_path)).collect()}
    squashed = lambda k, v: 1 / (1 + math.exp(-(v - evaluation.SCORED[k][0]) / evaluation.SCORED[k][1]))
    for k, size, price in part.collect():
        m = {"long_ret": size / 200, "long_netret": k % 13 / 100, "ls_ir": price / 400, "ls_netir": price / 900 if size % 7 else 0, "rankic": size % 10 / 150, "rankicir": size / 9, "mono": k % 20 / 100, "monoir": k % 9 / 10}
        s = {c: squashed(c, v) for c, v in m.items()}
        want = (s["long_ret"] + s["long_netret"]) / 4 + (s["ls_ir"] + s["ls_netir"] + s["rankic"] + s["rankicir"] + s["mono"] + s["monoir"]) / 12
        assert abs(got[k] - want) < 5.1e-7


def test_state_mask_adds_in_the_order_of_minutes(spark):
    # 0.1 + 0.2 + 0.3 is above 0.3 + 0.2 + 0.1, whatever order the rows come in
    bars = [(m, s, v) for s, day in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1)), (3, (0.0, 0.0, 0.0))) for m, v in enumerate(day)]
    for turn in (1, -1):
        df = spark.createDataFrame([("d", m, s, v) for m, s, v in bars[::turn]], "date string, minute int, sym int, close double").coalesce(1)
        assert {r.sym for r in minute.state_mask(df, "close", 0.4, 0.6).collect()} == {2}
        assert {r.sym for r in minute.state_mask(df, "close", 0.9, 1.0).collect()} == {1}


def _plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_capped_weights_sum_from_one_end(spark):
    """A frame up to the end is summed anew for each row: as the square of a key's members."""
    w = spark.createDataFrame([(1, k, 1.0 + k % 7) for k in range(3000)], "key int, id int, w double")
    out = store.capped_weights(w, "key", 0.00034)
    assert "specifiedwindowframe(rowframe, currentrow$(), unboundedfollowing$())" not in _plan(out)
    a = sorted(((1.0 + k % 7, k) for k in range(3000)), key=lambda x: (-x[0], x[1]))
    rest, cut = sum(v for v, _ in a), 0
    while cut < len(a) and a[cut][0] * max(1 - cut * 0.00034, 0) / rest >= 0.00034:
        rest, cut = rest - a[cut][0], cut + 1
    want = {k: 0.00034 if i < cut else v * max(1 - cut * 0.00034, 0) / rest for i, (v, k) in enumerate(a)}
    assert 0 < cut and all(math.isclose(r.w, want[r.id], rel_tol=1e-9, abs_tol=1e-12) for r in out.collect())


def test_steps_do_not_gather_edges(spark):
    """Neither are repeated edges made distinct, nor is a step made again by the next."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3), (3, 4), (4, 5), (1, 2), (1, None), (7, 8)], "a long, b long")
    out = similarity.within_steps(edges, spark.createDataFrame([(1,), (1,)], "node long"), 3)
    assert "aggregate" not in _plan(out) and "join" not in _plan(out)
    want = {(1, 0), (2, 1), (None, 1), (3, 2), (4, 3)}
    assert {(r.node, r.steps) for r in out.collect()} == want and out.count() == len(want)


def test_pairs_of_one_kind_are_dealt_out(spark, monkeypatch):
    """The pairs of small inputs, one kind among them with nearly all, leave from several tasks and none is lost."""
    monkeypatch.setattr(weights, "TASK_PAIRS", 50)
    rows = [(k, "x" if k else None) for k in range(61)] + [(k, "y") for k in range(61, 64)] + [(5, "y"), (5, "x")]
    df = spark.createDataFrame(rows, "id long, kind string").coalesce(1)
    pairs = lambda a, b: sorted((x, k, y) for x, k in a for y, j in b if k is not None and k == j)
    out = weights.inner_pairs(df, "kind")
    assert sorted(tuple(r) for r in out.select("a", "kind", "b").collect()) == [p for p in pairs(rows, rows) if p[0] < p[2]]
    made = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 10 and max(r["count"] for r in made) < 500
    some = [r for r in rows if r[0] % 3 == 0]
    assert sorted(tuple(r) for r in weights.cross_pairs(df, df.where("id % 3 = 0"), "kind").select("a", "kind", "b").collect()) == pairs(rows, some)
    assert weights.cross_pairs(df.where("id < 0"), df, "kind").count() == 0


def test_pair_correlations_by_blocks(spark, monkeypatch):
    """Series meet in blocks, never date by date; gaps, constants and a large common level change no pair."""
    monkeypatch.setattr(store, "BLOCK_IDS", 5)
    rng = random.Random(4)
    series = {k: {d: (1e9 if k % 3 == 0 else 0) + rng.gauss(0, 1) for d in range(12) if rng.random() < 0.7} for k in range(17)} | {17: {d: 2.5 for d in range(12)}, 18: {3: 1.0, 4: 2.0}, 19: {11: 1.0}}
    rows = [(k, d, v) for k, days in series.items() for d, v in days.items()] + [(3, 50, None), (None, 1, 1.0), (4, 60, float("nan"))]
    out = store.pair_correlations(spark.createDataFrame(rows, "id int, di int, v double").repartition(3))
    assert "join" not in _plan(out) and dict(out.dtypes)["a"] == "int"
    got = {(r.a, r.b): r for r in out.collect()}
    want = {}
    for a, b in itertools.combinations(sorted(series), 2):
        x, y = zip(*both) if (both := [(series[a][d], series[b][d]) for d in series[a] if d in series[b]]) else ((), ())
        if x:
            want[a, b] = (len(x), statistics.correlation(x, y) if min(x) < max(x) and min(y) < max(y) else None)
    assert got.keys() == want.keys() and len(got) == out.count()
    for k, (n, c) in want.items():
        assert got[k].days == n and (got[k]["corr"] is None if c is None else math.isclose(got[k]["corr"], c, abs_tol=1e-6)), k


def test_search_holds_one_piece_at_a_time():
    """A batch is compared in pieces, and what it sends on holds every query's best."""
    rng = np.random.default_rng(1)
    base = np.repeat(rng.normal(size=(4000, 8)), 3, axis=0)  # ties
    unit = base / np.sqrt((base * base).sum(1))[:, None]
    qid = np.arange(0, 12000, 20)
    batch = pa.record_batch({"id": np.arange(12000), "v": pa.FixedSizeListArray.from_arrays(base.ravel(), 8).cast(pa.list_(pa.float64()))})
    tracemalloc.start()
    sent = list(similarity._near(SimpleNamespace(value=(qid, unit[qid])), 5, 0.0)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    got = {(q, i) for b in sent for q, i in zip(b["qid"].to_pylist(), b["id"].to_pylist())}
    for q in qid[::7].tolist():
        s = np.round(unit @ unit[q], 12)
        s[q] = -1
        assert {(q, i) for i in np.nonzero(s >= np.sort(s)[-5])[0].tolist()} <= got


def test_nested_ranks_equal_correlations_alike(spark, tmp_path):
    """Suppliers whose ranks move alike from month to month have one correlation, but sums that differ in the last digit."""
    many = 60
    rows = [(s, f"1995-0{t + 1}-15", (s + x) % many, (s + y) % many) for s in range(many) for t, (x, y) in enumerate(((0, 0), (1, 2), (3, 1)))]
    lines = spark.createDataFrame(rows, "l_suppkey long, day string, x int, y int")
    tables = {
        "lineitem": lines.selectExpr("l_suppkey", "CAST(day AS timestamp) AS l_shipdate", "x + 1.0D AS l_extendedprice", "y + 1.0D AS l_quantity"),
        "supplier": spark.createDataFrame([(s, 0) for s in range(many)], "s_suppkey long, s_nationkey int"), "nation": spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int"),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert_same(function_queries.QUERIES["fn_nested"](spark, str(tmp_path)), con.execute(function_queries.ORACLES["fn_nested"]))


def _plain_corr(x, y):
    both = sorted(x.keys() & y.keys())
    a, b = [x[d] for d in both], [y[d] for d in both]
    return statistics.correlation(a, b) if both and min(a) < max(a) and min(b) < max(b) else None


@pytest.mark.parametrize("front", [7, 4096])
def test_sweep_of_series_compares_with_kept_ones_only(spark, monkeypatch, front):
    """Gaps, constants, equal series, a large common level and sides that hardly vary: as plain loops over all pairs."""
    for name, size in (("FRONT_IDS", front), ("FRONT_BLOCK", 3), ("BLOCK_IDS", 4)):
        monkeypatch.setattr(store, name, size)
    rng = random.Random(front)
    series = {k: {d: (1e6 if k % 5 == 0 else 0) + rng.gauss(0, 1) for d in range(14) if rng.random() < 0.8} for k in range(60)}
    series |= {60 + k: dict(series[k]) for k in range(15)} | {80: {d: 2.5 for d in range(14)}, 81: {3: 1.0, 4: 2.0}, 82: {11: 1.0}, 83: {d: 1e7 if d == 13 else d * d % 5 + 0.0 for d in range(14)}, 84: {d: -d * d % 5 + 0.0 for d in range(13)}}
    rows = [(k, d, v) for k, days in series.items() for d, v in days.items()] + [(3, 50, None), (None, 1, 1.0), (4, 60, float("nan"))]
    rng.shuffle(rows)
    least, least_ir, most = [-0.5, 0.0, 0.2], [None, 0.1], [-0.2, 0.3, 0.8]
    packed = store.packed_series(spark.createDataFrame(rows, "id long, di int, v double").repartition(3))
    stats = {r.id: (r.rankic, r.rankicir) for r in packed.collect()}
    assert stats.keys() == series.keys() and all(stats[60 + k][0] == stats[k][0] for k in range(15))
    for k, days in series.items():
        mean, spread = statistics.fmean(days.values()), statistics.stdev(days.values()) if len(days) > 1 else None
        want_ir = None if spread is None else mean / spread if spread else math.inf
        assert math.isclose(stats[k][0], mean, rel_tol=1e-12, abs_tol=1e-12) and (stats[k][1] is None if want_ir is None else math.isclose(stats[k][1], want_ir, rel_tol=1e-6)), k
    summary, picks = store.series_sweep(packed, least, least_ir, most)
    got, shown = {}, {(r.least, r.least_ir, r.most_corr): r for r in summary.collect()}
    for r in picks.collect():
        got.setdefault((r.least, r.least_ir, r.most_corr), []).append(r.id)
    corr = {(a, b): _plain_corr(series[a], series[b]) for a in series for b in series if a != b}
    for t, ir, m in itertools.product(least, least_ir, most):
        kept = []
        for i in sorted(series, key=lambda i: (-stats[i][0], i)):
            if stats[i][0] >= t and (ir is None or (stats[i][1] is not None and stats[i][1] >= ir)) and not any(corr[i, k] is not None and corr[i, k] > m for k in kept):
                kept.append(i)
        assert sorted(got.get((t, ir, m), [])) == sorted(kept), (t, ir, m)
        apart, row = [c for a, b in itertools.combinations(kept, 2) if (c := corr[a, b]) is not None], shown[t, ir, m]
        assert row["count"] == len(kept) and (row.max_pair_corr is None if not apart else math.isclose(row.max_pair_corr, max(apart), abs_tol=1e-6) and math.isclose(row.avg_pair_corr, statistics.fmean(apart), abs_tol=1e-6)), (t, ir, m)
    summary, picks = store.series_sweep(packed.where("id < 0"), least, least_ir, most)
    assert [r["count"] for r in summary.collect()] == [0] * 18 and picks.count() == 0


def _no_pairs(*_):
    raise AssertionError("correlations of all pairs")


def test_sweep_makes_no_pairs_of_all_series(spark, duck, monkeypatch):
    monkeypatch.setattr(store, "pair_correlations", _no_pairs)
    assert_same(history_queries.QUERIES["store_sweep"](spark, SF), duck.execute(history_queries.ORACLES["store_sweep"]))


def test_sweep_picks_the_first_of_equal_suppliers_without_pairs(spark, tmp_path, monkeypatch):
    """Suppliers that sell alike have one mean, and their ids decide; SQL in one thread, which adds all their months in one order."""
    monkeypatch.setattr(store, "pair_correlations", _no_pairs)
    rng = random.Random(2)
    kinds = [[rng.randint(1, 50) for _ in range(12)] for _ in range(20)]
    rows = [(s, f"1995-{m + 1:02d}-15", float(q)) for s in range(120) for m, q in enumerate(kinds[s * 7 % 20])]
    rng.shuffle(rows)
    tables = {
        "lineitem": spark.createDataFrame(rows, "l_suppkey long, day string, l_quantity double").selectExpr("l_suppkey", "CAST(day AS timestamp) AS l_shipdate", "l_quantity * 100 AS l_extendedprice", "l_quantity").repartition(5),
        "supplier": spark.createDataFrame([(s, 0) for s in range(120)], "s_suppkey long, s_nationkey int"), "nation": spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int"),
    }
    con = duckdb.connect(config={"threads": 1})
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    picks = history_queries.QUERIES["store_sweep_picks"](spark, str(tmp_path))
    assert_same(picks, con.execute(history_queries.ORACLES["store_sweep_picks"]))
    ids = {r.id for r in picks.collect()}
    assert ids and all(i < 20 for i in ids)


def test_sweep_reads_lines_once(spark, tmp_path, monkeypatch):
    """The months' quantities come from one scan of lineitem, and a supplier listed twice counts as in the panel."""
    for name in ("lineitem", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    supplier = spark.read.parquet(f"{SF}/supplier.parquet")
    supplier.unionByName(supplier.where("s_suppkey = 3")).write.parquet(f"{tmp_path}/supplier.parquet")
    con, scans, written = duckdb.connect(), [], history_queries.tables_written
    for name in ("lineitem", "nation", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")

    def noted(df, name):
        scans.append(_plan(df).split("== physical plan ==")[-1].count("filescan parquet [l_"))
        return written(df, name)

    monkeypatch.setattr(history_queries, "tables_written", noted)
    summary = history_queries.QUERIES["store_sweep"](spark, str(tmp_path))
    assert sum(scans) == 1, scans
    assert_same(summary, con.execute(history_queries.ORACLES["store_sweep"]))

"""Tables with history against plain loops: filings, incremental runs, stores, streams, selections, portfolios, clusters."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bitemporal, crossday, incremental, minute, portfolios, similarity, store, universes
from tessera.plans.formula import evaluate
from tessera.sources import tables

FIELDS = bitemporal.FLOWS + bitemporal.STOCKS


def plain_fundamentals(rows):
    """State by state: each day's filings replace their periods, then every figure is read from the state."""
    out = []
    for firm in sorted({r[0] for r in rows}):
        state = {}
        for day in sorted({r[2] for r in rows if r[0] == firm}):
            for r in sorted((r for r in rows if r[0] == firm and r[2] == day), key=lambda r: (r[1], [(-1e300 if v is None else v) for v in r[3:]])):
                state[r[1]] = dict(zip(FIELDS, r[3:]))
            latest = max(state)

            def single(p, f):
                v = state.get(p, {}).get(f)
                if v is None or p % 4 == 0:
                    return v
                before = state.get(p - 1, {}).get(f)
                return None if before is None else v - before

            def yearly(p, f):
                parts = [single(p - i, f) for i in range(4)]
                return None if None in parts else sum(parts)

            def ratio(a, b, low, high):
                return None if a is None or b is None or b == 0 else max(min(a / b, high), low)

            def growth(a, b, low, high, positive=False):
                return None if a is None or b is None or b == 0 else max(min((a - b) / (abs(b) if positive else b), high), low)

            stock = lambda p, f: state.get(p, {}).get(f)
            y = {(f, k): yearly(latest - k, f) for f in bitemporal.FLOWS for k in (0, 4)}
            roes = [ratio(yearly(latest - k, "profit"), stock(latest - k, "equity"), -5, 5) for k in range(20)]
            some = [r for r in roes if r is not None][:12]
            roe, cost, cost4 = ratio(y["profit", 0], stock(latest, "equity"), -2, 2), ratio(y["cost", 0], y["revenue", 0], 0, 5), ratio(y["cost", 4], y["revenue", 4], 0, 5)
            minus = lambda a, b: None if a is None or b is None else a - b
            out.append((firm, day, latest, *(y[f, 0] for f in bitemporal.FLOWS), *(stock(latest, f) for f in bitemporal.STOCKS), roe, minus(roe, roes[4]), -statistics.stdev(some) if len(some) >= 8 else None,
                ratio(y["operating", 0], y["revenue", 0], -5, 5), ratio(y["operating", 0], stock(latest, "debt"), -5, 5), ratio(stock(latest, "debt"), stock(latest, "assets"), 0, 2), growth(stock(latest, "assets"), stock(latest - 4, "assets"), -2, 10),
                growth(y["revenue", 0], y["revenue", 4], -2, 10), growth(y["profit", 0], y["profit", 4], -3, 10, True), ratio(y["profit", 0], y["revenue", 0], -5, 5), ratio(y["revenue", 0], stock(latest, "assets"), 0, 20), cost, minus(cost, cost4), ratio(stock(latest, "long_debt"), stock(latest, "debt"), 0, 1)))
    return out


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def filings(seed=1, firms=4):
    rng, rows = random.Random(seed), []
    for firm in range(firms):
        for period in range(8000, 8040):
            if rng.random() < 0.06:
                continue  # never filed
            day = dt.date(2000, 1, 1) + dt.timedelta(days=(period - 8000) * 91 + rng.randrange(20, 200))
            for _ in range(1 + (rng.random() < 0.4) + (rng.random() < 0.1)):
                rows.append((firm, period, day, *(None if rng.random() < 0.03 else float(rng.randrange(-50, 400)) for _ in FIELDS)))
                day += dt.timedelta(days=rng.choice([0, 0, 30, 400]))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "firm long, period long, known date, " + ", ".join(f"{f} double" for f in FIELDS))


def test_filings_as_known_on_each_day(spark):
    # of several filings of one period on one day the greatest stays, as the loop has it
    rows = filings()
    got = sorted(map(tuple, bitemporal.fundamentals(table(spark, rows).repartition(5), ["firm"]).collect()))
    want = sorted(plain_fundamentals(rows), key=lambda r: r[:2])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(close, a, b)), (a, b)
    assert bitemporal.fundamentals(table(spark, []), ["firm"]).count() == 0


def test_filings_meet_in_one_shuffle(spark):
    df = bitemporal.fundamentals(table(spark, filings()), ["firm"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_panel_shows_nothing_before_it_is_known(spark):
    rows = filings(2, 2)
    events = bitemporal.fundamentals(table(spark, rows), ["firm"])
    start = dt.date(2000, 1, 3)
    trading = [start + dt.timedelta(days=k) for k in range(4200) if (start + dt.timedelta(days=k)).weekday() < 5]
    calendar = spark.createDataFrame([(d,) for d in trading], "date date")
    days = spark.createDataFrame([(f, d) for f in range(2) for d in trading[::40]], "firm long, date date")
    got = {(r.firm, r.date): (r.known, r.roe) for r in bitemporal.panel(events, days, "firm", "known", calendar, ["roe"]).collect()}
    plain = plain_fundamentals(rows)
    for firm, day in got:
        seen = [(known, roe) for f, known, roe in ((p[0], p[1], p[11]) for p in plain) if f == firm and known < day]
        want = max(seen, key=lambda s: s[0]) if seen else (None, None)
        assert got[firm, day][0] == want[0] and close(got[firm, day][1], want[1])


def test_an_update_needs_the_last_filings_only(spark):
    rows = filings(3)
    day = dt.date(2007, 6, 1)
    whole = table(spark, rows)
    part = bitemporal.condensed(whole, ["firm"], "period", "known", FIELDS, day)
    assert part.count() < whole.count()
    shown = lambda df: sorted(map(tuple, bitemporal.fundamentals(df, ["firm"]).where(F.col("known") >= F.lit(day)).collect()))
    assert str(shown(part)) == str(shown(whole))


GROWING = {
    "a": "ts_mean(x,6)", "b": "ts_delay(diff_q(x),-2)", "c": "cs_zscore(ts_delta(x,3))", "d": "group_rank(neg(ts_corr(x,y,5)),g)", "e": "wma(x,1,2,3)", "f": "TS_SKEW(x,7)", "g": "DECAYLINEAR(x,6)", "h": "ts_cut(x,y,8)", "i": "stability(x,6,3)",
}
ENDLESS = {"a": "EMA(x,6)", "b": "trade_when(x,con)", "c": "hold_when(x,con)", "d": "RSI(x,6)", "e": "ADX(add(x,y),sub(x,y),x,4)", "f": "PERCENTILE(x,0.25)", "g": "MACD(x,3,6)"}


def _panel(spark, dates=60, syms=9):
    rng = random.Random(3)
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(days=k), k, s, *(None if rng.random() < 0.1 else rng.uniform(1, 9) for _ in range(2)), s % 3, rng.random() < 0.4) for k in range(dates) for s in range(syms)]
    return spark.createDataFrame(rows, "date date, di int, sym long, x double, y double, g int, con boolean")


def _same(a, b):
    shown = lambda df: {tuple(r[:3]): tuple(r[3:]) for r in df.collect()}
    a, b = shown(a), shown(b)
    assert a.keys() == b.keys()
    for k in a:
        assert all(close(None if x is None else float(x), None if y is None else float(y)) for x, y in zip(a[k], b[k])), (k, a[k], b[k])


def test_incremental_tables_equal_full_ones(spark):
    panel = _panel(spark).cache()
    for formulas, finite in ((GROWING, True), (ENDLESS, False)):
        source, target = tables.fresh_path(spark, "panel"), tables.fresh_path(spark, "values")
        doubled = panel.withColumn("x", F.when(F.col("di") >= 40, F.col("x") * 2).otherwise(F.col("x")))
        tables.replace_partitions(doubled.where("di < 45"), source, ["date"])
        first = incremental.refresh_formulas(spark, source, target, formulas)
        assert first.dates_read == 45
        tables.replace_partitions(panel.where("di >= 40"), source, ["date"])
        run = incremental.refresh_formulas(spark, source, target, formulas, dt.date(2020, 2, 10))
        assert run.dates_read == (60 - 38 + 8 if finite else 60) and run.merged_from == (dt.date(2020, 2, 8) if finite else dt.date(2020, 1, 1) if "PERCENTILE" in str(formulas) else dt.date(2020, 2, 10))
        _same(spark.read.parquet(target).select("date", "di", "sym", *formulas), evaluate(panel, formulas))
        assert incremental.refresh_formulas(spark, source, target, formulas) == incremental.Refreshed()
        if finite:
            read = spark.read.parquet(source).where(F.col("date") >= F.lit(run.read_from))
            plan = read._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(date" in plan and "DataFilters: []" in plan, plan


def test_result_store_computes_what_is_new_or_changed(spark):
    panel = _panel(spark)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    store = incremental.ResultStore(tables.fresh_path(spark, "results"))
    formula = "ts_mean(ts_delay(x,-1),4)"
    got, todo = store.run(panel.where("di < 50"), formula)
    assert todo == [day(k) for k in range(50)]
    _same(got.drop("run"), evaluate(panel.where("di < 50"), {"v": formula}))
    got, todo = store.run(panel, formula)  # the last date looked ahead at nothing before
    assert todo == [day(k) for k in range(49, 60)]
    _same(got.drop("run"), evaluate(panel, {"v": formula}))
    assert store.run(panel.orderBy(F.rand(1)), formula)[1] == []
    changed = panel.withColumn("x", F.when((F.col("di") == 20) & (F.col("sym") == 3), 100.0).otherwise(F.col("x"))).withColumn("y", F.col("y") + 1)
    got, todo = store.run(changed, formula)  # y is no input of it
    assert todo == [day(k) for k in range(19, 25)]
    _same(got.drop("run"), evaluate(changed, {"v": formula}))
    assert len(store.run(changed, formula, version="2")[1]) == 60
    assert len(store.run(changed, "ema1(x,5)")[1]) == 60 and store.run(panel.where("di <> 20 OR sym <> 3"), "ema1(x,5)")[1] == [day(k) for k in range(20, 60)]


def test_tables_are_written_merged_and_deleted(spark):
    path = tables.fresh_path(spark, "rows")
    rows = [(k, k % 4 if k % 5 else None, f"t{k}", 1) for k in range(40)]
    schema = "id long, part int, text string, version int"
    tables.replace_partitions(spark.createDataFrame(rows, schema), path, ["part"])
    files = lambda: {r[0] for r in spark.read.schema(schema).parquet(path).where("part = 1").select(F.input_file_name()).collect()}
    before = files()
    tables.merge(spark, path, spark.createDataFrame([(2, 2, "new", 2), (100, 2, "more", 2), (6, 2, "old", 0)], schema), ["id"], "version", ["part"])
    want = {r[0]: r[:3] for r in rows} | {2: (2, 2, "new"), 100: (100, 2, "more")}
    shown = lambda: {r.id: (r.id, r.part, r.text) for r in spark.read.schema(schema).parquet(path).collect()}
    assert shown() == want and files() == before
    tables.delete(spark, path, F.col("part").isNull() | (F.col("part") == 3) | (F.col("id") == 2), ["part"])
    assert shown() == {k: v for k, v in want.items() if v[1] not in (None, 3) and k != 2}
    assert files() == before


def _greedy(ids, near):
    kept = []
    for i in ids:
        if not near.get(i, set()) & set(kept):
            kept.append(i)
    return kept


def _graph(seed, n=160):
    rng = random.Random(seed)
    stats = [(i, round(rng.uniform(-1, 1), 2) if rng.random() < 0.9 else 0.5, None if rng.random() < 0.05 else round(rng.uniform(-1, 1), 3)) for i in range(n)]
    corrs = [(a, b, None if rng.random() < 0.05 else round(rng.uniform(-1, 1), 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12 or b == a + 1]
    return stats, corrs


@pytest.mark.parametrize("last_pairs", [0, 40, 100_000])
def test_sweep_equals_one_selection_for_each_combination(spark, monkeypatch, last_pairs):
    monkeypatch.setattr(store, "LAST_PAIRS", last_pairs)
    stats, corrs = _graph(last_pairs)
    least, least_ir, most = [-0.8, 0.0, 0.6], [None, -0.3, 0.4], [-0.5, 0.2, 0.9]
    s, c = spark.createDataFrame(stats, "id long, rankic double, rankicir double"), spark.createDataFrame(corrs, "a long, b long, corr double").repartition(3)
    summary, picks = store.threshold_sweep(s, c, least, least_ir, most)
    got = {}
    for r in picks.collect():
        got.setdefault((r.least, r.least_ir, r.most_corr), set()).add(r.id)
    shown = {(r.least, r.least_ir, r.most_corr): r for r in summary.collect()}
    assert len(shown) == 27
    for t in least:
        for ir in least_ir:
            for m in most:
                near = {}
                for a, b, x in corrs:
                    if x is not None and x > m:
                        near.setdefault(a, set()).add(b)
                        near.setdefault(b, set()).add(a)
                ids = [i for i, r, q in sorted(stats, key=lambda x: (-x[1], x[0])) if r >= t and (ir is None or (q is not None and q >= ir))]
                want = _greedy(ids, near)
                assert got.get((t, ir, m), set()) == set(want), (t, ir, m)
                apart = [x for a, b, x in corrs if x is not None and a in want and b in want]
                row = shown[t, ir, m]
                assert row["count"] == len(want) and close(row.max_pair_corr, max(apart) if apart else None) and (not apart or close(row.avg_pair_corr, sum(apart) / len(apart)))


def test_greedy_selection_of_dense_graphs(spark, monkeypatch):
    for last_pairs in (0, 100_000):
        monkeypatch.setattr(store, "LAST_PAIRS", last_pairs)
        stats, corrs = _graph(9, 90)
        near = {}
        for a, b, x in corrs:
            if x is not None and x > -0.2:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        kept = store.greedy_independent(spark.createDataFrame([(i, r) for i, r, _ in stats], "id long, score double"), spark.createDataFrame(corrs, "a long, b long, corr double"), -0.2)
        assert sorted(r.id for r in kept.collect()) == sorted(_greedy([i for i, r, _ in sorted(stats, key=lambda x: (-x[1], x[0]))], near))


def test_sweep_takes_no_more_jobs_for_more_combinations(spark):
    stats, corrs = _graph(3, 60)
    s, c = spark.createDataFrame(stats, "id long, rankic double, rankicir double"), spark.createDataFrame(corrs, "a long, b long, corr double")
    jobs = []
    for least_ir, most in (([None], [0.5]), ([None, -0.5, 0.0, 0.2], [0.1, 0.3, 0.5, 0.7])):
        spark.sparkContext.setJobGroup(f"sweep{len(most)}", "")
        store.threshold_sweep(s, c, [-0.5, 0.0], least_ir, most)[0].collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep{len(most)}")))
    assert jobs[1] < 2 * jobs[0], jobs


def test_clusters_equal_a_plain_run(spark):
    import hashlib

    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(6, 8))[rng.integers(0, 6, 150)] + rng.normal(size=(150, 8)) * 0.4, np.zeros((2, 8))])
    m = np.concatenate([m, m[:5]]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None)]
    for k, rounds in ((6, 100), (9, 3), (400, 2)):
        u = m.astype(np.float64)
        norm = np.sqrt((u * u).sum(1))
        u = u / np.where(norm > 0, norm, 1)[:, None]
        first = sorted(range(len(u)), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:k]
        centres = u[first]
        for _ in range(rounds):
            best = np.round(u @ centres.T, 12).argmax(1)
            moved = centres.copy()
            for c in range(len(centres)):
                total = u[best == c].sum(0)
                if np.sqrt((total * total).sum()) > 0:
                    moved[c] = total / np.sqrt((total * total).sum())
            if np.allclose(centres, moved):
                break
            centres = moved
        s = np.round(u @ centres.T, 12)
        got = sorted(map(tuple, similarity.spherical_kmeans(spark.createDataFrame(rows, "id long, v array<float>").repartition(4), k, rounds).collect()))
        assert [g[0] for g in got] == list(range(len(m))) and [g[1] for g in got] == s.argmax(1).tolist()
        assert np.allclose([g[2] for g in got], s.max(1))
    assert similarity.spherical_kmeans(spark.createDataFrame([], "id long, v array<float>"), 3).count() == 0


def test_portfolios_by_plain_loop(spark):
    rng = random.Random(12)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=15 * d), d, s, None if rng.random() < 0.1 else float(rng.randrange(1, 30)), None if rng.random() < 0.2 else rng.uniform(0, 1), None if rng.random() < 0.1 else rng.gauss(0, 1)) for d in range(40) for s in range(30 if d % 9 else 4)]
    p = spark.createDataFrame(rows, "date date, di int, sym long, size double, bp double, r double")
    sorts = {"smb": portfolios.Sort("size", 0.5, 0.5, -1), "hml": portfolios.Sort("bp"), "in2": portfolios.Sort("bp", within="half")}
    month = F.trunc("date", "month")
    signals = portfolios.halves(portfolios.signal_rows(p, month, F.col("size").isNotNull()), "size", "half")
    got = {r.di: r for r in portfolios.factor_returns(p, month, "r", portfolios.members(signals, sorts, 9), sorts).collect()}
    by_day = {}
    for r in rows:
        by_day.setdefault(r[1], []).append(r)
    mean = lambda a: statistics.fmean(a) if a else None
    quantile = lambda a, q: float(np.quantile(a, q))
    held, last = {}, None
    for d in range(40):
        now = by_day[d][0][0].replace(day=1)
        if now != last:
            last, held = now, {}
            known = [r for r in by_day.get(d - 1, []) if r[3] is not None]
            if len(known) >= 9:
                m = quantile([r[3] for r in known], 0.5)
                held["smb"] = [({r[2] for r in known if r[3] > m}, {r[2] for r in known if r[3] <= m})]
                valued = [r for r in known if r[4] is not None]

                def cut(part):
                    lo, hi = quantile([r[4] for r in part], 0.3), quantile([r[4] for r in part], 0.7)
                    return {r[2] for r in part if r[4] >= hi}, {r[2] for r in part if r[4] <= lo}

                held["hml"] = [cut(valued)] if len(valued) >= 9 else []
                halves = [[r for r in valued if (r[3] > m) == up] for up in (False, True)]
                held["in2"] = [cut(h) for h in halves if len(h) >= 9]
        for name, sign in (("smb", -1), ("hml", 1), ("in2", 1)):
            parts = []
            for up, down in held.get(name) or []:
                a, b = (mean([r[5] for r in by_day[d] if r[2] in side and r[5] is not None]) for side in (up, down))
                parts.append(None if a is None or b is None else sign * (a - b))
            want = 0.0 if not parts else mean([x for x in parts if x is not None])
            assert close(got[d][name], want), (d, name, got[d][name], want)
    series = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), k, None if k == 5 else float(k)) for k in range(12)]
    roll = portfolios.rolled(spark.createDataFrame(series, "date date, di int, a double"), ["a"], (3,)).orderBy("di").collect()
    assert [r.a_3 for r in roll] == [None, None, 3.0, 6.0, 9.0, None, None, None, 21.0, 24.0, 27.0, 30.0]


def test_crossday_and_minute_correlations_by_plain_loop(spark):
    rng = random.Random(21)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(day(d), s, m, rng.uniform(9, 11), rng.uniform(11, 12), rng.uniform(9, 11), float(rng.randrange(1, 9)), rng.uniform(50, 99)) for d in range(12) for s in range(3) for m in sorted(rng.sample(range(1440), 40)) if (d + s) % 7]
    bars = spark.createDataFrame(rows, "date date, sym long, minute int, open double, high double, close double, volume double, amount double").repartition(4)
    got = {(r.date, r.sym): r for r in crossday.anomaly_panels(bars, 6, 3).collect()}
    lags = {(r.date, r.sym): r for r in minute.lag_correlations(bars, "volume", "close", range(-2, 3)).collect()}
    parts = {(r.date, r.sym): r.max_corr for r in minute.part_correlation(bars, "close", "volume", 100, 1300).collect()}
    tails = {(r.date, r.sym): r.tail_corr for r in minute.tail_correlation(bars, "close", "volume").collect()}
    by, features = {}, {}
    for r in rows:
        by.setdefault((r[0], r[1]), []).append(r)
    corr = lambda a, b: float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and len(set(a)) > 1 and len(set(b)) > 1 else None
    for key, bs in by.items():
        bs.sort(key=lambda r: r[2])
        ret, vol, close_ = [b[5] / b[3] - 1 for b in bs], [b[6] for b in bs], [b[5] for b in bs]
        top, path = max(b[4] for b in bs), sum(abs(x - y) for x, y in zip(close_[1:], close_))
        features[key] = (statistics.fmean(abs(r) / (b[7] + 1e-8) for r, b in zip(ret, bs)), sum(v for v, b in zip(vol, bs) if b[2] >= 1410) / (sum(vol) + 1e-8), (top - close_[-1]) / (abs(top - bs[0][3]) + 1e-8), sum(math.copysign(1, r) * v for r, v in zip(ret, vol)) / (sum(vol) + 1e-8), abs(close_[-1] - bs[0][3]) / (path + 1e-8))
        each = {k: corr(vol[: len(vol) - k] if k >= 0 else vol[-k:], close_[k:] if k >= 0 else close_[:k]) for k in range(-2, 3)}
        for k, x in each.items():
            assert close(lags[key][f"corr_{'m' if k < 0 else 'p'}{abs(k)}"], x)
        assert lags[key].best_lag == max(each, key=lambda k: (round(abs(each[k]), 9), -k))
        cut = [[(c, v) for c, v, b in zip(close_, vol, bs) if 100 <= b[2] <= 1300 and (b[2] - 100) // 400 == k] for k in range(3)]
        found = [corr(*zip(*c)) if c else None for c in cut]
        assert close(parts[key], None if None in found else max(map(abs, found)))
        lo, hi = np.quantile(close_, 0.3), np.quantile(close_, 0.7)
        tail = [(c, v) for c, v in zip(close_, vol) if c <= lo or c >= hi]
        assert close(tails[key], corr(*zip(*tail)))
    for d in range(12):
        for s in range(3):
            for k, name in enumerate(crossday.FEATURES):
                past = [features[day(j), s][k] for j in range(max(0, d - 6), d) if (day(j), s) in features]
                today = features.get((day(d), s))
                want = 0.0 if today is None or len(past) < 3 else (today[k] - statistics.fmean(past)) / math.sqrt(max(statistics.pvariance(past), 1e-8))
                assert close(got[day(d), s][f"anom_{name}_z6"], want)


def test_universes_are_sets(spark):
    rng = random.Random(6)
    names = universes.DAILY.names[:7]
    rows = [(d, s, *(rng.choice([True, False, False, None]) for _ in names)) for d in range(6) for s in range(40)]
    df = spark.createDataFrame(rows, "date int, sym long, " + ", ".join(f"f_{n} boolean" for n in names))
    u = universes.DAILY
    out = u.derive(u.made(df, {n: F.col(f"f_{n}") for n in names}), universes.RULES)
    sets = {n: {r[:2] for r in rows if r[2 + k]} for k, n in enumerate(names)}
    sets["standards"] = sets["stables"] & sets["liquid"]
    sets["top1800s"] = sets["zz1000s"] | sets["zz500s"] | sets["hs300s"]
    sets["universe_A1800_zzhls"] = sets["top1800s"] | sets["zzhls"]
    sets["universe_liq_div3y_A1800"] = sets["liq_div3y"] | sets["universe_A1800_zzhls"]
    sets["smalls"] = sets["standards"] - sets["hs300s"] - sets["zz500s"]
    for n in u.names:
        assert {(r.date, r.sym) for r in out.where(u.has(F.col("bits"), all_of=(n,))).collect()} == sets[n], n
    for r in u.sizes(out, ["date"]).collect():
        assert all(r[n] == sum(d == r.date for d, _ in sets[n]) for n in u.names)
        assert r.some == sum(1 << k for k, n in enumerate(u.names) if r[n]) and r.every == sum(1 << k for k, n in enumerate(u.names) if r[n] == 40)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0

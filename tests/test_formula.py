import datetime
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.functions.registry import ALL
from tessera.plans.formula import FormulaError, check, evaluate, parse

KINDS = {"x": "f", "y": "f", "g": "g", "con": "c"}


def panel(spark, values, con=None, g=None):
    day = datetime.date(2024, 1, 1)
    rows = [(day + datetime.timedelta(i), i, s, v, None if con is None else con[s][i], 0 if g is None else g[s]) for s, series in values.items() for i, v in enumerate(series)]
    return spark.createDataFrame(rows, "date date, di int, sym long, x double, con boolean, g int")


def test_text_round_trips():
    for text in ("group_rank(neg(x),g)", "fd(x,y,6,1,2,3,4,'mean')", "ts_delay(x,-2)", "ts_rank(x,5,pct=False)"):
        assert parse(parse(text).text()) == parse(text)


@pytest.mark.parametrize("text", ["", "cs_rank(x", "cs_rank(x))", "neg(x=1)", "ts_sum(x,5) y", "neg(,)"])
def test_bad_text(text):
    with pytest.raises(FormulaError):
        check(parse(text), KINDS)


@pytest.mark.parametrize("text", ["cs_rank(con)", "nothing(x)", "neg(z)", "neg(x,1,2)", "group_rank(x,y)", "ts_sum(x,y)"])
def test_bad_meaning(text):
    with pytest.raises(FormulaError):
        check(parse(text), KINDS)


def test_history_adds_up():
    assert parse("ts_mean(ts_delta(x,3),10)").history() == 13
    spans = {"trade_when(x,con)": (ALL, 0), "EMA(x,6)": (ALL, 0), "ema1(x,20)": (ALL, 0), "ADX(x,y,w)": (ALL, 0), "wma(x,1,2,3)": (3, 0), "stability(x)": (12, 0), "TS_SKEW(x)": (5, 0), "SMA(x,4)": (4, 0), "SMA(x,4,1)": (ALL, 0)}
    spans |= {"PERCENTILE(x,0.25)": (ALL, ALL), "PERCENTILE(x,0.25,6)": (6, 0), "ts_delay(x,-2)": (0, 2), "ts_mean(ts_delay(x,-2),5)": (5, 2), "add(ts_delay(x,-2),ts_delay(x,3))": (3, 2), "cs_rank(x)": (0, 0), "DECAYLINEAR(x)": (5, 0), "WMA(x)": (20, 0), "diff_q(diff(x))": (2, 0)}
    assert {f: parse(f).span() for f in spans} == spans


def test_equal_subtrees_share_one_column(spark):
    p = panel(spark, {1: [1.0, 2.0], 2: [3.0, 4.0]})
    df = evaluate(p, {"a": "neg(cs_rank(x))", "b": "abs(cs_rank(x))"})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("dense_rank(") == 1


def test_one_date_partitioning_for_two_ranks(spark):
    p = panel(spark, {1: [1.0, 2.0], 2: [3.0, 4.0]}).withColumn("y", -F.col("x"))
    plan = evaluate(p, {"a": "addr(x,y)"})._jdf.queryExecution().executedPlan().toString()
    assert "python" not in plan.lower()


def test_edges(spark):
    p = panel(spark, {1: [1.0, None, 5.0], 2: [1.0, None, 5.0], 3: [2.0, 7.0, 5.0]})
    got = {(r.di, r.sym): r.r for r in evaluate(p, {"r": "cs_rank(x)"}).collect()}
    assert got == {(0, 1): 0.0, (0, 2): 0.0, (0, 3): 1.0, (1, 1): None, (1, 2): None, (1, 3): 0.5, (2, 1): 0.5, (2, 2): 0.5, (2, 3): 0.5}


def test_kleene(spark):
    p = panel(spark, {1: [1.0] * 3}, con={1: [True, False, None]})
    got = [tuple(r) for r in evaluate(p, {"a": "con_and(con,eq(x,2))", "o": "con_or(con,eq(x,1))", "n": "con_not(con)"}).orderBy("di").select("a", "o", "n").collect()]
    assert [(bool(a) if a is not None else None, o, n) for a, o, n in got] == [(False, True, False), (False, True, True), (False, True, None)]


def test_trade_when_by_recurrence(spark):
    con = {1: [None, True, False, False, True, False], 2: [False, False, True, None, False, True], 3: [True] * 6}
    xs = {1: [3.0, 1.0, 2.0, 5.0, None, 4.0], 2: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 3: [2.0, 3.0, 1.0, 6.0, 1.0, 5.0]}
    p = panel(spark, xs, con=con)
    rank = {(r.di, r.sym): r.r for r in evaluate(p, {"r": "cs_rank(x)"}).collect()}
    got = {(r.di, r.sym): r.t for r in evaluate(p, {"t": "trade_when(x,con)"}).collect()}
    for s in xs:
        last = None
        for i in range(6):
            v, c = rank[i, s], con[s][i]
            if v is None or c is None:
                assert got[i, s] is None
                continue
            last = v if c or last is None else 0.8 * last + 0.2 * v
            assert abs(got[i, s] - last) < 1e-12


def test_long_histories_by_recurrence(spark):
    n = 5000
    xs = {1: [None if i % 11 == 3 or 1500 < i < 4200 else math.sin(i) + i / 1000 for i in range(n)], 2: [float(i % 17) for i in range(n)]}
    con = {1: [True] + [False] * (n - 1), 2: [i % 4000 == 7 for i in range(n)]}
    p = panel(spark, xs, con=con)
    got = {(r.di, r.sym): r for r in evaluate(p, {"a": "ema1(x,5)", "b": "ema1(x,2)", "c": "ema3(x,0.01)", "t": "trade_when(x,con)", "r": "cs_rank(x)"}).collect()}
    for s, series in xs.items():
        for name, beta, least in (("a", 1 - 2 / 6, 2), ("b", 1 - 2 / 3, 1), ("c", 0.99, 2)):
            top = low = seen = 0
            for i, v in enumerate(series):
                top, low = top * beta + (v or 0.0), low * beta + (v is not None)
                seen += v is not None
                if top and abs(low) < 1e-200:
                    top, low = top * 1e200, low * 1e200
                have = got[i, s][name]
                assert (have is None) == (seen < least) and (have is None or math.isclose(have, top / low, rel_tol=1e-7, abs_tol=1e-9)), (name, s, i)
        last = None
        for i in range(n):
            v, c = got[i, s].r, con[s][i]
            if v is not None:
                last = v if c or last is None else 0.8 * last + 0.2 * v
                assert abs(got[i, s].t - last) < 1e-9
            else:
                assert got[i, s].t is None


def test_whole_panel_maximum_is_no_single_partition(spark):
    p = panel(spark, {1: [1.0, 2.0], 2: [3.0, 4.0]}, g={1: 3, 2: 5})
    df = evaluate(p, {"m": "group_merge(g,g)"})
    assert {(r.sym, r.m) for r in df.collect()} == {(1, 3 * 6 + 3), (2, 5 * 6 + 5)}
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_gaussian_rank(spark):
    p = panel(spark, {s: [float(s)] for s in range(1, 11)})
    got = {r.sym: r.v for r in evaluate(p, {"v": "gaussian_rank(x)"}).collect()}
    normal = statistics.NormalDist()
    assert all(math.isclose(v, normal.inv_cdf(min(s / 10, 1 - 1e-6)), rel_tol=1e-7, abs_tol=1e-9) for s, v in got.items())


def test_empty_panel(spark):
    assert evaluate(panel(spark, {}), {"r": "ts_rank(cs_zscore(x),5)"}).count() == 0


def test_truncated_panels_give_the_same_values(spark):
    """Every function that states a finite reach, over its last dates with no more history than that."""
    from conftest import SF

    from tessera.function_queries import CASES
    from tessera.sources.panels import monthly_panel

    panel = monthly_panel(spark, SF).cache()
    last = panel.agg(F.max("di")).first()[0]
    spans = {name: parse(formula).span() for name, (formula, _) in CASES.items()}
    assert sum(b < ALL for b, _ in spans.values()) > 200 and {"EMA", "MACD", "RSI", "ADX", "trade_when"} <= {n for n, (b, _) in spans.items() if b == ALL}
    by_reach = {}
    for name, (back, ahead) in spans.items():
        if back < ALL and ahead < ALL:
            by_reach.setdefault(int(back), []).append(name)
    shown = lambda df, names: {(r.di, r.sym): tuple(None if v is None else round(float(v), 7) for v in r[3:]) for r in df.where(f"di BETWEEN {last - 20} AND {last - 10}").collect()}
    for back, names in sorted(by_reach.items()):
        formulas = {f"v{k}": CASES[n][0] for k, n in enumerate(names)}
        whole, part = (shown(evaluate(p, formulas), names) for p in (panel, panel.where(f"di >= {last - 20 - back}")))
        assert len(whole) == len(part)
        wrong = {names[k] for key in whole for k in range(len(names)) if (whole[key][k] is None) != (part[key][k] is None) or (whole[key][k] is not None and abs(whole[key][k] - part[key][k]) > 1e-6 * max(1, abs(whole[key][k])))}
        assert not wrong, (back, wrong)


def test_functions_as_transforms(spark):
    from conftest import SF

    from tessera.functions.transforms import using
    from tessera.sources.panels import monthly_panel

    panel = monthly_panel(spark, SF)
    made = (
        panel.transform(using("ts_corr", "x", "y", 6, to="a")).transform(using("cs_rank", F.col("x") / F.col("w"), to="b")).transform(using("EMA", "a", 4, to="c"))
        .transform(using("group_merge", "g", "g", to="d")).transform(using("trade_when", "x", "con", q=0.3, to="e")).transform(using("group_rank", "b", "g", to="f"))
    )
    assert made.columns == [*panel.columns, *"abcdef"]
    want = evaluate(panel, {"a": "ts_corr(x,y,6)", "b": "cs_rank(div(x,w))", "c": "EMA(ts_corr(x,y,6),4)", "d": "group_merge(g,g)", "e": "trade_when(x,con,q=0.3)", "f": "group_rank(cs_rank(div(x,w)),g)"})
    shown = lambda df: {(r.di, r.sym): tuple(None if r[c] is None else round(float(r[c]), 8) for c in "abcdef") for r in df.collect()}
    assert shown(made) == shown(want)

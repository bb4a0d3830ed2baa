"""Queries of evaluation profiles, post-processing, intraday indicators and masks, daily transforms and derived fields,
each with SQL written apart from it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .history_queries import _BUSY, _busy, tables_written
from .operator_queries import _UNIT, _VALUES, _W, ORACLES, QUERIES, _rounded, _values, query  # noqa: F401  the queries below go there
from .operators import evaluation, minute, styles
from .plans.formula import evaluate
from .sources.panels import MONTHLY_SQL, monthly_panel, read

# a profile is a range of months; what is bought must be tradable and not at its limit the month after
_PROFILES = {"is": (6, 50), "os": (51, None), "full": (6, None)}
# weights run 1, 2, 3 from the oldest row of three to the newest, whatever the row they are looked at from
_FLAGGED = f"""{_VALUES},
fl AS (SELECT p.di, p.sym, p.w >= 3 AS universe, lead(p.y >= 60 AND NOT coalesce(p.x > 1.8 * p.b, false)) OVER (PARTITION BY p.sym ORDER BY p.di) AS buyable, p.y FROM (SELECT *, lag(x) OVER o AS b FROM p {_W}) p),
dc AS (SELECT *, lag(v, 1) OVER o AS v1, lag(v, 2) OVER o AS v2 FROM vals {_W}),
pv AS (SELECT d.di, d.sym, d.ret, coalesce(f.universe, false) AS universe, coalesce(f.buyable, false) AS buyable, CASE WHEN coalesce(f.y >= 40, false) AND v IS NOT NULL THEN round((3 * v + 2 * coalesce(v1, 0) + coalesce(v2, 0)) / (3 + CASE WHEN v1 IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN v2 IS NOT NULL THEN 1 ELSE 0 END), 9) END AS v FROM dc d JOIN fl f USING (di, sym))"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sym").orderBy("di")
    p = monthly_panel(spark, sf_dir)
    limit = F.coalesce(F.col("x") > 1.8 * F.lag("x").over(w), F.lit(False))
    flags = p.select("di", "sym", (F.col("w") >= 3).alias("universe"), ((F.col("y") >= 60) & ~limit).alias("_t"), "y")
    flags = flags.withColumn("buyable", F.lead("_t").over(w)).drop("_t")
    out = evaluation.processed(_values(spark, sf_dir).select("di", "sym", "v", "ret").join(flags, ["di", "sym"]), 3, F.col("y") >= 40)
    return out.withColumn("v", F.round("v", 9))  # so that values that are equal but for noise are ties


@query(f"WITH {_FLAGGED} SELECT di, sym, round(v, 6) + 0.0 AS v FROM pv")
def eval_processed(spark, sf_dir):
    return _rounded(_flagged(spark, sf_dir).select("di", "sym", "v"))


@query(f"""WITH {_FLAGGED}, mk AS (SELECT di, sym, v, universe, buyable, CASE WHEN universe AND buyable THEN ret END AS ret, CASE WHEN buyable THEN v END AS b FROM pv),
kk AS (SELECT *, CASE WHEN b IS NOT NULL THEN dense_rank() OVER (PARTITION BY di, b IS NULL ORDER BY b) END AS kb, CASE WHEN ret IS NOT NULL THEN dense_rank() OVER (PARTITION BY di, ret IS NULL ORDER BY ret) END AS kr FROM mk),
r AS (SELECT *, {_UNIT.format(c='b', r='kb', by='di')} AS rv, {_UNIT.format(c='ret', r='kr', by='di')} AS rr FROM kk), t AS (SELECT *, coalesce((rv >= 0.8)::INT, 0) AS top FROM r),
w AS (SELECT *, coalesce(top / nullif(sum(top) OVER (PARTITION BY di), 0), 0) AS wt FROM t), dd AS (SELECT *, abs(wt - lag(wt) OVER (PARTITION BY sym ORDER BY di)) AS d FROM w),
day AS (SELECT di, CASE WHEN min(b) FILTER (ret IS NOT NULL) < max(b) FILTER (ret IS NOT NULL) AND min(ret) FILTER (b IS NOT NULL) < max(ret) FILTER (b IS NOT NULL) THEN corr(b, ret) END AS ic,
  CASE WHEN min(rv) FILTER (rr IS NOT NULL) < max(rv) FILTER (rr IS NOT NULL) AND min(rr) FILTER (rv IS NOT NULL) < max(rr) FILTER (rv IS NOT NULL) THEN corr(rv, rr) END AS rankic,
  CASE WHEN count(rv) > 0 THEN coalesce(sum(ret) FILTER (top = 1) / nullif(sum(top), 0), 0) * 243 END AS longret, count(v) FILTER (universe) / nullif(count(*) FILTER (universe), 0)::DOUBLE AS coverage, sum(d) AS turnover FROM dd GROUP BY di),
g AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {'NULL' if b is None else b})" for n, (a, b) in _PROFILES.items())}) x(profile, a, b)), h AS (SELECT profile, a, least(coalesce(b, m), m) - 2 AS b FROM g, (SELECT max(di) AS m FROM day))
SELECT profile, round(avg(ic), 6) + 0.0 AS ic, round(avg(rankic), 6) + 0.0 AS rankic, round(avg(rankic) / stddev_samp(rankic), 6) + 0.0 AS rankicir, round(avg(longret), 5) + 0.0 AS longret, round(avg(turnover) FILTER (di > a), 6) + 0.0 AS turnover, round(avg(coverage), 6) AS coverage, count(*) AS dates FROM h JOIN day ON di BETWEEN a AND b GROUP BY profile""")
def eval_profiles(spark, sf_dir):
    out = evaluation.profiled(_flagged(spark, sf_dir), _PROFILES)
    return _rounded(out.withColumn("longret", F.round("longret", 5)))


_SIDES = f"""{_VALUES}, k AS (SELECT *, CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY di, v IS NULL ORDER BY v) END AS k FROM vals), r AS (SELECT *, {_UNIT.format(c='v', r='k', by='di')} AS r FROM k),
s AS (SELECT *, coalesce((r < 0.2)::INT, 0) AS lo, coalesce((r > 0.8)::INT, 0) AS hi FROM r), w AS (SELECT *, coalesce(lo / nullif(sum(lo) OVER (PARTITION BY di), 0), 0) AS wl, coalesce(hi / nullif(sum(hi) OVER (PARTITION BY di), 0), 0) AS wh FROM s),
dd AS (SELECT *, abs(wl - lag(wl) OVER (PARTITION BY sym ORDER BY di)) AS dl, abs(wh - lag(wh) OVER (PARTITION BY sym ORDER BY di)) AS dh FROM w),
sides AS (SELECT di, avg(ret) FILTER (lo = 1) AS low_ret, avg(ret) FILTER (hi = 1) AS high_ret, sum(hi)::BIGINT AS n_high, coalesce(sum(dl), 0) AS low_trade, coalesce(sum(dh), 0) AS high_trade FROM dd GROUP BY di)"""


@query(f"WITH {_SIDES} SELECT di, round(low_ret, 6) + 0.0 AS low_ret, round(high_ret, 6) + 0.0 AS high_ret, n_high, round(low_trade, 6) + 0.0 AS low_trade, round(high_trade, 6) + 0.0 AS high_trade FROM sides")
def eval_both_sides(spark, sf_dir):
    return _rounded(evaluation.both_sides(_values(spark, sf_dir)))


@query(f"WITH {_SIDES}, cl AS (SELECT greatest(least(high_ret - low_ret, 0.5), -0.5) AS s FROM sides WHERE high_ret - low_ret IS NOT NULL) SELECT round(abs(avg(s) / stddev_samp(s) * sqrt(252)), 6) + 0.0 AS ir, count(s) AS dates FROM cl")
def fitness_long_short(spark, sf_dir):
    return _rounded(evaluation.long_short_fitness(_values(spark, sf_dir), clip=0.5))


@query(f"""WITH {_VALUES}, b1 AS (SELECT di, least(greatest(ret, -0.5), 0.5) / 10 AS ret, CAST(least(floor(rv * (5 - 1e-9)), 4) AS INT) AS bucket FROM ranked WHERE rv IS NOT NULL AND ret IS NOT NULL), g1 AS (SELECT di, bucket, avg(ret) AS ret FROM b1 GROUP BY 1, 2)
SELECT bucket, round(avg(ret), 6) + 0.0 AS mean_return, round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS final_return FROM g1 GROUP BY bucket""")
def eval_group_summary(spark, sf_dir):
    small = _values(spark, sf_dir).withColumn("ret", F.when(F.col("ret").isNotNull(), F.greatest(F.least("ret", F.lit(0.5)), F.lit(-0.5)) / 10))
    return _rounded(evaluation.group_summary(evaluation.group_returns(small, 5)))


_MEASURED = {"long_ret": "p_size / 200.0", "long_netret": "(p_partkey % 13) / 100.0", "ls_ir": "p_retailprice / 400", "ls_netir": "CASE WHEN p_size % 7 <> 0 THEN p_retailprice / 900 END", "rankic": "(p_size % 10) / 150.0", "rankicir": "p_size / 9.0", "mono": "(p_partkey % 20) / 100.0", "monoir": "(p_partkey % 9) / 10.0"}
_SQUASHED = {k: f"(1 / (1 + exp(-(coalesce({_MEASURED[k]}, 0) - {mid}) / {width})))" for k, (mid, width) in evaluation.SCORED.items()}


@query("SELECT p_partkey, round((({long_ret} + {long_netret}) / 2) * 0.5 + ((({ls_ir} + {ls_netir}) / 2 + ({rankic} + {rankicir}) / 2 + ({mono} + {monoir}) / 2) / 3) * 0.5, 6) AS score FROM part".format(**_SQUASHED))
def eval_score(spark, sf_dir):
    # a literal like 150.0 is a decimal here, whose quotients keep six places; as a double it divides as in the SQL
    measured = {k: F.expr(re.sub(r"(\d\.\d+)", r"\1D", e)).cast("double") for k, e in _MEASURED.items()}
    part = read(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in measured.items()))
    return _rounded(part.select("p_partkey", evaluation.score().alias("score")))


_TIMED = f"""{MONTHLY_SQL.strip()}, s AS (SELECT date, avg(w) AS factor, sum(x) FILTER (g <= 1) / 1000 AS main, sum(x) FILTER (g >= 3) / 1000 AS aux FROM p GROUP BY date), f AS (SELECT date, lag(factor) OVER (ORDER BY date) AS f, aux - main AS d FROM s), k AS (SELECT * FROM f WHERE f IS NOT NULL AND d IS NOT NULL)"""


def _timed(spark: SparkSession, sf_dir: str):
    p = monthly_panel(spark, sf_dir)
    part = lambda c: F.sum(F.when(c, F.col("x"))) / 1000
    return evaluation.timing_performance(p.groupBy("date").agg(F.avg("w").alias("factor"), part(F.col("g") <= 1).alias("main"), part(F.col("g") >= 3).alias("aux")))


@query(f"WITH {_TIMED} SELECT year(date)::INT AS year, CASE WHEN min(f) < max(f) AND min(d) < max(d) THEN round(corr(f, d), 6) + 0.0 END AS ic, count(*) AS periods FROM k GROUP BY ROLLUP (year(date))")
def timing_by_year(spark, sf_dir):
    return _rounded(_timed(spark, sf_dir)[0])


@query(f"""WITH {_TIMED}, n AS (SELECT d, row_number() OVER (ORDER BY f, date) - 1 AS k, count(*) OVER () AS n FROM k)
SELECT greatest(ceil(k * least(10, n) / greatest(n - 1, 1)::DOUBLE), 1)::INT AS "group", round(avg(d), 6) + 0.0 AS mean, count(*) AS periods FROM n GROUP BY 1""")
def timing_by_group(spark, sf_dir):
    return _rounded(_timed(spark, sf_dir)[1])


# every indicator of a minute
_D = "PARTITION BY date, sym"
_AT = f"""{_BUSY}, i0 AS (SELECT *, close / nullif(open, 0) - 1 AS r, amount / nullif(volume, 0) AS vw, row_number() OVER o - 1 AS k, count(*) OVER ({_D}) AS n, lag(close) OVER o AS cl, coalesce(lag(volume) OVER o, volume) AS vl FROM bb WINDOW o AS ({_D} ORDER BY minute)),
i1 AS (SELECT date, sym, max(high) AS top, min(low) AS bottom, arg_min(open, k) AS first, arg_max(close, k) AS last, max(close) FILTER (k = n // 2) AS mid, min(k) FILTER (high = mh) AS kt, min(k) FILTER (low = ml) AS kb, coalesce(sum(abs(close - cl)), 0) AS path, avg(volume) AS vm, var_pop(r) AS v1, var_pop(r) FILTER (k % 5 = 0) AS v5,
  sum(amount) AS asum, avg(abs(r) / (amount + 1e-8)) AS am, sqrt(coalesce(sum(r * r), 0)) AS rv, abs(coalesce(sum(sign(r) * volume), 0) / (sum(volume) + 1e-8)) AS oi FROM (SELECT *, max(high) OVER ({_D}) AS mh, min(low) OVER ({_D}) AS ml FROM i0) GROUP BY date, sym),
i2 AS (SELECT *, asum >= quantile_cont(asum, 0.7) OVER (PARTITION BY date) AS g1, rv >= quantile_cont(rv, 0.7) OVER (PARTITION BY date) AS g2, oi >= quantile_cont(oi, 0.7) OVER (PARTITION BY date) AS g3, last / (first + 1e-8) - 1 AS ch, mid / (first + 1e-8) - 1 - (last / (mid + 1e-8) - 1) AS hv FROM i1),
i3 AS (SELECT *, (volume - vl) / (vl + 1e-8) AS ac, product(1 + coalesce(r, 0)) OVER o AS cum, sum(coalesce(sign(r), 0) * volume) OVER o AS sv, sum(volume) OVER o AS cv FROM i0 JOIN i2 USING (date, sym) WINDOW o AS ({_D} ORDER BY minute ROWS UNBOUNDED PRECEDING))"""
_DERIVED = {
    "return": "r", "vwap": "vw", "spread": "high - low", "mid_price": "(high + low) * 0.5", "typical_price": "(high + low + close) / 3", "money_flow": "(high + low + close) / 3 * volume", "return_abs": "abs(r)", "log_volume": "ln(volume + 1)", "log_amount": "ln(amount + 1)", "price_range_pct": "(high - low) / (open + 1e-8)",
    "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low", "body": "abs(close - open)", "vwap_deviation": "close - vw", "volume_intensity": "volume / (vm + 1e-8)", "cum_return": "cum", "amt_per_trade_proxy": "amount / (volume + 1e-8)", "amihud": "abs(r) / (volume * close + 1e-8)",
    "kyle_lambda": "abs(close - open) / (sqrt(volume * close + 1e-8) + 1e-8)", "signed_volume": "sign(close - open) * volume", "vol_accel": "sign(ac) * ln(1 + abs(ac))", "rv_ratio": "v1 / (v5 + 1e-8)", "order_imbalance": "sv / (cv + 1e-8)", "path_high_time": "kt / greatest(n - 1, 1)::DOUBLE", "path_low_time": "kb / greatest(n - 1, 1)::DOUBLE",
    "path_high_to_close": "(top - last) / (abs(top - first) + 1e-8)", "path_low_rebound": "(last - bottom) / (abs(first - bottom) + 1e-8)", "path_efficiency": "abs(last - first) / (path + 1e-8)", "gate_liq_high_amount": "CASE WHEN g1 THEN -am ELSE 0 END", "gate_rev_high_rv": "CASE WHEN g2 THEN -ch ELSE 0 END",
    "gate_rev_pm_disagree": "CASE WHEN hv * ch < 0 THEN -ch ELSE 0 END", "gate_rev_high_oimb": "CASE WHEN g3 THEN -ch ELSE 0 END",
}
#: Ratios over next to nothing are huge; they are compared by a logarithm that keeps their sign.
_HUGE = ("rv_ratio", "path_high_to_close", "path_low_rebound", "path_efficiency")


@query(f"WITH {_AT} SELECT date, minute, sym, {', '.join(f'round(coalesce({f'sign({e}) * ln(1 + abs({e}))' if k in _HUGE else e}, 0), 5) + 0.0 AS {k}' for k, e in _DERIVED.items())} FROM i3".replace(" AS return,", ' AS "return",'))
def minute_derived_indicators(spark, sf_dir):
    df = minute.derived_indicators(_busy(spark, sf_dir))
    return _rounded(df.withColumns({k: F.signum(k) * F.log1p(F.abs(k)) for k in _HUGE}), 5)


@query(f"""WITH {_BUSY}, z AS (SELECT date, minute, sym, close - 60 AS x, volume - 1 AS y FROM bb), w AS (SELECT *, avg(x) OVER ({_D}) AS m, stddev_pop(x) OVER ({_D}) AS s FROM z)
SELECT date, minute, sym, round(x, 6) + 0.0 AS identity, CASE WHEN x > 0 THEN round(ln(x), 6) + 0.0 END AS log, round(abs(x), 6) AS abs, round(nullif(abs(x), 0), 6) AS nozero_abs, round(greatest(x, 0), 6) + 0.0 AS pos, round(-x, 6) + 0.0 AS neg, round(least(x, 0), 6) + 0.0 AS neg_part,
round((x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) + 0.0 AS zscore, round(x + y, 6) + 0.0 AS add, round(x - y, 6) + 0.0 AS sub, round(x * y, 6) + 0.0 AS mul, round(x / nullif(y, 0), 6) + 0.0 AS div, round(x / nullif(y, 0) - 1, 6) + 0.0 AS pct, CASE WHEN abs(y) > 0.05 THEN round(x / y, 6) + 0.0 END AS safe_div FROM w""")
def minute_pointwise(spark, sf_dir):
    w = Window.partitionBy("date", "sym")
    z = _busy(spark, sf_dir).select("date", "minute", "sym", (F.col("close") - 60).alias("x"), (F.col("volume") - 1).alias("y"))
    z = z.withColumns({"_m": F.avg("x").over(w), "_s": F.stddev_pop("x").over(w)})
    made = minute.pointwise(F.col("x"), F.col("y"), F.col("_m"), F.col("_s"))
    return _rounded(z.select("date", "minute", "sym", *(c.alias(k) for k, c in made.items())))


def _masked(rule: str, start: int, end: int, tag: str) -> str:
    keep = "true" if rule == "none" else f"(k - 1) / (n - 1 + 1e-8) {'>= 1 - ' if rule[0] == 'h' else '<= '}{rule.split('_')[1]}"
    return f"""{tag} AS (SELECT date, sym, avg(close) AS m{tag}, arg_max(close, minute) AS l{tag}, count(*) AS c{tag} FROM (SELECT *, row_number() OVER ({_D} ORDER BY high, minute) AS k, count(*) OVER ({_D}) AS n FROM bb WHERE minute >= {start} AND minute < {end}) WHERE {keep} GROUP BY 1, 2)"""


_MASKS = {"k1": ("high_0.3", 720, None), "k2": ("low_0.5", 900, 0.5), "k3": ("none", 240, 0.0), "k4": ("high_0.7", 1440, 0.2), "k5": ("low_0.3", 600, 1.0)}


@query(f"""WITH {_BUSY}, {', '.join(_masked(r, *minute.slice_bounds(w, s, 1440), t) for t, (r, w, s) in _MASKS.items())}, k AS (SELECT DISTINCT date, sym FROM bb)
SELECT k.date, k.sym, {', '.join(f'round(m{t}, 6) + 0.0 AS mean_{t}, round(l{t}, 6) + 0.0 AS last_{t}, coalesce(c{t}, 0) AS n_{t}' for t in _MASKS)} FROM k {' '.join(f'LEFT JOIN {t} ON {t}.date = k.date AND {t}.sym = k.sym' for t in _MASKS)}""")
def minute_masks(spark, sf_dir):
    """Mean, last and count of close where high is among the highest or lowest of a window of the day."""
    bars = tables_written(_busy(spark, sf_dir), "bars")
    out = bars.select("date", "sym").distinct()
    for t, (rule, window, at) in _MASKS.items():
        start, end = minute.slice_bounds(window, at, 1440)
        part = minute.rank_mask(minute.minutes(bars, start, end - 1), "high", rule)
        one = part.groupBy("date", "sym").agg(F.avg("close").alias(f"mean_{t}"), F.max_by("close", "minute").alias(f"last_{t}"), F.count("*").alias(f"n_{t}"))
        out = out.join(one, ["date", "sym"], "left").withColumn(f"n_{t}", F.coalesce(f"n_{t}", F.lit(0)).cast("long"))
    return _rounded(out)


_OUTER_SQL = {
    "ts_neg": "-x", "ts_diff_1": "x - lag(x) OVER o", "ts_pctchange_5": "x / CASE WHEN abs(lag(x, 5) OVER o) > 1e-3 THEN lag(x, 5) OVER o END - 1", "ts_zscore_20": "CASE WHEN count(x) OVER a >= 10 THEN (x - avg(x) OVER a) / CASE WHEN stddev_samp(x) OVER a > 1e-8 THEN stddev_samp(x) OVER a ELSE 1 END END",
    "ts_rank_60": "CASE WHEN x IS NOT NULL AND len(l) >= 20 THEN (len(l) + len(list_filter(l, lambda e: e < x)) - len(list_filter(l, lambda e: e > x)) + 1) / 2.0 / len(l) * 2 - 1 END",
}


@query(f"""WITH {MONTHLY_SQL.strip()}, q AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY sym ORDER BY di ROWS 59 PRECEDING) AS l FROM p) SELECT di, sym, round(x, 5) AS identity, {', '.join(f'round({e}, 5) + 0.0 AS {k}' for k, e in _OUTER_SQL.items())}
FROM q WINDOW o AS (PARTITION BY sym ORDER BY di), a AS (PARTITION BY sym ORDER BY di ROWS 19 PRECEDING)""")
def daily_outer(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).select("di", "sym", *(F.col("x").alias(k) for k in minute.OUTER))
    for how in minute.OUTER:
        p = minute.daily_outer(p, how, how)
    return _rounded(p, 5)


def _roll(column: str, n: int, least: int) -> str:
    return f"CASE WHEN count({column}) OVER w{n} >= {least} THEN stddev_samp({column}) OVER w{n} END"


@query(f"""WITH {MONTHLY_SQL.strip()}, a AS (SELECT *, x / nullif(lag(x) OVER o, 0) - 1 AS r FROM p {_W}), v AS (SELECT date, di, sym, w, {_roll('r', 24, 24)} AS long, {_roll('r', 12, 6)} AS mid, {_roll('r', 12, 2)} AS short FROM a WINDOW w24 AS (PARTITION BY sym ORDER BY di ROWS 23 PRECEDING), w12 AS (PARTITION BY sym ORDER BY di ROWS 11 PRECEDING))
SELECT date, sym, round(CASE WHEN long IS NULL AND coalesce(w >= 3, false) THEN coalesce(mid, short) ELSE long END, 6) + 0.0 AS vol FROM v""")
def style_filled_in(spark, sf_dir):
    p = evaluate(monthly_panel(spark, sf_dir), {"r": "diff_q(x)", "w1": "ts_self(w)"})
    w = lambda n: Window.partitionBy("sym").orderBy("di").rowsBetween(-(n - 1), 0)
    vol = lambda n, least: F.when(F.count("r").over(w(n)) >= least, F.stddev_samp("r").over(w(n)))
    p = p.withColumns({"vol": vol(24, 24), "_a": vol(12, 6), "_b": vol(12, 2)})
    return _rounded(styles.filled_in(p, "vol", F.col("w1") >= 3, F.col("_a"), F.col("_b")).select("date", "sym", "vol"))


def _rolling_corr(a: str, b: str, n: int) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND count({a}) OVER t{n} >= {n // 2} AND min({a}) OVER t{n} < max({a}) OVER t{n} AND min({b}) OVER t{n} < max({b}) OVER t{n} THEN corr({a}, {b}) OVER t{n} END"


def _gate(e: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER t{n} >= {n // 2} THEN {e} END"


def _ewm(c: str, n: int) -> str:
    beta = 1 - 2 / (1 + n)
    return f"CASE WHEN len({c}) >= {n // 2} THEN list_sum(list_transform({c}, lambda s: s.x * pow({beta!r}, di - s.d))) / list_sum(list_transform({c}, lambda s: pow({beta!r}, di - s.d))) END"


@query(f"""WITH {MONTHLY_SQL.strip()}, h AS (SELECT *, x * (1 + sym % 5 / 8.0) AS c, y AS v, x AS a FROM p), r AS (SELECT *, c / nullif(lag(c) OVER o, 0) - 1 AS r, ln(nullif(v, 0)) - lag(ln(nullif(v, 0))) OVER o AS lv FROM h {_W}),
q AS (SELECT *, CASE WHEN v IS NOT NULL THEN c END AS c1, CASE WHEN c IS NOT NULL THEN v END AS v1, CASE WHEN lv IS NOT NULL THEN r END AS r1, CASE WHEN r IS NOT NULL THEN lv END AS l1, list({{'x': c, 'd': di}}) FILTER (c IS NOT NULL) OVER (PARTITION BY sym ORDER BY di ROWS UNBOUNDED PRECEDING) AS l FROM r)
SELECT date, di, sym, {', '.join(f'round({e}, 4) + 0.0 AS {k}' for k, e in {"pvc5": _rolling_corr("c1", "v1", 5), "pvc20": _rolling_corr("c1", "v1", 20), "ema5": "last_value(" + _ewm("l", 5) + ") OVER (PARTITION BY sym, di)", "ema20": "last_value(" + _ewm("l", 20) + ") OVER (PARTITION BY sym, di)", "adv5": _gate("avg(v) OVER t5", "v", 5), "adv20": _gate("avg(v) OVER t20", "v", 20), "vol5": _gate("CASE WHEN count(r) OVER t5 > 1 THEN stddev_samp(r) OVER t5 END", "r", 5), "vol20": _gate("CASE WHEN count(r) OVER t20 > 1 THEN stddev_samp(r) OVER t20 END", "r", 20), "rvc5": _rolling_corr("r1", "l1", 5), "rvc20": _rolling_corr("r1", "l1", 20), "te": "abs(r) / nullif(a, 0)"}.items())}
FROM q WINDOW t5 AS (PARTITION BY sym ORDER BY di ROWS 4 PRECEDING), t20 AS (PARTITION BY sym ORDER BY di ROWS 19 PRECEDING)""")
def style_price_volume(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("factor", 1 + F.col("sym") % 5 / 8.0)
    p = styles.adjusted(p, "factor", ["x"]).select("date", "di", "sym", F.col("adj_x").alias("c"), F.col("y").alias("v"), F.col("x").alias("a"))
    p = p.withColumn("r", F.try_divide("c", F.lag("c").over(Window.partitionBy("sym").orderBy("di"))) - 1)
    return _rounded(evaluate(p, styles.PRICE_VOLUME), 4)

"""One query for each panel function over the monthly panel, each with SQL written apart from it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.dialects import ALIASES
from .plans.formula import evaluate
from .sources.panels import MONTHLY_SQL, monthly_panel

DIGITS = 4
N = 6

# Oracle parts: dicts are layers of columns, each over the one before; the string is the result.
Parts = tuple


def rank(c: str, by: str = "di", tag: str = "") -> Parts:
    return (
        {f"r{tag}": f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) END"},
        {f"m{tag}": f"max(r{tag}) OVER (PARTITION BY {by})"},
        {f"u{tag}": f"CASE WHEN r{tag} IS NOT NULL THEN CASE WHEN m{tag} = 1 THEN 0.5 ELSE (r{tag} - 1) / (m{tag} - 1)::DOUBLE END END"},
    )


def both(*ranks: Parts) -> Parts:
    return tuple({k: v for part in layer for k, v in part.items()} for layer in zip(*ranks))


XY = both(rank("x", tag="a"), rank("y", tag="b"))
GATE = "CASE WHEN count(x) OVER ts >= 3 THEN {} END"
XLX = "CASE WHEN {0} > 0 THEN {0} * ln({0}) WHEN {0} IS NOT NULL THEN 0.0 END"


def z(c: str, w: str = "cs") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN count({c}) OVER {w} = 1 OR min({c}) OVER {w} = max({c}) OVER {w} THEN 0.0 ELSE ({c} - avg({c}) OVER {w}) / stddev_samp({c}) OVER {w} END END"


def gated(e: str) -> str:
    return GATE.format(e)


PAIR = {"a": "CASE WHEN y IS NOT NULL THEN x END", "b": "CASE WHEN x IS NOT NULL THEN y END"}


def line(w: str) -> dict[str, str]:
    return {
        "n": f"count(a) OVER {w}", "va": f"min(a) OVER {w} < max(a) OVER {w}", "vb": f"min(b) OVER {w} < max(b) OVER {w}",
        "sab": f"covar_pop(a, b) OVER {w}", "saa": f"var_pop(a) OVER {w}", "sbb": f"var_pop(b) OVER {w}", "ma": f"avg(a) OVER {w}", "mb": f"avg(b) OVER {w}",
    }


SLOPE, CORR = "sab / saa", "sab / (sqrt(saa) * sqrt(sbb))"
RESID = f"b - mb - ({SLOPE}) * (a - ma)"
#: Rolling windows as lists, for what has no closed window form.
LISTED = {"a": "list(x) FILTER (x IS NOT NULL) OVER ts"}
CUTS = (
    {"a": "list_sort(list({'y': y, 'd': di, 'x': x}) FILTER (x IS NOT NULL AND y IS NOT NULL) OVER ts)"},
    {"k": "coalesce(len(a), 0)"},
    {"hi": "list_avg(list_transform(a[k - k // 2 + 1:k], lambda s: s.x))", "lo": "list_avg(list_transform(a[1:k - k // 2], lambda s: s.x))"},
)


def cut(e: str) -> Parts:
    return (*CUTS, f"CASE WHEN k >= 3 THEN {e} END")


def ema(beta: float, least: int) -> Parts:
    h = "(PARTITION BY sym ORDER BY di ROWS UNBOUNDED PRECEDING)"
    return ({"c": f"count(x) OVER {h}", "l": "list({'x': x, 'd': di}) FILTER (x IS NOT NULL) OVER " + h}, f"CASE WHEN c >= {least} THEN list_sum(list_transform(l, lambda s: s.x * pow({beta!r}, di - s.d))) / list_sum(list_transform(l, lambda s: pow({beta!r}, di - s.d))) END")


def triple(w: str) -> Parts:
    ok = "x IS NOT NULL AND y IS NOT NULL AND q IS NOT NULL"
    c = lambda u, v: f"covar_samp({u}, {v}) OVER {w}"
    return (
        {"q": "lag(x) OVER o"}, {"a": f"CASE WHEN {ok} THEN x END", "b": f"CASE WHEN {ok} THEN q END", "t": f"CASE WHEN {ok} THEN y END"},
        {"n": f"count(a) OVER {w}", "aa": c("a", "a"), "bb": c("b", "b"), "ab": c("a", "b"), "ay": c("a", "t"), "cy": c("b", "t"), "yy": c("t", "t"), "ma": f"avg(a) OVER {w}", "mb": f"avg(b) OVER {w}", "mt": f"avg(t) OVER {w}"},
        {"det": "CASE WHEN aa * bb - ab * ab > 1e-10 * aa * bb THEN aa * bb - ab * ab END"},
        {"k1": "(ay * bb - cy * ab) / det", "k2": "(cy * aa - ay * ab) / det"},
    )


TRADE = (
    *rank("x"), {"ok": "con IS NOT NULL AND u IS NOT NULL"},
    {"s": "list({'u': u, 'c': con}) FILTER (ok) OVER (PARTITION BY sym ORDER BY di ROWS UNBOUNDED PRECEDING)"},
    "CASE WHEN ok THEN list_reduce(list_transform(s, lambda e: {'v': e.u, 'c': e.c}), lambda a, e: {'v': CASE WHEN e.c THEN e.v ELSE 0.8 * a.v + 0.2 * e.v END, 'c': e.c}).v END",
)

#: function: (formula, oracle parts)
CASES: dict[str, tuple[str, Parts | str]] = {
    "eq": ("eq(w,y)", "(w = y)::INT"), "le": ("le(y,x)", "(y <= x)::INT"), "ge": ("ge(y,x)", "(y >= x)::INT"),
    "con_and": ("con_and(con,ge(y,x))", "(con AND y >= x)::INT"), "con_or": ("con_or(con,ge(w,ts_delay(w,1)))", ({"q": "lag(w) OVER o"}, "(con OR w >= q)::INT")), "con_not": ("con_not(con)", "(NOT con)::INT"),
    "bucket": ("bucket(x,5)", (*rank("x"), "CASE WHEN r IS NOT NULL THEN CASE WHEN m = 1 THEN 0 ELSE least(4, floor((r - 1) / (m - 1)::DOUBLE * (5 - 1e-9)))::INT END END")),
    "group_merge": ("group_merge(bucket(x,3),g)", (*rank("x"), {"b": "CASE WHEN r IS NOT NULL THEN CASE WHEN m = 1 THEN 0 ELSE least(2, floor((r - 1) / (m - 1)::DOUBLE * (3 - 1e-9)))::INT END END"}, "b * ((SELECT max(g) FROM p) + 1) + g")),
    "math_self": ("math_self(x)", "x"), "ts_self": ("ts_self(x)", "x"), "group_self": ("group_self(g)", "g"),
    "neg": ("neg(x)", "-x"), "abs": ("abs(cs_neutralize(x))", "abs(x - avg(x) OVER cs)"), "signal": ("signal(diff(y))", ({"q": "y - lag(y) OVER o"}, "sign(q)::DOUBLE")),
    "power": ("power(cs_scale(x),3)", ({"lo": "min(x) OVER cs", "hi": "max(x) OVER cs"}, "CASE WHEN x IS NOT NULL THEN pow(CASE WHEN lo = hi THEN 0.5 ELSE (x - lo) / (hi - lo) END, 3) END")),
    "signed_power": ("signed_power(cs_zscore(x),2)", ({"q": z("x")}, "sign(q) * q * q")), "sqrt": ("sqrt(diff(x))", ({"q": "x - lag(x) OVER o"}, "CASE WHEN q >= 0 THEN sqrt(q) END")),
    "log": ("log(diff(x))", ({"q": "x - lag(x) OVER o"}, "CASE WHEN q > 0 THEN ln(q) END")), "diff": ("diff(x)", "x - lag(x) OVER o"), "diff_q": ("diff_q(x)", "x / nullif(lag(x) OVER o, 0) - 1"),
    "tanh": ("tanh(cs_zscore(x))", ({"q": z("x")}, "tanh(q)")), "pos_part": ("pos_part(diff(x))", ({"q": "x - lag(x) OVER o"}, "CASE WHEN q > 0 THEN q WHEN q IS NOT NULL THEN 0.0 END")),
    "neg_part": ("neg_part(diff(x))", ({"q": "x - lag(x) OVER o"}, "CASE WHEN q < 0 THEN q WHEN q IS NOT NULL THEN 0.0 END")), "xlogx": ("xlogx(diff(w))", ({"q": "w - lag(w) OVER o"}, XLX.format("q"))),
    "midmap": ("midmap(x)", (*rank("x"), "1 - 2 * abs(u - 0.5)")), "leftmap": ("leftmap(x)", (*rank("x"), "-(" + XLX.format("u") + ")")), "rightmap": ("rightmap(x)", (*rank("x"), {"q": "1 - u"}, "-(" + XLX.format("q") + ")")),
    "extreme_leftmap": ("extreme_leftmap(x)", (*rank("x"), "exp(-pow(u - 0.15, 2))")), "extreme_rightmap": ("extreme_rightmap(x)", (*rank("x"), "exp(-pow(u - 0.85, 2))")),
    "cs_rank": ("cs_rank(w)", (*rank("w"), "u")), "cs_neutralize": ("cs_neutralize(x)", "x - avg(x) OVER cs"), "cs_zscore": ("cs_zscore(x)", z("x")),
    "cs_weighted_zscore": ("cs_weighted_zscore(x,w)", ({"mu": "sum(w * x) OVER cs / nullif(sum(w) OVER cs, 0)", "n": "count(x) OVER cs"}, {"v": "sum(w * pow(x - mu, 2)) OVER cs"}, "CASE WHEN x IS NOT NULL THEN CASE WHEN n = 1 OR v <= 0 THEN 0.0 ELSE (x - mu) / sqrt(v / (n - 1)) END END")),
    "cs_scale": ("cs_scale(x)", "CASE WHEN x IS NOT NULL THEN CASE WHEN max(x) OVER cs = min(x) OVER cs THEN 0.5 ELSE (x - min(x) OVER cs) / (max(x) OVER cs - min(x) OVER cs) END END"),
    "group_rank": ("group_rank(w,g)", (*rank("w", "di, g"), "CASE WHEN g IS NOT NULL THEN u END")), "group_neutralize": ("group_neutralize(x,g)", "x - avg(x) OVER grp"), "group_zscore": ("group_zscore(x,g)", z("x", "grp")),
    "group_scale": ("group_scale(x,g)", "CASE WHEN x IS NOT NULL THEN CASE WHEN max(x) OVER grp - min(x) OVER grp < 1e-8 THEN 0.5 ELSE (x - min(x) OVER grp) / (max(x) OVER grp - min(x) OVER grp) END END"),
    "group_midmap": ("group_midmap(x,g)", (*rank("x", "di, g"), "1 - 2 * abs(u - 0.5)")), "group_leftmap": ("group_leftmap(x,g)", (*rank("x", "di, g"), "-(" + XLX.format("u") + ")")), "group_rightmap": ("group_rightmap(x,g)", (*rank("x", "di, g"), {"q": "1 - u"}, "-(" + XLX.format("q") + ")")),
    "ts_delay": ("ts_delay(x,3)", "lag(x, 3) OVER o"), "ts_lead": ("ts_delay(x,-2)", "lead(x, 2) OVER o"), "ts_delta": ("ts_delta(x,3)", "x - lag(x, 3) OVER o"), "ts_pct": ("ts_pct(x,3)", "x / nullif(lag(x, 3) OVER o, 0) - 1"),
    "ts_rank": ("ts_rank(w,6)", ({"a": "list(w) FILTER (w IS NOT NULL) OVER ts"}, "CASE WHEN w IS NOT NULL AND len(a) >= 3 THEN (len(a) + len(list_filter(a, lambda v: v < w)) - len(list_filter(a, lambda v: v > w)) + 1) / 2.0 / len(a) END")),
    "ts_decay_linear": ("ts_decay_linear(x,6)", ({"a": "list({'x': x, 'd': di}) FILTER (x IS NOT NULL) OVER ts"}, "CASE WHEN x IS NOT NULL THEN list_sum(list_transform(a, lambda s: s.x * (6 - di + s.d))) / list_sum(list_transform(a, lambda s: 6 - di + s.d)) END")),
    "ts_sum": ("ts_sum(x,6)", gated("sum(x) OVER ts")), "ts_mean": ("ts_mean(x,6)", gated("avg(x) OVER ts")), "ts_min": ("ts_min(x,6)", gated("min(x) OVER ts")), "ts_max": ("ts_max(x,6)", gated("max(x) OVER ts")), "ts_range": ("ts_range(x,6)", gated("max(x) OVER ts - min(x) OVER ts")),
    "ts_prod": ("ts_prod(cs_scale(y),6)", ({"lo": "min(y) OVER cs", "hi": "max(y) OVER cs"}, {"q": "CASE WHEN y IS NOT NULL THEN CASE WHEN lo = hi THEN 0.5 ELSE (y - lo) / (hi - lo) END END"}, "CASE WHEN count(q) OVER ts >= 3 THEN product(q) OVER ts END")),
    "ts_var": ("ts_var(w,6)", gated("var_samp(w) OVER ts")), "ts_std": ("ts_std(w,6)", gated("stddev_samp(w) OVER ts")), "ts_median": ("ts_median(x,6)", gated("median(x) OVER ts")),
    "ts_ir": ("ts_ir(x,6)", gated("CASE WHEN min(x) OVER ts < max(x) OVER ts THEN avg(x) OVER ts / stddev_samp(x) OVER ts END")), "ts_zscore": ("ts_zscore(x,6)", gated("CASE WHEN min(x) OVER ts < max(x) OVER ts THEN (x - avg(x) OVER ts) / stddev_samp(x) OVER ts END")),
    "ts_skew": ("ts_skew(x,6)", gated("CASE WHEN count(x) OVER ts > 2 AND min(x) OVER ts < max(x) OVER ts THEN skewness(x) OVER ts END")), "ts_kur": ("ts_kur(x,6)", gated("CASE WHEN count(x) OVER ts > 3 AND min(x) OVER ts < max(x) OVER ts THEN kurtosis(x) OVER ts END")),
    "ts_argmax": ("ts_argmax(w,6)", ({"a": "list({'x': w, 'd': di}) FILTER (w IS NOT NULL) OVER ts"}, "CASE WHEN len(a) >= 3 THEN (di - list_max(a).d + 1)::DOUBLE END")), "ts_argmin": ("ts_argmin(w,6)", ({"a": "list({'x': -w, 'd': di}) FILTER (w IS NOT NULL) OVER ts"}, "CASE WHEN len(a) >= 3 THEN (di - list_max(a).d + 1)::DOUBLE END")),
    "ema1": ("ema1(x,6)", ema(1 - 2 / 7, 3)), "ema2": ("ema2(x,6)", ema(1 - 1 / 7, 3)), "ema3": ("ema3(x,0.3)", ema(1 - 0.3, 2)),
    "wma": ("wma(x,1,2,4)", ({"p1": "lag(x) OVER o", "p2": "lag(x, 2) OVER o"}, "CASE WHEN x IS NOT NULL THEN (4 * x + 2 * coalesce(p1, 0) + coalesce(p2, 0)) / (4 + CASE WHEN p1 IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN p2 IS NOT NULL THEN 1 ELSE 0 END) END")),
    "ts_cut": ("ts_cut(x,y,6)", cut("hi - lo")), "ts_cut_high": ("ts_cut_high(x,y,6)", cut("hi")), "ts_cut_low": ("ts_cut_low(x,y,6)", cut("lo")), "ts_cut_diff": ("ts_cut_diff(x,y,6)", cut("hi - lo")), "ts_cut_normdiff": ("ts_cut_normdiff(x,y,6)", cut("(hi - lo) / nullif(abs(hi) + abs(lo), 0)")), "ts_cut_div": ("ts_cut_div(x,y,6)", cut("hi / nullif(lo, 0)")),
    "adjust_by": ("adjust_by(x,con)", (*rank("x"), "u * CASE WHEN con THEN 1.5 WHEN NOT con THEN 0.5 END")), "reverse_by": ("reverse_by(x,con)", "CASE WHEN con THEN -x WHEN NOT con THEN x END"),
    "reverse_rank_by": ("reverse_rank_by(diff(x),con)", ({"q": "x - lag(x) OVER o"}, *rank("q", "di, con"), "CASE WHEN con IS NOT NULL THEN coalesce(CASE WHEN con THEN u ELSE 1 - u END, 0.0) END")), "trade_when": ("trade_when(x,con)", TRADE),
    "add": ("add(x,y)", "x + y"), "sub": ("sub(x,y)", "x - y"), "mul": ("mul(x,w)", "x * w"), "div": ("div(x,diff(w))", ({"q": "w - lag(w) OVER o"}, "x / nullif(q, 0)")), "safe_div": ("safe_div(x,diff(w))", ({"q": "w - lag(w) OVER o"}, "x / CASE WHEN abs(q) < 0.05 THEN CASE WHEN q >= 0 THEN 0.05 ELSE -0.05 END ELSE q END")),
    "maximum": ("maximum(x,ts_delay(y,1))", ({"q": "lag(y) OVER o"}, "greatest(x, q)")), "minimum": ("minimum(x,ts_delay(y,1))", ({"q": "lag(y) OVER o"}, "least(x, q)")),
    "addr": ("addr(x,y)", (*XY, "ua + ub")), "subr": ("subr(x,y)", (*XY, "ua - ub")), "mulr": ("mulr(x,y)", (*XY, "ua * ub")), "maximumr": ("maximumr(x,y)", (*XY, "greatest(ua, ub)")), "minimumr": ("minimumr(x,y)", (*XY, "least(ua, ub)")),
    "mulz": ("mulz(x,y)", ({"a": z("x"), "b": z("y")}, "CASE WHEN min(x) OVER cs < max(x) OVER cs AND min(y) OVER cs < max(y) OVER cs THEN a * b END")), "mix": ("mix(x,w)", ({"a": z("x"), "b": z("w")}, "CASE WHEN min(x) OVER cs < max(x) OVER cs AND min(w) OVER cs < max(w) OVER cs THEN a * b END")),
    "fd": ("fd(x,y,6,1,2,3,4,'mean')", ({"a": z("x"), "b": z("y")}, {"q": "coalesce(abs(a) * abs(b) * CASE WHEN a > 0 AND b > 0 THEN 1 WHEN a <= 0 AND b > 0 THEN 2 WHEN a <= 0 AND b <= 0 THEN 3 ELSE 4 END, 0.0)"}, "CASE WHEN count(q) OVER ts >= 3 THEN avg(q) OVER ts END")),
    "ts_corr": ("ts_corr(x,y,6)", (PAIR, line("ts"), f"CASE WHEN a IS NOT NULL AND n >= 3 AND va AND vb THEN {CORR} END")),
    "ts_reg": ("ts_reg(x,y,6)", (PAIR, line("ts"), f"CASE WHEN n >= 3 AND va THEN {RESID} END")), "ts_reg_beta": ("ts_reg(x,y,6,1)", (PAIR, line("ts"), f"CASE WHEN n >= 3 AND va THEN {SLOPE} END")), "ts_reg_alpha": ("ts_reg(x,y,6,2)", (PAIR, line("ts"), f"CASE WHEN n >= 3 AND va THEN mb - ({SLOPE}) * ma END")), "ts_reg_r2": ("ts_reg(x,y,6,3)", (PAIR, line("ts"), f"CASE WHEN n >= 3 AND va AND vb THEN pow({CORR}, 2) END")),
    "ts_multireg": ("ts_multireg(x,ts_delay(x,1),y,12)", (*triple("t12"), "CASE WHEN n >= 6 THEN (t - mt) - k1 * (a - ma) - k2 * (b - mb) END")), "cs_multireg": ("cs_multireg(x,ts_delay(x,1),y)", (*triple("cs"), "CASE WHEN n >= 30 THEN (t - mt) - k1 * (a - ma) - k2 * (b - mb) END")),
    "cs_corr": ("cs_corr(x,y)", (PAIR, line("cs"), f"CASE WHEN va AND vb THEN {CORR} END")), "cs_reg": ("cs_reg(x,y)", (PAIR, line("cs"), f"CASE WHEN n >= 30 AND va THEN {RESID} END")), "cs_reg_fit": ("cs_reg(x,y,1)", (PAIR, line("cs"), f"CASE WHEN n >= 30 AND va THEN mb + ({SLOPE}) * (a - ma) END")), "cs_reg_beta": ("cs_reg(x,y,2)", (PAIR, line("cs"), f"CASE WHEN n >= 30 AND va THEN {SLOPE} END")),
    "round": ("round(x,2)", "round(x, 2)"), "if_else": ("if_else(x,w,con)", (*both(rank("x", tag="a"), rank("w", tag="b")), "CASE WHEN con THEN ua WHEN NOT con THEN ub END")), "mask": ("mask(x,con)", "CASE WHEN con THEN x END"),
    "nested": ("group_rank(round(neg(ts_corr(cs_rank(x),cs_rank(y),6)),9),g)", (*XY, {"x1": "CASE WHEN ub IS NOT NULL THEN ua END", "y1": "CASE WHEN ua IS NOT NULL THEN ub END"}, {"n": "count(x1) OVER ts", "va": "min(x1) OVER ts < max(x1) OVER ts", "vb": "min(y1) OVER ts < max(y1) OVER ts", "c1": "covar_pop(x1, y1) OVER ts", "s1": "stddev_pop(x1) OVER ts", "s2": "stddev_pop(y1) OVER ts"}, {"q": "CASE WHEN x1 IS NOT NULL AND n >= 3 AND va AND vb THEN round(-c1 / (s1 * s2), 9) END"}, *rank("q", "di, g"), "u")),
}

AVG = ({"r": "rank() OVER (PARTITION BY di, x IS NULL ORDER BY x)", "k": "count(x) OVER (PARTITION BY di, x)", "n": "count(x) OVER cs"}, {"a": "CASE WHEN x IS NOT NULL THEN r + (k - 1) / 2.0 END"})
P1 = "list({'x': x, 'd': di}) FILTER (x IS NOT NULL) OVER ts"
# the inverse of the normal distribution at p: a rough start, then Newton's steps on the series of the distribution
_SERIES = "list_sum(list_transform(range(0, 100), lambda k: sign({0}) * exp((2 * k + 1) * ln(abs({0})) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)))"
_STEP = "CASE WHEN p = 0.5 THEN 0.0 ELSE {0} - (0.5 - p) * sqrt(2 * pi()) * exp({0} * {0} / 2) - " + _SERIES + " END"
QUANTILE = (
    {"t": "sqrt(-2 * ln(least(p, 1 - p)))"}, {"z0": "sign(p - 0.5) * (t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t))"},
    *({f"z{k + 1}": _STEP.format(f"z{k}")} for k in range(3)), "z3",
)
HELD = "(PARTITION BY sym ORDER BY di ROWS UNBOUNDED PRECEDING)"
CASES |= {
    "RANK": ("RANK(x)", (*AVG, "a / n")), "dsl_cs_rank": ("dsl_cs_rank(w)", ({"xx": "x"}, {"r": "rank() OVER (PARTITION BY di, w IS NULL ORDER BY w)", "k": "count(w) OVER (PARTITION BY di, w)", "n": "count(w) OVER cs"}, "CASE WHEN w IS NOT NULL THEN CASE WHEN n = 1 THEN 0.5 ELSE (r + (k - 1) / 2.0 - 1) / (n - 1) END END")),
    "dsl_group_rank": ("dsl_group_rank(w,g)", ({"r": "rank() OVER (PARTITION BY di, g, w IS NULL ORDER BY w)", "k": "count(w) OVER (PARTITION BY di, g, w)", "n": "count(w) OVER grp"}, "CASE WHEN w IS NOT NULL THEN CASE WHEN n = 1 THEN 0.5 ELSE (r + (k - 1) / 2.0 - 1) / (n - 1) END END")),
    "MEAN": ("MEAN(x)", "avg(x) OVER cs"), "STD": ("STD(x)", "stddev_samp(x) OVER cs"), "SKEW": ("SKEW(w)", ({"m": "avg(w) OVER cs"}, {"s2": "avg(pow(w - m, 2)) OVER cs", "s3": "avg(pow(w - m, 3)) OVER cs"}, "CASE WHEN s2 > 0 THEN s3 / pow(s2, 1.5) END")), "KURT": ("KURT(w)", "CASE WHEN min(w) OVER cs < max(w) OVER cs THEN kurtosis_pop(w) OVER cs END"),
    "MEDIAN": ("MEDIAN(x)", "median(x) OVER cs"), "cs_mean": ("cs_mean(x)", "avg(x) OVER cs"), "cs_std": ("cs_std(x)", "stddev_samp(x) OVER cs"), "cs_sum": ("cs_sum(x)", "sum(x) OVER cs"), "cs_median": ("cs_median(x)", "median(x) OVER cs"), "cs_max": ("cs_max(x)", "max(x) OVER cs"), "cs_min": ("cs_min(x)", "min(x) OVER cs"),
    "ZSCORE": ("ZSCORE(x)", "CASE WHEN min(x) OVER cs < max(x) OVER cs THEN (x - avg(x) OVER cs) / stddev_samp(x) OVER cs END"), "SCALE": ("SCALE(x)", "x / nullif(sum(abs(x)) OVER cs, 0)"), "step": ("step(x)", (*rank("x"), "CASE WHEN u > 0.5 THEN 1.0 ELSE 0.0 END")),
    "winsorize1": ("winsorize1(x,1)", "CASE WHEN x IS NOT NULL THEN greatest(least(x, avg(x) OVER cs + stddev_samp(x) OVER cs), avg(x) OVER cs - stddev_samp(x) OVER cs) END"), "winsorize2": ("winsorize2(x,0.05,0.95)", "CASE WHEN x IS NOT NULL THEN greatest(least(x, quantile_cont(x, 0.95) OVER cs), quantile_cont(x, 0.05) OVER cs) END"),
    "group_mean": ("group_mean(x,g)", "avg(x) OVER grp"), "group_min": ("group_min(x,g)", "min(x) OVER grp"), "group_max": ("group_max(x,g)", "max(x) OVER grp"), "eqw": ("eqw(x,ts_delay(y,1))", ({"q": "lag(y) OVER o"}, {"a": z("x"), "b": z("q")}, "CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END")),
    "cs_pc1": ("cs_pc1(x,w)", (PAIR | {"b": "CASE WHEN x IS NOT NULL THEN w END", "a": "CASE WHEN w IS NOT NULL THEN x END"}, {"za": z("a"), "zb": z("b"), "c": "covar_pop(a, b) OVER cs", "n": "count(a) OVER cs"}, "CASE WHEN n >= 30 THEN (za + sign(c) * zb) / sqrt(2) END")),
    "TS_MAX": ("TS_MAX(x,6)", "max(x) OVER ts"), "TS_MIN": ("TS_MIN(x,6)", "min(x) OVER ts"), "TS_MEAN": ("TS_MEAN(x,6)", "avg(x) OVER ts"), "TS_SUM": ("TS_SUM(x,6)", "sum(x) OVER ts"), "SUMAC": ("SUMAC(x,6)", "sum(x) OVER ts"), "PROD": ("PROD(cs_rank(x),6)", (*rank("x"), "product(u) OVER ts")), "TS_MEDIAN": ("TS_MEDIAN(x,6)", "median(x) OVER ts"),
    "TS_STD": ("TS_STD(x,6)", "stddev_samp(x) OVER ts"), "TS_VAR": ("TS_VAR(w,6)", "var_samp(w) OVER ts"), "TS_ZSCORE": ("TS_ZSCORE(x,6)", "CASE WHEN min(x) OVER ts < max(x) OVER ts THEN (x - avg(x) OVER ts) / stddev_samp(x) OVER ts END"), "SMA": ("SMA(x,6)", "avg(x) OVER ts"),
    "BB_MIDDLE": ("BB_MIDDLE(x,6)", "avg(x) OVER ts"), "BB_UPPER": ("BB_UPPER(x,6)", "avg(x) OVER ts + stddev_samp(x) OVER ts"), "BB_LOWER": ("BB_LOWER(x,6)", "avg(x) OVER ts - stddev_samp(x) OVER ts"), "TS_KURT": ("TS_KURT(x,6)", "CASE WHEN count(x) OVER ts >= 4 AND min(x) OVER ts < max(x) OVER ts THEN kurtosis_pop(x) OVER ts END"),
    "TS_SKEW": ("TS_SKEW(x,6)", ({"a": "list(x) FILTER (x IS NOT NULL) OVER ts"}, {"m": "list_avg(a)"}, {"s2": "list_avg(list_transform(a, lambda v: pow(v - m, 2)))", "s3": "list_avg(list_transform(a, lambda v: pow(v - m, 3)))"}, "CASE WHEN len(a) >= 3 AND list_min(a) < list_max(a) THEN s3 / pow(s2, 1.5) END")),
    "TS_QUANTILE": ("TS_QUANTILE(x,6,0.25)", "quantile_cont(x, 0.25) OVER ts"), "TS_MAD": ("TS_MAD(x,6)", ({"a": "list(x) FILTER (x IS NOT NULL) OVER ts"}, {"m": "list_median(a)"}, "list_median(list_transform(a, lambda v: abs(v - m)))")),
    "TS_ARGMAX": ("TS_ARGMAX(w,6)", ({"a": "list({'x': w, 'd': -di}) FILTER (w IS NOT NULL) OVER ts"}, "di + list_max(a).d")), "TS_ARGMIN": ("TS_ARGMIN(w,6)", ({"a": "list({'x': -w, 'd': -di}) FILTER (w IS NOT NULL) OVER ts"}, "di + list_max(a).d")), "HIGHDAY": ("HIGHDAY(w,6)", ({"a": "list({'x': w, 'd': -di}) FILTER (w IS NOT NULL) OVER ts"}, "di + list_max(a).d + 1")), "LOWDAY": ("LOWDAY(w,6)", ({"a": "list({'x': -w, 'd': -di}) FILTER (w IS NOT NULL) OVER ts"}, "di + list_max(a).d + 1")),
    "DELAY": ("DELAY(x,2)", "lag(x, 2) OVER o"), "DELTA": ("DELTA(x,2)", "x - lag(x, 2) OVER o"), "TS_PCTCHANGE": ("TS_PCTCHANGE(x,2)", "coalesce(x / nullif(lag(x, 2) OVER o, 0) - 1, 0)"), "TS_CORR": ("TS_CORR(x,y,6)", (PAIR, line("ts"), f"CASE WHEN va AND vb THEN {CORR} END")), "TS_COVARIANCE": ("TS_COVARIANCE(w,y,6)", "covar_samp(w, y) OVER ts"),
    "REGBETA": ("REGBETA(y,x,6)", (PAIR, line("ts"), f"CASE WHEN n = 6 AND va THEN {SLOPE} END")), "REGRESI": ("REGRESI(y,x,6)", (PAIR, line("ts"), f"CASE WHEN n = 6 AND va THEN {RESID} END")), "ts_beta": ("ts_beta(y,x,6)", (PAIR, line("ts"), f"CASE WHEN n = 6 AND va THEN {SLOPE} END")),
    "COUNT": ("COUNT(con,6)", "sum(CASE WHEN con THEN 1.0 ELSE 0.0 END) OVER ts"), "SUMIF": ("SUMIF(x,con,6)", "sum(CASE WHEN con THEN x WHEN NOT con THEN 0.0 END) OVER ts"), "FILTER": ("FILTER(x,con)", "CASE WHEN con THEN x WHEN NOT con THEN 0.0 END"), "WHERE": ("WHERE(con,x,y)", "CASE WHEN con THEN x WHEN NOT con THEN y END"),
    "EXP": ("EXP(cs_rank(x))", (*rank("x"), "exp(u)")), "LOG": ("LOG(x)", "ln(1 + x)"), "INV": ("INV(x)", "1 / x"), "FLOOR": ("FLOOR(x)", "floor(x)"), "MAX": ("MAX(x,DELAY(y,1))", ({"q": "lag(y) OVER o"}, "CASE WHEN x IS NOT NULL AND q IS NOT NULL THEN greatest(x, q) END")), "MIN": ("MIN(x,DELAY(y,1))", ({"q": "lag(y) OVER o"}, "CASE WHEN x IS NOT NULL AND q IS NOT NULL THEN least(x, q) END")),
    "GT": ("GT(x,y)", "(x > y)::INT"), "LT": ("LT(x,y)", "(x < y)::INT"), "NE": ("NE(w,y)", "(w <> y)::INT"),
    "hold_when": ("hold_when(x,con)", f"last_value(CASE WHEN con THEN x END IGNORE NULLS) OVER {HELD}"),
    "hold_until": ("hold_until(x,con,LT(y,DELAY(y,1)))", ({"q": "y < lag(y) OVER o"}, {"e": f"last_value(CASE WHEN q THEN struct_pack(v := NULL::DOUBLE) WHEN con AND x IS NOT NULL THEN struct_pack(v := x) END IGNORE NULLS) OVER {HELD}"}, "e.v")),
    "anomaly_past": ("anomaly_past(x,12)", ({"c": "count(x) OVER b", "s": "stddev_pop(x) OVER b", "a": "avg(x) OVER b", "f": "min(x) OVER b < max(x) OVER b"}, "CASE WHEN x IS NOT NULL THEN CASE WHEN c >= 5 AND f THEN (x - a) / s ELSE 0 END END")),
    "protected_div": ("protected_div(x,diff(w))", ({"q": "w - lag(w) OVER o"}, "CASE WHEN abs(q) > 0.001 THEN x / q WHEN q IS NOT NULL AND x IS NOT NULL THEN 1.0 END")), "protected_sqrt": ("protected_sqrt(diff(x))", ({"q": "x - lag(x) OVER o"}, "sqrt(abs(q))")), "protected_log": ("protected_log(diff(w))", ({"q": "w - lag(w) OVER o"}, "CASE WHEN abs(q) > 0.001 THEN ln(abs(q)) WHEN q IS NOT NULL THEN 0.0 END")),
    "protected_inverse": ("protected_inverse(diff(w))", ({"q": "w - lag(w) OVER o"}, "CASE WHEN abs(q) > 0.001 THEN 1 / q WHEN q IS NOT NULL THEN 0.0 END")), "safe_ratio": ("safe_ratio(x,diff(w),-100,100)", ({"q": "w - lag(w) OVER o"}, "CASE WHEN x IS NOT NULL AND abs(q) > 1e-12 THEN least(greatest(x / q, -100), 100) END")),
    "safe_growth": ("safe_growth(diff(x),ts_delay(diff(x),1),-5,5,True)", ({"q": "x - lag(x) OVER o"}, {"b": "lag(q) OVER o"}, "CASE WHEN q IS NOT NULL AND abs(b) > 1e-12 THEN least(greatest((q - b) / abs(b), -5), 5) END")),
    "stability": ("stability(x,6,3)", gated("CASE WHEN min(x) OVER ts < max(x) OVER ts THEN avg(x) OVER ts / stddev_samp(x) OVER ts END")), "sigmoid": ("sigmoid(cs_zscore(x))", ({"q": z("x")}, "1 / (1 + exp(-q))")),
}

FULL = {"a": "list(x) OVER ts", "n": "count(*) OVER ts", "c": "count(x) OVER ts"}


def ewm(c: str, beta: float) -> str:
    """Closed form over the whole history, as list functions over the collected rows."""
    return f"list_sum(list_transform({c}, lambda s: s.x * pow({beta!r}, di - s.d))) / list_sum(list_transform({c}, lambda s: pow({beta!r}, di - s.d)))"


ALL_X = {"l": "list({'x': x, 'd': di}) FILTER (x IS NOT NULL) OVER (PARTITION BY sym ORDER BY di ROWS UNBOUNDED PRECEDING)"}
CASES |= {
    "EMA": ("EMA(x,6)", (ALL_X, ewm("l", 1 - 2 / 7))), "SMA_ewm": ("SMA(x,4,1)", (ALL_X, ewm("l", 0.75))), "MACD": ("MACD(x,3,6)", (ALL_X, {"s": ewm("l", 0.5), "e": ewm("l", 1 - 2 / 7)}, "s - e")),
    "RSI": ("RSI(x,6)", ({"q": "x - lag(x) OVER o"}, {"u": "list({'x': greatest(q, 0), 'd': di}) FILTER (q IS NOT NULL) OVER " + HELD, "f": "list({'x': greatest(-q, 0), 'd': di}) FILTER (q IS NOT NULL) OVER " + HELD}, {"su": ewm("u", 1 - 2 / 7), "sf": ewm("f", 1 - 2 / 7)}, "CASE WHEN sf > 0 THEN 100 - 100 / (1 + su / sf) WHEN sf = 0 AND su > 0 THEN 100.0 END")),
    "PERCENTILE": ("PERCENTILE(x,0.25,6)", "quantile_cont(x, 0.25) OVER ts"), "PERCENTILE_all": ("PERCENTILE(x,0.25)", "quantile_cont(x, 0.25) OVER (PARTITION BY sym)"), "SEQUENCE": ("REGBETA(sqrt(x),SEQUENCE(6),6)", (PAIR | {"a": "CASE WHEN x IS NOT NULL THEN di::DOUBLE END", "b": "sqrt(x)"}, line("ts"), f"CASE WHEN n = 6 AND va THEN {SLOPE} END")),
    "WMA": ("WMA(x,6)", (FULL, "CASE WHEN n = c THEN list_sum(list_transform(range(1, n + 1), lambda i: a[i] * pow(0.9, n - i))) / list_sum(list_transform(range(1, n + 1), lambda i: pow(0.9, n - i))) END")), "DECAYLINEAR": ("DECAYLINEAR(x,6)", (FULL, "CASE WHEN n = c THEN list_sum(list_transform(range(1, n + 1), lambda i: a[i] * i)) / 21 END")),
    "TS_RANK": ("TS_RANK(w,6)", ({"a": "list(w) FILTER (w IS NOT NULL) OVER ts"}, "CASE WHEN w IS NOT NULL THEN (len(a) + len(list_filter(a, lambda v: v < w)) - len(list_filter(a, lambda v: v > w)) + 1) / 2.0 / len(a) END")),
    "nozero_abs": ("nozero_abs(cs_neutralize(x))", "nullif(abs(x - avg(x) OVER cs), 0)"),
    "ADX": ("ADX(add(x,y),sub(x,y),x,4)", ({"h": "x + y", "b": "x - y"}, {"ph": "lag(h) OVER o", "pb": "lag(b) OVER o", "px": "lag(x) OVER o"}, {"u": "coalesce(h - ph, 0)", "d": "coalesce(pb - b, 0)"},
        {"mp": "CASE WHEN h IS NOT NULL THEN CASE WHEN u > d AND u > 0 THEN u ELSE 0 END END", "mm": "CASE WHEN h IS NOT NULL THEN CASE WHEN d > u AND d > 0 THEN d ELSE 0 END END", "mt": "CASE WHEN h IS NOT NULL THEN greatest(h - b, abs(h - px), abs(b - px)) END"},
        *({f"s{k}": f"CASE WHEN m{k} IS NOT NULL THEN list_reduce(list(m{k}) FILTER (m{k} IS NOT NULL) OVER {HELD}, lambda a, v: a * 0.75 + v * 0.25) END"} for k in "pmt"), {"mx": "100 * abs(sp / nullif(st, 0) - sm / nullif(st, 0)) / nullif(sp / nullif(st, 0) + sm / nullif(st, 0), 0)"},
        f"CASE WHEN mx IS NOT NULL THEN list_reduce(list(mx) FILTER (mx IS NOT NULL) OVER {HELD}, lambda a, v: a * 0.75 + v * 0.25) END")),
    "pct": ("pct(x,y)", "x / nullif(y, 0) - 1"), "ts_regression2": ("ts_regression2(y,x,6,1)", (PAIR, line("ts"), f"CASE WHEN n = 6 AND va THEN {SLOPE} END")), "select_time_single": ("select_time_single(x,con)", f"last_value(CASE WHEN con THEN x END IGNORE NULLS) OVER {HELD}"),
    "max_date": ("max(x)", "max(x) OVER cs"), "min_date": ("min(x)", "min(x) OVER cs"), "sumif_place": ("sumif(x,6,con)", "sum(CASE WHEN con THEN x WHEN NOT con THEN 0.0 END) OVER ts"),
}
# names of the matrix dialect that are functions of their own
_HALF = "CASE WHEN n >= 3 THEN {} END"
CASES |= {
    "name_ts_cov": ("ts_cov(x,y,6)", (PAIR, line("ts"), _HALF.format("sab * n / (n - 1.0)"))),
    "name_ts_corr1": ("ts_corr1(x,y,6)", (PAIR, line("ts"), _HALF.format(f"CASE WHEN va AND vb THEN {CORR} END"))), "name_ts_corr2": ("ts_corr2(x,y,6)", (PAIR, line("ts"), _HALF.format(f"CASE WHEN va AND vb THEN {CORR} END"))),
    "matrix_ts_regression": ("matrix_ts_regression(x,y,6)", (PAIR | {"rows": "count(*) OVER ts"}, line("ts"), f"CASE WHEN rows = 6 AND va THEN {SLOPE} END")),
    "matrix_ts_regression_level": ("matrix_ts_regression(x,y,6,1)", (PAIR | {"rows": "count(*) OVER ts"}, line("ts"), f"CASE WHEN rows = 6 AND va THEN mb - ({SLOPE}) * ma END")),
    "matrix_ts_regression_spread": ("matrix_ts_regression(x,y,6,2)", (PAIR | {"rows": "count(*) OVER ts"}, line("ts"), f"CASE WHEN rows = 6 AND va THEN sqrt(greatest(sbb - ({SLOPE}) * sab, 0)) END")),
    "gaussian_rank": ("gaussian_rank(x)", (*AVG, {"p": "CASE WHEN a IS NOT NULL THEN least(greatest(a / n, 1e-6), 1 - 1e-6) END"}, *QUANTILE)),
    "matrix_gaussian_rank": ("matrix_gaussian_rank(x)", (*AVG, {"p": "(a - 0.5) / n"}, *QUANTILE)),
}
# another name of a function: the same query under that name
for _name, _of in ALIASES.items():
    if _of in CASES and f"{_of}(" in CASES[_of][0]:
        CASES[f"name_{_name}"] = (re.sub(rf"(?<!\w){_of}\(", f"{_name}(", CASES[_of][0]), CASES[_of][1])

WINDOWS = "WINDOW cs AS (PARTITION BY di), grp AS (PARTITION BY di, g), o AS (PARTITION BY sym ORDER BY di), ts AS (PARTITION BY sym ORDER BY di ROWS 5 PRECEDING), t12 AS (PARTITION BY sym ORDER BY di ROWS 11 PRECEDING), b AS (PARTITION BY sym ORDER BY di ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


def oracle(parts: Parts | str) -> str:
    parts = (parts,) if isinstance(parts, str) else parts
    ctes, last = [MONTHLY_SQL.strip()], "p"
    for k, layer in enumerate(parts[:-1]):
        ctes.append(f"l{k} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM {last} {WINDOWS})")
        last = f"l{k}"
    return f"WITH {', '.join(ctes)} SELECT date, di, sym, round(CAST({parts[-1]} AS DOUBLE), {DIGITS}) + 0.0 AS v FROM {last} {WINDOWS}"


def _query(formula: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate(monthly_panel(spark, sf_dir), {"v": formula})
        return out.select("date", "di", "sym", (F.round(F.col("v").cast("double"), DIGITS) + 0.0).alias("v"))

    return run


QUERIES = {f"fn_{name}": _query(formula) for name, (formula, _) in CASES.items()}
ORACLES = {f"fn_{name}": oracle(parts) for name, (_, parts) in CASES.items()}

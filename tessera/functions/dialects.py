"""Functions of the infix dialect and of the matrix library, where they differ from the canonical ones: upper-case
names keep partial windows (one row is enough) and average ranks; the others are variants of their own."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F

from .canonical import _zscore, dense, ema, guarded_corr
from .registry import ALL, OPS, alias, all_before, cs, decayed, history, moved_by, op, rolling, rows_of, within


def average_rank(x: Column, *by):
    """Stage: average rank from 1 among present values of the partition: rank of the first tie plus half the rest."""
    own = yield {"r": F.rank().over(Window.partitionBy(*by, x.isNull()).orderBy(x)), "k": F.count(x).over(Window.partitionBy(*by, x)), "n": F.count(x).over(Window.partitionBy(*by))}
    return F.when(x.isNotNull(), own["r"] + (own["k"] - 1) / 2), own["n"]


@op("f")
def RANK(x):
    r, n = yield from average_rank(x, "di")
    return r / n


@op("f")
def dsl_cs_rank(x):
    r, n = yield from average_rank(x, "di")
    return F.when(r.isNotNull(), F.when(n == 1, 0.5).otherwise((r - 1) / (n - 1)))


@op("fg")
def dsl_group_rank(x, g):
    r, n = yield from average_rank(x, "di", g)
    return F.when(r.isNotNull() & g.isNotNull(), F.when(n == 1, 0.5).otherwise((r - 1) / (n - 1)))


# the inverse of the normal distribution, by its rational approximations (fixed values)
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(c, x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + k
    return out


def normal_quantile(p: Column) -> Column:
    """Within 1e-9 relative of the exact quantile for p in (0, 1)."""
    low = lambda q: _poly(_C, F.sqrt(-2 * F.ln(q))) / _poly(_D, F.sqrt(-2 * F.ln(q)))
    mid = p - 0.5
    return F.when(p < 0.02425, low(p)).when(p > 1 - 0.02425, -low(1 - p)).otherwise(mid * _poly(_A, mid * mid) / _poly(_B, mid * mid))


@op("f")
def matrix_gaussian_rank(x):
    """As the matrix library has it: the middle of the rank's step."""
    r, n = yield from average_rank(x, "di")
    return normal_quantile((r - 0.5) / n)


@op("f")
def gaussian_rank(x):
    r, n = yield from average_rank(x, "di")
    return F.when(r.isNotNull(), normal_quantile(F.greatest(F.least(r / n, F.lit(1 - 1e-6)), F.lit(1e-6))))


def _by_date(name: str, measure) -> None:
    op("f", "f", name)(lambda x: measure(x, cs()))


_by_date("MEAN", lambda x, w: F.avg(x).over(w))
_by_date("STD", lambda x, w: F.when(F.count(x).over(w) > 1, F.stddev_samp(x).over(w)))
_by_date("SKEW", lambda x, w: F.when(F.min(x).over(w) < F.max(x).over(w), F.skewness(x).over(w)))
_by_date("KURT", lambda x, w: F.when(F.min(x).over(w) < F.max(x).over(w), F.kurtosis(x).over(w)))
_by_date("MEDIAN", lambda x, w: F.percentile(x, F.lit(0.5)).over(w))
_by_date("cs_mean", lambda x, w: F.avg(x).over(w))
_by_date("cs_std", lambda x, w: F.when(F.count(x).over(w) > 1, F.stddev_samp(x).over(w)))
_by_date("cs_sum", lambda x, w: F.sum(x).over(w))
_by_date("cs_median", lambda x, w: F.percentile(x, F.lit(0.5)).over(w))
_by_date("cs_max", lambda x, w: F.max(x).over(w))
_by_date("cs_min", lambda x, w: F.min(x).over(w))
_by_date("ZSCORE", lambda x, w: F.when(F.min(x).over(w) < F.max(x).over(w), (x - F.avg(x).over(w)) / F.stddev_samp(x).over(w)))


@op("f")
def SCALE(x, target=1.0):
    return x * target / F.nullif(F.sum(F.abs(x)).over(cs()), F.lit(0.0))


@op("f")
def step(x):
    r, m = yield from dense(x, "di")
    return F.when(F.when(m == 1, 0.5).otherwise((r - 1) / (m - 1)) > 0.5, 1.0).otherwise(0.0)


@op("f")
def winsorize1(x, n=4):
    m, s = F.avg(x).over(cs()), F.stddev_samp(x).over(cs()) * n
    return F.when(x.isNotNull(), F.greatest(F.least(x, m + s), m - s))


@op("f")
def winsorize2(x, lower=0.01, upper=0.99):
    q = lambda p: F.percentile(x, F.lit(p)).over(cs())
    return F.when(x.isNotNull(), F.greatest(F.least(x, q(upper)), q(lower)))


for _name, _measure in (("group_mean", F.avg), ("group_min", F.min), ("group_max", F.max)):
    op("fg", "f", _name)(lambda x, g, _m=_measure: F.when(g.isNotNull(), _m(x).over(within(g))))


@op("ff")
def eqw(x, y):
    """Mean of the z-scores that are there."""
    z = yield {"a": _zscore(x, cs()), "b": _zscore(y, cs())}
    known = F.when(z["a"].isNotNull(), 1).otherwise(0) + F.when(z["b"].isNotNull(), 1).otherwise(0)
    return F.when(known > 0, (F.coalesce(z["a"], F.lit(0.0)) + F.coalesce(z["b"], F.lit(0.0))) / known)


@op("ff")
def cs_pc1(x, y, min_cs=30):
    """First principal component of two factors' z-scores, in closed form: with unit variances it is their sum or
    difference over the square root of two, by the sign of their correlation; the sign follows the first factor."""
    both = x.isNotNull() & y.isNotNull()
    p = yield {"a": F.when(both, x), "b": F.when(both, y)}
    z = yield {"a": _zscore(p["a"], cs()), "b": _zscore(p["b"], cs()), "c": guarded_corr(p["a"], p["b"], cs()), "n": F.count(p["a"]).over(cs())}
    return F.when(z["n"] >= int(min_cs), (z["a"] + F.signum(z["c"]) * z["b"]) / math.sqrt(2))


# rolling, one row is enough


def _rolled(name: str, measure, default: int = 5) -> None:
    op("f", "f", name, window=0)(lambda x, p=default: measure(x, rolling(p)))


_rolled("TS_MAX", lambda x, w: F.max(x).over(w))
_rolled("TS_MIN", lambda x, w: F.min(x).over(w))
_rolled("TS_MEAN", lambda x, w: F.avg(x).over(w))
_rolled("TS_SUM", lambda x, w: F.sum(x).over(w))
_rolled("SUMAC", lambda x, w: F.sum(x).over(w), 10)
_rolled("PROD", lambda x, w: F.product(x).over(w))
_rolled("TS_MEDIAN", lambda x, w: F.percentile(x, F.lit(0.5)).over(w))
_rolled("TS_STD", lambda x, w: F.when(F.count(x).over(w) > 1, F.stddev_samp(x).over(w)), 20)
_rolled("TS_VAR", lambda x, w: F.when(F.count(x).over(w) > 1, F.var_samp(x).over(w)))
_rolled("TS_ZSCORE", lambda x, w: F.when(F.min(x).over(w) < F.max(x).over(w), (x - F.avg(x).over(w)) / F.stddev_samp(x).over(w)))
_rolled("BB_MIDDLE", lambda x, w: F.avg(x).over(w), 20)
_rolled("BB_UPPER", lambda x, w: F.avg(x).over(w) + F.stddev_samp(x).over(w), 20)
_rolled("BB_LOWER", lambda x, w: F.avg(x).over(w) - F.stddev_samp(x).over(w), 20)


@op("f", window=0)
def TS_SKEW(x, p=5):
    w = rolling(p)
    return F.when((F.count(x).over(w) >= min(3, int(p))) & (F.min(x).over(w) < F.max(x).over(w)), F.skewness(x).over(w))


@op("f", window=0)
def TS_KURT(x, p=5):
    w = rolling(p)
    return F.when((F.count(x).over(w) >= min(4, int(p))) & (F.min(x).over(w) < F.max(x).over(w)), F.kurtosis(x).over(w))


@op("f", window=0)
def TS_QUANTILE(x, p=5, q=0.5):
    if 0 < p < 1:
        p, q = q, p
    return F.percentile(x, F.lit(float(q))).over(rolling(p))


@op("f", window=0)
def TS_MAD(x, p=5):
    own = yield {"a": F.array_sort(F.collect_list(x).over(rolling(p)))}
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    m = yield {"m": middle(own["a"])}
    off = yield {"d": F.array_sort(F.transform(own["a"], lambda v: F.abs(v - m["m"])))}
    return F.when(F.size(off["d"]) > 0, middle(off["d"]))


def _days_since(name: str, sign: int, first: int) -> None:
    """Rows since the extreme, the oldest of ties."""

    def build(x, p=5):
        best = F.max(F.when(x.isNotNull(), F.struct((x * sign).alias("x"), (-F.col("di")).alias("d")))).over(rolling(p))
        return (F.col("di") + best["d"] + first).cast("double")

    op("f", "f", name, window=0)(build)


_days_since("TS_ARGMAX", 1, 0)
_days_since("TS_ARGMIN", -1, 0)
_days_since("HIGHDAY", 1, 1)
_days_since("LOWDAY", -1, 1)


@op("f", window=0, reach=moved_by("p"))
def DELAY(x, p=1):
    if p < 0:
        raise ValueError("DELAY never looks ahead")
    return F.lag(x, int(p)).over(history())


@op("f", window=0, reach=moved_by("p"))
def DELTA(x, p=1):
    return x - F.lag(x, int(p)).over(history())


@op("f", window=0, reach=moved_by("p"))
def TS_PCTCHANGE(x, p=1):
    return F.coalesce(F.try_divide(x, F.lag(x, int(p)).over(history())) - 1, F.lit(0.0))


@op("ff", window=0)
def TS_CORR(x, y, p=5):
    both = x.isNotNull() & y.isNotNull()
    s = yield {"a": F.when(both, x), "b": F.when(both, y)}
    return guarded_corr(s["a"], s["b"], rolling(p))


@op("ff", window=0)
def ts_cov(x, y, p=5):
    """Of the rows with both, half a window of them at least, whatever today's row holds."""
    both = x.isNotNull() & y.isNotNull()
    s = yield {"a": F.when(both, x), "b": F.when(both, y)}
    enough = F.count(s["a"]).over(rolling(p)) >= max(2, int(p) // 2)
    return F.when(enough, F.covar_samp(s["a"], s["b"]).over(rolling(p)))


@op("ff", window=0)
def ts_corr1(x, y, p=5):
    """Of the rows with both, half a window of them at least, whatever today's row holds."""
    return (yield from OPS["ts_corr"].build(x, y, p, max(1, int(p) // 2), False))


@op("ff", window=0)
def TS_COVARIANCE(x, y, p=5):
    both = x.isNotNull() & y.isNotNull()
    s = yield {"a": F.when(both, x), "b": F.when(both, y)}
    return F.when(F.count(s["a"]).over(rolling(p)) > 1, F.covar_samp(s["a"], s["b"]).over(rolling(p)))


def _whole_window(name: str, out) -> None:
    """Least squares of the first on the second over full windows only."""

    def build(y, x, p=5):
        both = x.isNotNull() & y.isNotNull()
        s = yield {"a": F.when(both, x), "b": F.when(both, y)}
        w = rolling(p)
        beta = F.try_divide(F.covar_samp(s["a"], s["b"]).over(w), F.nullif(F.var_samp(s["a"]).over(w), F.lit(0.0)))
        return F.when((F.count(s["a"]).over(w) == int(p)) & (F.min(s["a"]).over(w) < F.max(s["a"]).over(w)), out(beta, s["a"], s["b"], w))

    op("ff", "f", name, window=0)(build)


@op("ff", window=0)
def matrix_ts_regression(x, y, n, rettype=0):
    """As the matrix library has it, y on x over n rows of the calendar, two with both at least: slope (0), intercept (1)
    or the population deviation of the residuals (2)."""
    both = x.isNotNull() & y.isNotNull()
    s = yield {"a": F.when(both, x), "b": F.when(both, y), "n": F.count(F.lit(1)).over(rolling(n))}
    w = rolling(n)
    beta = F.try_divide(F.covar_pop(s["a"], s["b"]).over(w), F.nullif(F.var_pop(s["a"]).over(w), F.lit(0.0)))
    out = {1: F.avg(s["b"]).over(w) - beta * F.avg(s["a"]).over(w), 2: F.sqrt(F.greatest(F.var_pop(s["b"]).over(w) - beta * F.covar_pop(s["a"], s["b"]).over(w), F.lit(0.0)))}.get(int(rettype), beta)
    return F.when((s["n"] == int(n)) & (F.min(s["a"]).over(w) < F.max(s["a"]).over(w)), out)


_whole_window("REGBETA", lambda k, a, b, w: k)
_whole_window("REGRESI", lambda k, a, b, w: b - F.avg(b).over(w) - k * (a - F.avg(a).over(w)))
_whole_window("ts_beta", lambda k, a, b, w: k)


@op("c", window=0)
def COUNT(con, p=20):
    return F.sum(F.when(con, 1.0).otherwise(0.0)).over(rolling(p))


@op("fc", window=0)
def SUMIF(x, con, p=20):
    return F.sum(F.when(con, x).when(con.isNotNull(), 0.0)).over(rolling(p))


@op("fc")
def FILTER(x, con):
    return F.when(con, x).when(con.isNotNull() & x.isNotNull(), 0.0)


@op("cff")
def WHERE(con, a, b):
    return F.when(con, a).when(~con, b)


@op("f")
def EXP(x):
    return F.when(x.isNotNull(), F.exp(F.least(x, F.lit(700.0))))


@op("f")
def LOG(x):
    """ln(1 + x), as frames have it in this dialect."""
    return F.when(x > -1, F.log1p(x))


@op("f")
def INV(x):
    return F.try_divide(F.lit(1.0), x)


@op("f")
def FLOOR(x):
    return F.floor(x).cast("double")


def _extreme(name: str, along_date, along_row) -> None:
    """One argument: over its date; more: the row's, missing where one of them is."""

    def build(*xs):
        if len(xs) == 1:
            return along_date(xs[0]).over(cs())
        known = xs[0].isNotNull()
        for x in xs[1:]:
            known = known & x.isNotNull()
        return F.when(known, along_row(*xs))

    op("f*", "f", name)(build)


_extreme("MAX", F.max, F.greatest)
_extreme("MIN", F.min, F.least)


for _name, _test in (("GT", lambda x, y: x > y), ("LT", lambda x, y: x < y), ("NE", lambda x, y: x != y)):
    op("ff", "c", _name)(_test)


@op("fc", reach=all_before)
def hold_when(x, con):
    """The value where the condition holds, kept until it holds again."""
    return F.last(F.when(con & x.isNotNull(), x), ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, 0))


@op("fcc", reach=all_before)
def hold_until(x, enter, leave):
    """The value taken on entry, kept until the leaving condition holds."""
    event = F.when(F.coalesce(leave, F.lit(False)), F.struct(F.lit(None).cast("double").alias("v"))).when(enter & x.isNotNull(), F.struct(x.alias("v")))
    return F.last(event, ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, 0))["v"]


@op("f", window=0)
def anomaly_past(x, n=20, least=5):
    """z against the rows before this one; 0 where there are too few."""
    w = history().rowsBetween(-int(n), -1)
    s = F.stddev_pop(x).over(w)
    return F.when(x.isNotNull(), F.when((F.count(x).over(w) >= int(least)) & (F.min(x).over(w) < F.max(x).over(w)), (x - F.avg(x).over(w)) / s).otherwise(0.0))


# primitives of program search, closed over all inputs


@op("ff")
def protected_div(x, y):
    return F.when(F.abs(y) > 0.001, x / F.when(F.abs(y) > 0.001, y)).when(y.isNotNull() & x.isNotNull(), 1.0)


@op("f")
def protected_sqrt(x):
    return F.sqrt(F.abs(x))


@op("f")
def protected_log(x):
    return F.when(F.abs(x) > 0.001, F.ln(F.abs(x))).when(x.isNotNull(), 0.0)


@op("f")
def protected_inverse(x):
    return F.when(F.abs(x) > 0.001, 1 / F.when(F.abs(x) > 0.001, x)).when(x.isNotNull(), 0.0)


@op("f")
def sigmoid(x):
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0)))))


# ratios of reported figures


def _between(x: Column, lower, upper) -> Column:
    x = x if lower is None else F.when(x.isNotNull(), F.greatest(x, F.lit(float(lower))))
    return x if upper is None else F.when(x.isNotNull(), F.least(x, F.lit(float(upper))))


@op("ff")
def safe_ratio(x, y, lower=None, upper=None):
    """x over y, missing where y is nearly nothing, clipped."""
    return _between(F.when(F.abs(y) > 1e-12, x / F.when(F.abs(y) > 1e-12, y)), lower, upper)


@op("ff")
def safe_growth(x, y, lower=None, upper=None, absolute=False):
    """Growth from y to x, over |y| if absolute, clipped."""
    base = F.abs(y) if absolute else y
    return _between(F.when(F.abs(y) > 1e-12, (x - y) / F.when(F.abs(y) > 1e-12, base)), lower, upper)


@op("f", reach=rows_of("n"))
def stability(x, n=12, least=4):
    """Mean over deviation of the last rows."""
    w = rolling(n)
    return F.when((F.count(x).over(w) >= int(least)) & (F.min(x).over(w) < F.max(x).over(w)), F.avg(x).over(w) / F.stddev_samp(x).over(w))


# names of the dialect that are functions of their own, and names that only repeat others


@op("f", window=0, reach=all_before)
def EMA(x, p):
    return (yield from ema(x, 1 - 2 / (1 + int(p)), 1))


@op("f", window=0, reach=lambda given: (int(given["m"]) if given["n"] is None else ALL, 0))
def SMA(x, m=5, n=None):
    """Mean of the last m rows; with n, an exponential mean of which each row takes n / m."""
    if n is None:
        return F.avg(x).over(rolling(m))
    return (yield from ema(x, 1 - n / m, 1))


@op("f", reach=all_before)
def MACD(x, short_window=12, long_window=26):
    """Short exponential mean less the long one."""
    short = yield from ema(x, 1 - 2 / (1 + int(short_window)), 1)
    both = yield {"a": short}
    long = yield from ema(x, 1 - 2 / (1 + int(long_window)), 1)
    return both["a"] - long


@op("f", reach=all_before)
def RSI(x, window=14):
    """Relative strength: 100 where nothing fell, missing where nothing moved."""
    step = yield {"d": x - F.lag(x, 1).over(history())}
    up = yield from ema(F.greatest(step["d"], F.lit(0.0)) + step["d"] * 0, 1 - 2 / (1 + int(window)), 1)
    rise = yield {"u": up}
    fall = yield {"f": (yield from ema(F.greatest(-step["d"], F.lit(0.0)) + step["d"] * 0, 1 - 2 / (1 + int(window)), 1))}
    u, f = rise["u"], fall["f"]
    return F.when(f > 0, 100 - 100 / (1 + u / F.when(f > 0, f))).when((f == 0) & (u > 0), 100.0)


@op("f", window=1, reach=lambda given: (ALL, ALL) if given["p"] is None else (int(given["p"]), 0))
def PERCENTILE(x, q, p=None):
    """Quantile of a symbol's last p rows, or of its whole history."""
    return F.percentile(x, F.lit(float(q))).over(rolling(p) if p is not None else Window.partitionBy("sym"))


@op("")
def SEQUENCE(n):
    """1 to n as a regressor of windows of n rows; as such a line in the calendar is the same."""
    return F.col("di").cast("double")


def _folded(name: str, start, step, out) -> None:
    """Over the last p rows, all of which must be there."""

    def build(x, p=None):
        p = int(p or start)
        own = yield {"a": F.collect_list(x).over(rolling(p)), "n": F.count(F.lit(1)).over(rolling(p))}
        return F.when(F.size(own["a"]) == own["n"], out(step(own["a"]), own["n"], p))

    op("f", "f", name, window=0, reach=rows_of("p", start))(build)


_folded("WMA", 20, lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s * 0.9 + v), lambda s, n, p: s * 0.1 / (1 - F.pow(F.lit(0.9), n)))
# weights 1 to p from the oldest row on, over the sum of all p of them
_folded("DECAYLINEAR", 5, lambda a: F.aggregate(F.transform(a, lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v), lambda s, n, p: s / (p * (p + 1) / 2))


@op("f", window=0)
def TS_RANK(x, p=5):
    return (yield from OPS["ts_rank"].build(x, p, 1))


@op("ff")
def pct(x, y):
    return F.try_divide(x, y) - 1


@op("ff", window=0)
def ts_regression2(y, x, p=5, rettype=0):
    return (yield from OPS["REGBETA" if rettype == 1 else "REGRESI"].build(y, x, p))


@op("fc", reach=all_before)
def select_time_single(x, con, d=0.2):
    return OPS["hold_when"].build(x, con)


@op("f")
def nozero_abs(x):
    return F.nullif(F.abs(x), F.lit(0.0))


def _smoothed(x, alpha):
    """Stages: y = (1 - alpha) y + alpha x from row to row where x is there; the first x begins it."""
    place = yield {"p": F.count(x).over(history().rowsBetween(Window.unboundedPreceding, 0)) - 1, "k": x.isNotNull()}
    moved = yield from decayed({"v": F.when(place["p"] == 0, x).otherwise(x * alpha)}, 1 - alpha, F.greatest(place["p"], F.lit(0)), "sym", place["k"])
    return F.when(place["k"], moved["v"])


@op("fff", reach=all_before)
def ADX(high, low, close, n=14):
    """Average directional index, smoothed by one over n."""
    prev = yield {k: F.lag(c, 1).over(history()) for k, c in (("h", high), ("l", low), ("c", close))}
    up, down = F.coalesce(high - prev["h"], F.lit(0.0)), F.coalesce(prev["l"] - low, F.lit(0.0))
    known = high.isNotNull() & low.isNotNull()
    move = yield {
        "p": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)), "m": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)),
        "t": F.when(known, F.greatest(high - low, F.abs(high - prev["c"]), F.abs(low - prev["c"]))),
    }
    true_range = yield {"t": (yield from _smoothed(move["t"], 1 / n))}
    plus = yield {"p": (yield from _smoothed(move["p"], 1 / n))}
    minus = yield {"m": (yield from _smoothed(move["m"], 1 / n))}
    a, b = F.try_divide(plus["p"], true_range["t"]), F.try_divide(minus["m"], true_range["t"])
    index = yield {"x": 100 * F.try_divide(F.abs(a - b), a + b)}
    return (yield from _smoothed(index["x"], 1 / n))


#: Other names of functions.
ALIASES = {
    "ABS": "abs", "SIGN": "signal", "sign": "signal", "SQRT": "sqrt", "POW": "power", "exp": "EXP", "inv": "INV", "floor": "FLOOR", "ADD": "add", "SUBTRACT": "sub", "MULTIPLY": "mul", "DIVIDE": "div", "divide": "div",
    "AND": "con_and", "OR": "con_or", "EQ": "eq", "GE": "ge", "LE": "le", "where": "WHERE", "IF_ELSE": "WHERE", "ifelse": "WHERE", "pos": "pos_part", "last": "math_self", "regime_switch": "math_self",
    "mean": "cs_mean", "std": "cs_std", "skew": "SKEW", "kurt": "KURT", "median": "cs_median", "rank": "dsl_cs_rank", "max": "MAX", "min": "MIN", "delay": "DELAY", "delta": "DELTA", "ts_return": "ts_pct",
    "ts_corr2": "ts_corr1", "ts_mad": "TS_MAD", "ts_quantile": "TS_QUANTILE", "percentile": "PERCENTILE", "highday": "HIGHDAY", "lowday": "LOWDAY", "sumac": "SUMAC", "sma": "SMA", "count": "COUNT", "sumif": "SUMIF",
    "filter": "FILTER", "sequence": "SEQUENCE", "regbeta": "REGBETA", "regresi": "REGRESI", "ts_regression": "REGBETA", "rsi": "RSI", "macd": "MACD", "bb_middle": "BB_MIDDLE", "bb_upper": "BB_UPPER", "bb_lower": "BB_LOWER",
}
for _name, _of in ALIASES.items():
    alias(_name, _of)

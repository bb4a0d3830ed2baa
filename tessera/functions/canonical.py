"""The canonical function library over panels: conditions, groups, math, cross-section, group, rolling, conditioned
and two-factor functions. Missing is NULL; windows count rows of the dense calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, functions as F

from .registry import Whole, all_before, clean, cs, decayed, everything, gate, history, moved_by, op, periods, rolling, within

# conditions: nullable booleans, so AND, OR and NOT are three-valued as they are


@op("ff", "c")
def eq(x, y):
    return x == y


@op("ff", "c")
def le(x, y):
    return x <= y


@op("ff", "c")
def ge(x, y):
    return x >= y


@op("cc", "c")
def con_and(a, b):
    return a & b


@op("cc", "c")
def con_or(a, b):
    return a | b


@op("c", "c")
def con_not(a):
    return ~a


# dense ranks, from which buckets and maps follow


def dense(x: Column, *by):
    """Stages: dense rank from 1 among present values of the partition, and the number of distinct values."""
    ranks = yield {"r": F.when(x.isNotNull(), F.dense_rank().over(Window.partitionBy(*by, x.isNull()).orderBy(x)))}
    most = yield {"m": F.max(ranks["r"]).over(Window.partitionBy(*by))}
    return ranks["r"], most["m"]


def unit_rank(x: Column, *by):
    """Dense rank scaled to 0..1; 0.5 where there is one distinct value."""
    r, m = yield from dense(x, *by)
    return F.when(r.isNotNull(), F.when(m == 1, 0.5).otherwise((r - 1) / (m - 1)))


@op("f", "g")
def bucket(x, n):
    r, m = yield from dense(x, "di")
    return F.when(r.isNotNull(), F.when(m == 1, 0).otherwise(F.least(F.floor((r - 1) / (m - 1) * (n - 1e-9)), F.lit(int(n) - 1)))).cast("int")


@op("gg", "g", reach=everything)
def group_merge(a, b):
    """a and b as one code, whose base is the greatest b of the whole panel."""
    whole = yield {"g": Whole(F.max(b))}
    return a * (whole["g"] + 1) + b


@op("f")
def math_self(x):
    return x


@op("f")
def ts_self(x):
    return x


@op("g", "g")
def group_self(g):
    return g


@op("f")
def neg(x):
    return -x


@op("f")
def abs_(x):
    return F.abs(x)


@op("f")
def round_(x, digits=9):
    """Half away from zero; before a rank it makes values equal that differ by the order of their sums alone."""
    return F.round(x, int(digits))


@op("f")
def signal(x):
    return F.signum(x)


@op("f")
def power(x, p=2):
    return clean(F.pow(x, F.lit(float(p))))


@op("f")
def signed_power(x, p=2):
    return clean(F.signum(x) * F.pow(F.abs(x), F.lit(float(p))))


@op("f")
def sqrt(x):
    return F.when(x >= 0, F.sqrt(x))


@op("f")
def log(x):
    return F.when(x > 0, F.ln(x))


@op("f", reach=lambda given: (1, 0))
def diff(x):
    return x - F.lag(x, 1).over(history())


@op("f", reach=lambda given: (1, 0))
def diff_q(x):
    return F.try_divide(x, F.lag(x, 1).over(history())) - 1


@op("f")
def tanh(x):
    return F.tanh(x)


@op("f")
def pos_part(x):
    return F.when(x > 0, x).when(x.isNotNull(), 0.0)


@op("f")
def neg_part(x):
    return F.when(x < 0, x).when(x.isNotNull(), 0.0)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).when(x.isNotNull(), 0.0)


@op("f")
def xlogx(x):
    return _xlogx(x)


def _mapped(name: str, shape, grouped: bool = False) -> None:
    """A function of the unit rank, by date or by date and group."""

    def by_date(x):
        rank = yield {"u": (yield from unit_rank(x, "di"))}
        return shape(rank["u"])

    def by_group(x, g):
        rank = yield {"u": F.when(g.isNotNull(), (yield from unit_rank(x, "di", g)))}
        return shape(rank["u"])

    op("fg" if grouped else "f", "f", name)(by_group if grouped else by_date)


def _mid(u: Column) -> Column:
    return 1 - 2 * F.abs(u - 0.5)


for _prefix, _grouped in (("", False), ("group_", True)):
    _mapped(f"{_prefix}midmap", _mid, _grouped)
    _mapped(f"{_prefix}leftmap", lambda u: -_xlogx(u), _grouped)
    _mapped(f"{_prefix}rightmap", lambda u: -_xlogx(1 - u), _grouped)
_mapped("extreme_leftmap", lambda u: F.exp(-(u - 0.15) * (u - 0.15)))
_mapped("extreme_rightmap", lambda u: F.exp(-(u - 0.85) * (u - 0.85)))
_mapped("group_rank", lambda u: u, True)

# cross-section


@op("f")
def cs_rank(x, pct=True, ascending=True):
    if not pct:
        r, m = yield from dense(x, "di")
        return (r if ascending else m + 1 - r).cast("double")
    u = yield from unit_rank(x, "di")
    return u if ascending else 1 - u


@op("f")
def cs_neutralize(x):
    return x - F.avg(x).over(cs())


def _zscore(x: Column, w, keep: Column | None = None) -> Column:
    """0 where there is one value or no spread, decided by the extremes rather than a rounded variance."""
    flat = (F.count(x).over(w) == 1) | (F.min(x).over(w) == F.max(x).over(w))
    return F.when(x.isNotNull() if keep is None else keep, F.when(flat, 0.0).otherwise((x - F.avg(x).over(w)) / F.stddev_samp(x).over(w)))


@op("f")
def cs_zscore(x):
    return _zscore(x, cs())


@op("ff")
def cs_weighted_zscore(x, w):
    both = yield {"x": F.when(w.isNotNull(), x), "w": F.when(x.isNotNull(), w)}
    x, w = both["x"], both["w"]
    mean = yield {"m": F.try_divide(F.sum(x * w).over(cs()), F.sum(w).over(cs())), "n": F.count(x).over(cs())}
    spread = yield {"v": F.when(mean["n"] > 1, F.sum(w * (x - mean["m"]) * (x - mean["m"])).over(cs()) / (mean["n"] - 1))}
    return F.when(x.isNotNull() & mean["m"].isNotNull(), F.when((mean["n"] == 1) | (spread["v"] <= 0), 0.0).otherwise((x - mean["m"]) / F.sqrt(spread["v"])))


def _scaled(x: Column, w, least: float) -> Column:
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNotNull(), F.when(hi - lo <= least, 0.5).otherwise((x - lo) / (hi - lo)))


@op("f")
def cs_scale(x):
    return _scaled(x, cs(), 0.0)


@op("fg")
def group_neutralize(x, g):
    return F.when(g.isNotNull(), x - F.avg(x).over(within(g)))


@op("fg")
def group_zscore(x, g):
    return _zscore(x, within(g), x.isNotNull() & g.isNotNull())


@op("fg")
def group_scale(x, g):
    return F.when(g.isNotNull(), _scaled(x, within(g), 1e-8))


# rolling windows


def shifted(x: Column, n) -> Column:
    n = int(n)
    return F.lag(x, n).over(history()) if n >= 0 else F.lead(x, -n).over(history())


@op("f", window=0, reach=moved_by("n"))
def ts_delay(x, n):
    return shifted(x, n)


@op("f", window=0, reach=moved_by("n"))
def ts_delta(x, n):
    return x - shifted(x, n)


@op("f", window=0, reach=moved_by("n"))
def ts_pct(x, n):
    return F.try_divide(x, shifted(x, n)) - 1


@op("f", window=0)
def ts_rank(x, n, min_periods=None, pct=True):
    own = yield {"a": F.collect_list(x).over(rolling(n))}
    a = own["a"]
    rank = (F.size(a) + F.size(F.filter(a, lambda v: v < x)) - F.size(F.filter(a, lambda v: v > x)) + 1) / 2
    return F.when(x.isNotNull() & (F.size(a) >= periods(n, min_periods)), rank / F.size(a) if pct else rank)


@op("f", window=0)
def ts_decay_linear(x, n):
    w, t = rolling(n), F.col("di").cast("double")
    seen = F.when(x.isNotNull(), t)
    base = t - int(n)
    return F.when(x.isNotNull(), (F.sum(x * t).over(w) - base * F.sum(x).over(w)) / (F.sum(seen).over(w) - base * F.count(x).over(w)))


def _plain(name: str, measure) -> None:
    op("f", "f", name, window=0)(lambda x, n, min_periods=None: gate(x, n, min_periods, measure(x, rolling(n))))


_plain("ts_sum", lambda x, w: F.sum(x).over(w))
_plain("ts_prod", lambda x, w: F.product(x).over(w))
_plain("ts_mean", lambda x, w: F.avg(x).over(w))
_plain("ts_min", lambda x, w: F.min(x).over(w))
_plain("ts_max", lambda x, w: F.max(x).over(w))
_plain("ts_range", lambda x, w: F.max(x).over(w) - F.min(x).over(w))
_plain("ts_median", lambda x, w: F.percentile(x, F.lit(0.5)).over(w))
_plain("ts_var", lambda x, w: F.when(F.count(x).over(w) > 1, F.var_samp(x).over(w)))
_plain("ts_std", lambda x, w: F.when(F.count(x).over(w) > 1, F.stddev_samp(x).over(w)))


def _spread(x: Column, w) -> Column:
    """Rolling deviation, NULL where it is nothing but noise."""
    s = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) > 1) & (F.min(x).over(w) < F.max(x).over(w)) & (s > 1e-10), s)


_plain("ts_ir", lambda x, w: F.avg(x).over(w) / _spread(x, w))


@op("f", window=0)
def ts_zscore(x, n, min_periods=None):
    w = rolling(n)
    return gate(x, n, min_periods, (x - F.avg(x).over(w)) / _spread(x, w))


@op("f", window=0)
def ts_skew(x, n, min_periods=None):
    w = rolling(n)
    c = F.count(x).over(w)
    ok = (c > 2) & (F.min(x).over(w) < F.max(x).over(w))
    return gate(x, n, min_periods, F.when(ok, F.sqrt(c * (c - 1)) / F.greatest(c - 2, F.lit(1)) * F.skewness(x).over(w)))


@op("f", window=0)
def ts_kur(x, n, min_periods=None):
    w = rolling(n)
    c = F.count(x).over(w)
    ok = (c > 3) & (F.min(x).over(w) < F.max(x).over(w))
    return gate(x, n, min_periods, F.when(ok, (c - 1) / F.greatest((c - 2) * (c - 3), F.lit(1)) * ((c + 1) * F.kurtosis(x).over(w) + 6)))


def _place(name: str, sign: int) -> None:
    def build(x, n, min_periods=None):
        best = F.max(F.when(x.isNotNull(), F.struct((x * sign).alias("x"), F.col("di").alias("di")))).over(rolling(n))
        return gate(x, n, min_periods, (F.col("di") - best["di"] + 1).cast("double"))

    op("f", "f", name, window=0)(build)


_place("ts_argmax", 1)
_place("ts_argmin", -1)


def ema(x: Column, beta: float, least: int):
    """Stages: adjusted exponential mean over all rows so far; a missing value leaves it as it is."""
    sums = yield from decayed({"s": x, "w": F.when(x.isNotNull(), 1.0)}, beta, F.col("di"), "sym")
    here = yield {"v": F.when(x.isNotNull(), sums["s"] / sums["w"])}
    to_here = history().rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(x).over(to_here) >= least, F.last(here["v"], ignorenulls=True).over(to_here))


@op("f", window=0, reach=all_before)
def ema1(x, n, min_periods=None):
    return (yield from ema(x, 1 - 2 / (1 + n), periods(n, min_periods)))


@op("f", window=0, reach=all_before)
def ema2(x, n, min_periods=None):
    return (yield from ema(x, 1 - 1 / (1 + n), periods(n, min_periods)))


@op("f", reach=all_before)
def ema3(x, alpha, min_periods=None):
    return (yield from ema(x, 1 - alpha, 2 if min_periods is None else int(min_periods)))


@op("f", reach=lambda given: (len(given["weights"]), 0))
def wma(x, *weights):
    """Weights from the oldest row to the newest."""
    shifts = yield {f"s{k}": F.lag(x, k).over(history()) for k in range(len(weights))}
    pairs = [(shifts[f"s{k}"], float(w)) for k, w in enumerate(reversed(weights))]
    top = reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0.0)) * w for s, w in pairs))
    low = reduce(lambda a, b: a + b, (F.when(s.isNotNull(), w).otherwise(0.0) for s, w in pairs))
    return F.when(x.isNotNull(), F.try_divide(top, low))


# conditioned


def _cut(name: str, take) -> None:
    def build(x, y, n, hq=0.5, min_periods=None):
        known = x.isNotNull() & y.isNotNull()
        own = yield {"a": F.array_sort(F.collect_list(F.when(known, F.struct(y.alias("y"), F.col("di").alias("di"), x.alias("x")))).over(rolling(n)))}
        size = F.size(own["a"])
        top = F.floor(size * hq).cast("int")
        mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v["x"]), F.size(a).cast("double"))
        part = yield {"h": mean(F.slice(own["a"], size - top + 1, top)), "l": mean(F.slice(own["a"], 1, size - top)), "n": size}
        return F.when(part["n"] >= periods(n, min_periods), take(part["h"], part["l"]))

    op("ff", "f", name, window=0)(build)


_cut("ts_cut_high", lambda h, l: h)
_cut("ts_cut_low", lambda h, l: l)
_cut("ts_cut_diff", lambda h, l: h - l)
_cut("ts_cut", lambda h, l: h - l)
_cut("ts_cut_normdiff", lambda h, l: F.try_divide(h - l, F.abs(h) + F.abs(l)))
_cut("ts_cut_div", lambda h, l: F.try_divide(h, l))


@op("fc")
def adjust_by(x, con, d=0.5):
    u = yield from unit_rank(x, "di")
    return u * F.when(con, 1 + d).when(~con, 1 - d)


@op("fc")
def reverse_by(x, con):
    return F.when(con, -x).when(~con, x)


@op("fc")
def reverse_rank_by(x, con):
    """A missing x under a known condition gives 0."""
    u = yield {"u": (yield from unit_rank(x, "di", con))}
    return F.when(con.isNotNull(), F.coalesce(F.when(con, u["u"]).otherwise(1 - u["u"]), F.lit(0.0)))


@op("fc", reach=all_before)
def trade_when(x, con, q=0.2):
    """Rank held where the condition is false, moving by q; set anew where it is true. Each stretch from one setting to
    the next is a geometric sum of its own."""
    rank = yield {"v": (yield from unit_rank(x, "di"))}
    v = rank["v"]
    ok = con.isNotNull() & v.isNotNull()
    to_here = history().rowsBetween(Window.unboundedPreceding, 0)
    seen = yield {"c": F.sum(F.when(ok, 1).otherwise(0)).over(to_here)}
    starts = yield {"s": F.sum(F.when(ok & (con | (seen["c"] == 1)), 1).otherwise(0)).over(to_here)}
    piece = Window.partitionBy("sym", starts["s"]).orderBy("di").rowsBetween(Window.unboundedPreceding, 0)
    step = yield {"m": F.sum(F.when(ok, 1).otherwise(0)).over(piece) - 1}
    # rows that do not count add nothing and share the place of the one before
    place = yield {"p": F.greatest(step["m"], F.lit(0)), "v": F.when(ok, F.when(step["m"] == 0, v).otherwise(v * q)), "s": starts["s"], "ok": ok}
    moved = yield from decayed({"v": place["v"]}, 1 - q, place["p"], "sym", place["s"], place["ok"])
    return F.when(ok, moved["v"])


# two factors


@op("ff")
def add(x, y):
    return x + y


@op("ff")
def sub(x, y):
    return x - y


@op("ff")
def mul(x, y):
    return x * y


@op("ff")
def div(x, y):
    return F.try_divide(x, y)


@op("ff")
def safe_div(x, y, eps=0.05):
    return x / F.when(F.abs(y) < eps, F.when(y >= 0, eps).otherwise(-eps)).otherwise(y)


@op("ff")
def maximum(x, y):
    return F.greatest(x, y)


@op("ff")
def minimum(x, y):
    return F.least(x, y)


def _ranked(name: str, join) -> None:
    def build(x, y):
        u = yield {"a": (yield from unit_rank(x, "di")), "b": (yield from unit_rank(y, "di"))}
        return join(u["a"], u["b"])

    op("ff", "f", name)(build)


_ranked("addr", lambda a, b: a + b)
_ranked("subr", lambda a, b: a - b)
_ranked("mulr", lambda a, b: a * b)
_ranked("maximumr", lambda a, b: F.greatest(a, b))
_ranked("minimumr", lambda a, b: F.least(a, b))


def _product(x, y):
    """Product of z-scores; a date where either has no spread is missing whole."""
    spread = lambda c: (F.count(c).over(cs()) > 1) & (F.min(c).over(cs()) < F.max(c).over(cs()))
    z = yield {"a": _zscore(x, cs()), "b": _zscore(y, cs()), "ok": spread(x) & spread(y)}
    return F.when(z["ok"], z["a"] * z["b"])


op("ff", "f", "mulz")(_product)
op("ff", "f", "mix")(_product)


@op("ff", window=0)
def fd(x, y, n, w1, w2, w3, w4, method="decay"):
    """Four-quadrant product: |z(x)| |z(y)| times the quadrant's weight (x and y up, x down, both down, y down),
    missing 0, then the decayed or plain mean over n rows."""
    z = yield {"a": _zscore(x, cs()), "b": _zscore(y, cs())}
    a, b = z["a"], z["b"]
    quadrant = F.when((a > 0) & (b > 0), w1).when((a <= 0) & (b > 0), w2).when((a <= 0) & (b <= 0), w3).otherwise(w4)
    own = yield {"v": F.coalesce(F.abs(a) * F.abs(b) * quadrant, F.lit(0.0))}
    return ts_decay_linear(own["v"], n) if method == "decay" else gate(own["v"], n, None, F.avg(own["v"]).over(rolling(n)))


def _paired(x: Column, y: Column) -> dict[str, Column]:
    both = x.isNotNull() & y.isNotNull()
    return {"x": F.when(both, x), "y": F.when(both, y)}


def guarded_corr(x: Column, y: Column, over) -> Column:
    """Pearson's correlation where both sides vary."""
    varied = (F.min(x).over(over) < F.max(x).over(over)) & (F.min(y).over(over) < F.max(y).over(over))
    return F.when(varied, F.try_divide(F.covar_samp(x, y).over(over), F.stddev_samp(x).over(over) * F.stddev_samp(y).over(over)))


@op("ff", window=0)
def ts_corr(x, y, n, min_periods=None, hold_nan=True):
    p = yield _paired(x, y)
    out = gate(p["x"], n, min_periods, guarded_corr(p["x"], p["y"], rolling(n)))
    return F.when(p["x"].isNotNull(), out) if hold_nan else out


def _line(x: Column, y: Column, over) -> tuple[Column, Column, Column, Column]:
    """Slope, intercept, R2, and whether x varies, of y on x."""
    varied = F.min(x).over(over) < F.max(x).over(over)
    slope = F.try_divide(F.covar_samp(x, y).over(over), F.var_samp(x).over(over))
    r = guarded_corr(x, y, over)
    return F.when(varied, slope), F.when(varied, F.avg(y).over(over) - slope * F.avg(x).over(over)), r * r, varied


@op("ff", window=0)
def ts_reg(x, y, n, rettype=0, min_periods=None):
    p = yield _paired(x, y)
    b, a, r2, _ = _line(p["x"], p["y"], rolling(n))
    out = {1: b, 2: a, 3: r2}.get(int(rettype), p["y"] - (b * p["x"] + a))
    return gate(p["x"], n, min_periods, out)


@op("ff")
def cs_corr(x, y):
    p = yield _paired(x, y)
    return guarded_corr(p["x"], p["y"], cs())


@op("ff")
def cs_reg(x, y, rettype=0, min_cs=30):
    p = yield _paired(x, y)
    b, a, _, _ = _line(p["x"], p["y"], cs())
    out = {0: p["y"] - (b * p["x"] + a), 1: b * p["x"] + a, 2: b, 3: a}[int(rettype)]
    return F.when(F.count(p["x"]).over(cs()) >= int(min_cs), out)


def _two_regressors(x1, x2, y, over, least):
    """Residual of y on x1 and x2 with intercept: the normal equations of centred sums, in closed form."""
    known = x1.isNotNull() & x2.isNotNull() & y.isNotNull()
    p = yield {"a": F.when(known, x1), "b": F.when(known, x2), "y": F.when(known, y)}
    cov = lambda u, v: F.covar_samp(p[u], p[v]).over(over)
    s = yield {"aa": cov("a", "a"), "bb": cov("b", "b"), "ab": cov("a", "b"), "ay": cov("a", "y"), "by": cov("b", "y"), "ma": F.avg(p["a"]).over(over), "mb": F.avg(p["b"]).over(over), "my": F.avg(p["y"]).over(over), "yy": cov("y", "y"), "n": F.count(p["a"]).over(over)}
    det = s["aa"] * s["bb"] - s["ab"] * s["ab"]
    det = F.when(det > 1e-10 * s["aa"] * s["bb"], det)
    k = yield {"k1": (s["ay"] * s["bb"] - s["by"] * s["ab"]) / det, "k2": (s["by"] * s["aa"] - s["ay"] * s["ab"]) / det}
    residual = (p["y"] - s["my"]) - k["k1"] * (p["a"] - s["ma"]) - k["k2"] * (p["b"] - s["mb"])
    explained = k["k1"] * s["ay"] + k["k2"] * s["by"]
    return F.when(s["n"] >= least, residual), F.when((s["n"] >= least) & (s["yy"] > 0), explained / F.when(s["yy"] > 0, s["yy"]))


@op("fff", window=0)
def ts_multireg(x1, x2, y, n, rettype=0, min_periods=None):
    residual, r2 = yield from _two_regressors(x1, x2, y, rolling(n), periods(n, min_periods))
    return r2 if int(rettype) == 3 else residual


@op("fff")
def cs_multireg(x1, x2, y, min_cs=30):
    residual, _ = yield from _two_regressors(x1, x2, y, cs(), int(min_cs))
    return residual


@op("ffc")
def if_else(a, b, con):
    """The ranks of a where the condition holds, of b where it doesn't."""
    u = yield {"a": (yield from unit_rank(a, "di")), "b": (yield from unit_rank(b, "di"))}
    return F.when(con, u["a"]).when(~con, u["b"])


@op("fc")
def mask(x, con):
    return F.when(con, x)

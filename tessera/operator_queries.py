"""Queries for the operators over panels, events, stores, vectors and bars, each with SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .operators import asof, evaluation, fitness, minute, quality, similarity, store, styles, weights
from .plans.formula import evaluate
from .plans.infix import parse_infix
from .plans.splits import fixed_dates, labelled_parts, rolling_ranges, walk_forward
from .sources.panels import MINUTE_SQL, MONTHLY_SQL, minute_bars, monthly_panel, read
from .streaming.bars import sessions

DIGITS = 6


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _values(spark: SparkSession, sf_dir: str, formula: str = "group_rank(neg(diff_q(x)),g)") -> DataFrame:
    """The formula's value and the return two dates on."""
    return evaluate(monthly_panel(spark, sf_dir), {"v": formula, "ret": "ts_delay(diff_q(x),-2)"})


_W = "WINDOW cs AS (PARTITION BY di), o AS (PARTITION BY sym ORDER BY di)"
_UNIT = "CASE WHEN {c} IS NOT NULL THEN CASE WHEN max({r}) OVER (PARTITION BY {by}) = 1 THEN 0.5 ELSE ({r} - 1) / (max({r}) OVER (PARTITION BY {by}) - 1)::DOUBLE END END"
_VALUES = f"""{MONTHLY_SQL.strip()},
a AS (SELECT date, di, sym, g, x / nullif(lag(x) OVER o, 0) - 1 AS q FROM p {_W}),
b AS (SELECT *, lead(q, 2) OVER o AS ret, dense_rank() OVER (PARTITION BY di, g, q IS NULL ORDER BY -q) AS r FROM a {_W}),
c AS (SELECT *, CASE WHEN q IS NOT NULL THEN r END AS r1 FROM b),
vals AS (SELECT date, di, sym, ret, {_UNIT.format(c='q', r='r1', by='di, g')} AS v FROM c),
d AS (SELECT *, CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY di, v IS NULL ORDER BY v) END AS kv, CASE WHEN ret IS NOT NULL THEN dense_rank() OVER (PARTITION BY di, ret IS NULL ORDER BY ret) END AS kr FROM vals),
ranked AS (SELECT *, {_UNIT.format(c='v', r='kv', by='di')} AS rv, {_UNIT.format(c='ret', r='kr', by='di')} AS rr FROM d)"""
_CORR = "CASE WHEN min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL) AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL) THEN corr({a}, {b}) END"
_DAILY = f"""{_VALUES},
daily AS (SELECT di, {_CORR.format(a='v', b='ret')} AS ic, {_CORR.format(a='rv', b='rr')} AS rankic, avg(ret) FILTER (rv >= 0.8) AS longret, count(v) / count(*)::DOUBLE AS coverage, count(v) AS n FROM ranked GROUP BY di)"""


def _months(spark: SparkSession, sf_dir: str) -> int:
    """Dates of the monthly panel: what lays out the ranges over its calendar."""
    return read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month")).distinct().count()


def _r(*columns: str, digits: int = DIGITS) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {_DAILY} SELECT di, {_r('ic', 'rankic', 'longret', 'coverage')}, n FROM daily")
def flagship(spark, sf_dir):
    return _rounded(evaluation.daily_results(_values(spark, sf_dir)))


@query(f"WITH {_DAILY} SELECT round(avg(ic), 6) AS ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(rankic), 6) AS rankic, round(avg(rankic) / stddev_samp(rankic), 6) AS rankicir, round(avg(longret) * 243, 6) AS longret, round(avg(coverage), 6) AS coverage, count(rankic) AS dates FROM daily")
def eval_summary(spark, sf_dir):
    return _rounded(evaluation.summary(evaluation.daily_results(_values(spark, sf_dir))))


@query(f"""WITH {_VALUES}, h AS (SELECT di, sym, CASE WHEN rv >= 0.8 THEN 1.0 ELSE 0.0 END AS h FROM ranked),
w AS (SELECT di, sym, coalesce(h / nullif(sum(h) OVER (PARTITION BY di), 0), 0) AS w FROM h),
t AS (SELECT di, abs(w - lag(w, 1, 0.0) OVER (PARTITION BY sym ORDER BY di)) AS d FROM w)
SELECT di, round(sum(d), 6) + 0.0 AS turnover FROM t GROUP BY di""")
def eval_turnover(spark, sf_dir):
    return _rounded(evaluation.turnover(_values(spark, sf_dir)))


@query(f"""WITH {_VALUES}, b1 AS (SELECT di, ret, CAST(least(floor(rv * (10 - 1e-9)), 9) AS INT) AS bucket FROM ranked WHERE rv IS NOT NULL AND ret IS NOT NULL)
SELECT di, bucket, round(avg(ret), 6) + 0.0 AS ret, count(*) AS members FROM b1 GROUP BY di, bucket""")
def eval_group_returns(spark, sf_dir):
    return _rounded(evaluation.group_returns(_values(spark, sf_dir)))


@query(f"""WITH {MONTHLY_SQL.strip()}, r AS (SELECT sym AS key, di, x / nullif(lag(x) OVER o, 0) - 1 AS q FROM p {_W}),
s AS (SELECT key, di, least(greatest(q, -0.2), 0.2) / 10 AS r FROM r WHERE q IS NOT NULL), w AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY key ORDER BY di ROWS UNBOUNDED PRECEDING)) AS w FROM s),
f AS (SELECT *, 1 - w / greatest(1, max(w) OVER (PARTITION BY key ORDER BY di ROWS UNBOUNDED PRECEDING)) AS fall FROM w)
SELECT key, round(avg(r) * 243, 6) + 0.0 AS ann_ret, CASE WHEN min(r) < max(r) THEN round(avg(r) / stddev_samp(r) * sqrt(243), 6) + 0.0 END AS ir, round(arg_max(w, di), 6) AS wealth, round(max(fall), 6) + 0.0 AS max_drawdown FROM f GROUP BY key""")
def eval_performance(spark, sf_dir):
    r = evaluate(monthly_panel(spark, sf_dir), {"r": "diff_q(x)"}).where("r IS NOT NULL")
    return _rounded(evaluation.performance(r.select(F.col("sym").alias("key"), "di", (F.greatest(F.least("r", F.lit(0.2)), F.lit(-0.2)) / 10).alias("r"))))


@query(f"""WITH {MONTHLY_SQL.strip()}, s AS (SELECT di, sym, coalesce(y >= 200, false) AS t, coalesce(w >= 5, false) AS b, coalesce(w >= 7, false) AS s FROM p),
e AS (SELECT *, CASE WHEN t AND b THEN 1 WHEN NOT t AND s THEN 0 END AS e FROM s)
SELECT di, sym, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY sym ORDER BY di ROWS UNBOUNDED PRECEDING), 0) AS held FROM e""")
def eval_holdings(spark, sf_dir):
    flag = lambda c: F.coalesce(c, F.lit(False))
    s = monthly_panel(spark, sf_dir).select("di", "sym", flag(F.col("con")).alias("target"), flag(F.col("w") >= 5).alias("buyable"), flag(F.col("w") >= 7).alias("sellable"))
    return evaluation.holdings(s).select("di", "sym", "held")


@query(f"WITH {_DAILY}, e AS (SELECT year(date) AS y, quarter(date) AS q, rankic FROM daily JOIN cal USING (di)) SELECT y, q, round(avg(rankic), 6) + 0.0 AS rankic, count(rankic) AS dates FROM e GROUP BY ROLLUP (y, q)")
def eval_portrait(spark, sf_dir):
    daily = evaluation.daily_results(_values(spark, sf_dir))
    dates = monthly_panel(spark, sf_dir).select("di", "date").distinct()
    return _rounded(evaluation.portrait(daily.join(dates, "di")))


@query(f"""WITH {MONTHLY_SQL.strip()}, s AS (SELECT di, sym, g, x AS v, w AS size FROM p), a AS (SELECT *, median(v) OVER (PARTITION BY di) AS m FROM s), b AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY di) * 5 * 1.4826 AS k FROM a),
c AS (SELECT *, CASE WHEN size IS NOT NULL THEN greatest(least(v, m + k), m - k) END AS c FROM b), e AS (SELECT *, c - avg(c) OVER (PARTITION BY di, g) AS y1, size - avg(size) OVER (PARTITION BY di, g) AS x1 FROM c),
f AS (SELECT *, y1 - coalesce(sum(x1 * y1) OVER (PARTITION BY di) / nullif(sum(x1 * x1) OVER (PARTITION BY di), 0), 0) * x1 AS r FROM e)
SELECT di, sym, CASE WHEN count(r) OVER cs >= 50 AND min(r) OVER cs < max(r) OVER cs THEN round((r - avg(r) OVER cs) / stddev_samp(r) OVER cs, 6) + 0.0 END AS v FROM f WINDOW cs AS (PARTITION BY di)""")
def eval_neutralized(spark, sf_dir):
    return _rounded(evaluation.neutralized(monthly_panel(spark, sf_dir).select("di", "sym", F.col("x").alias("v"), F.col("w").alias("size"), "g")))


@query("""WITH r AS (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2)
SELECT event_id, round(r.last_value, 6) AS last_value FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts > r.ts""")
def asof_backward(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("_k"))
    r = e.join(F.broadcast(kind), F.col("event_type") == F.col("_k")).groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return _rounded(asof.backward(e.select("event_id", "user_id", "ts"), r, "user_id", "ts", ["last_value"], strict=True).select("event_id", "last_value"))


@query("""WITH cal AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem)
SELECT o_orderkey, (SELECT min(date) FROM cal WHERE cal.date > CAST(o_orderdate AS DATE)) AS effective FROM orders""")
def asof_forward(spark, sf_dir):
    cal = read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("date")).distinct()
    return asof.next_date(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", cal).select("o_orderkey", "effective")


@query("""WITH q AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1, 2)
SELECT o_custkey, quarter, CASE WHEN count(*) OVER w = 4 THEN (sum(cents) OVER w)::BIGINT END AS ttm, (cents - coalesce(lag(cents) OVER (PARTITION BY o_custkey, year(quarter) ORDER BY quarter), 0))::BIGINT AS single
FROM q WINDOW w AS (PARTITION BY o_custkey ORDER BY quarter ROWS 3 PRECEDING)""")
def asof_trailing(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    q = read(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("quarter")).agg(F.sum(cents).alias("cents"))
    out = asof.single_periods(asof.trailing(q, "o_custkey", "quarter", "cents").withColumn("y", F.year("quarter")), ["o_custkey", "y"], "quarter", "cents")
    return out.select("o_custkey", "quarter", "ttm", "single")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < DATE '1996-01-01' UNION ALL SELECT o_orderkey, lower(o_orderstatus) FROM orders WHERE o_orderdate >= DATE '1996-01-01'")
def asof_merged(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    start = F.to_timestamp(F.lit("1996-01-01"))
    return asof.merged(old, old.withColumn("o_orderstatus", F.lower("o_orderstatus")), "o_orderdate", start).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY 1")
def store_upsert(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("version"))
    odd = F.col("o_orderkey") % 2 == 1
    return store.upsert(o.where(odd), o.where(~odd), ["o_custkey"], "version").select("o_custkey", "o_orderkey")


@query("""SELECT p_partkey, substr(md5('{"p0":"' || p_brand || '","p1":' || p_size || '}'), 1, 16) AS id FROM part""")
def store_formula_id(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", store.formula_id(F.col("p_brand"), F.col("p_size")).alias("id"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_brand LIKE 'Brand%' AND p_size IN (10, 20, 30, 40) ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 20")
def store_page(spark, sf_dir):
    found = store.where(read(spark, sf_dir, "part"), p_size__gte=10, p_brand__like="Brand%", p_size__in=(10, 20, 30, 40))
    return store.page(found, [F.desc("p_size"), F.asc("p_partkey")], 2, 20).select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def store_pending(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def store_set_operations(spark, sf_dir):
    keys = lambda s: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").intersect(keys("F")).exceptAll(keys("O").distinct())


_SERIES = f"""{MONTHLY_SQL.strip()}, f AS (SELECT g AS id, di, avg(x) AS a, avg(y / w) AS b, avg(w) AS c FROM p GROUP BY 1, 2), s AS (SELECT id, di, a AS v FROM f UNION ALL SELECT id + 10, di, b FROM f UNION ALL SELECT id + 20, di, c FROM f),
k AS (SELECT a.id AS a, b.id AS b, CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN corr(a.v, b.v) END AS corr, count(*) AS days FROM s a JOIN s b ON a.di = b.di AND a.id < b.id WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2)"""


def _pairs(spark, sf_dir) -> DataFrame:
    f = monthly_panel(spark, sf_dir).groupBy(F.col("g").alias("id"), "di").agg(F.avg("x").alias("a"), F.avg(F.col("y") / F.col("w")).alias("b"), F.avg("w").alias("c"))
    s = f.select("id", "di", F.col("a").alias("v"))
    for k, c in ((10, "b"), (20, "c")):
        s = s.unionByName(f.select((F.col("id") + k).alias("id"), "di", F.col(c).alias("v")))
    return store.pair_correlations(s)


@query(f"WITH {_SERIES} SELECT a, b, round(corr, 6) + 0.0 AS corr, days FROM k")
def store_pair_correlations(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir))


@query(f"""WITH {_SERIES}, u AS (SELECT a AS id, b AS other, corr FROM k UNION ALL SELECT b, a, corr FROM k)
SELECT id, round(max(abs(corr)), 6) AS max_corr, arg_max(other, {{'c': abs(corr), 'o': -other}}) AS max_corr_id, round(avg(abs(corr)), 6) AS avg_corr FROM u WHERE corr IS NOT NULL GROUP BY id""")
def store_worst_pairs(spark, sf_dir):
    return _rounded(store.worst_pairs(_pairs(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_SERIES}, ids AS (SELECT id, row_number() OVER (ORDER BY (id * 7 % 11) DESC, id) AS n FROM (SELECT a AS id FROM k UNION SELECT b FROM k)),
e AS (SELECT a, list(b) AS near FROM (SELECT a, b FROM k WHERE corr > 0.3 UNION ALL SELECT b, a FROM k WHERE corr > 0.3) GROUP BY a), o AS (SELECT id, n, coalesce(near, []) AS near FROM ids LEFT JOIN e ON a = id),
r AS (SELECT 0::BIGINT AS n, [] :: BIGINT[] AS kept UNION ALL SELECT o.n, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, id) END FROM r JOIN o ON o.n = r.n + 1)
SELECT CAST(unnest(kept) AS INT) AS id FROM r WHERE n = (SELECT max(n) FROM ids)""")
def store_greedy_independent(spark, sf_dir):
    corrs = _pairs(spark, sf_dir)
    ranked = corrs.select(F.col("a").alias("id")).union(corrs.select("b")).distinct().withColumn("score", (F.col("id") * 7 % 11).cast("double"))
    return store.greedy_independent(ranked, corrs, 0.3)


@query("""SELECT p_partkey, p_size::DOUBLE AS w FROM part ORDER BY -ln((('0x' || substr(md5('42:' || p_partkey), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE) / p_size::DOUBLE, p_partkey LIMIT 50""")
def store_sampled(spark, sf_dir):
    return store.sampled(read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w")), "p_partkey", "w", 50)


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS turn FROM part ORDER BY turn, p_brand LIMIT 60")
def store_round_robin(spark, sf_dir):
    return store.round_robin(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 60).select("p_partkey", "p_brand", "turn")


@query(f"""WITH RECURSIVE {MONTHLY_SQL.strip()}, s AS (SELECT di AS key, sym AS id, x AS w FROM p WHERE x IS NOT NULL), l AS (SELECT key, list(w ORDER BY w DESC) AS a, sum(w) AS t FROM s GROUP BY key),
r AS (SELECT key, a, 0 AS k, t AS rest FROM l UNION ALL SELECT key, a, k + 1, rest - a[k + 1] FROM r WHERE k < len(a) AND a[k + 1] * greatest(1 - k * 0.05, 0) / rest >= 0.05), c AS (SELECT key, max(k) AS k, arg_max(rest, k) AS rest FROM r GROUP BY key),
n AS (SELECT s.key, id, w, row_number() OVER (PARTITION BY s.key ORDER BY w DESC, id) AS i FROM s)
SELECT key, id, round(CASE WHEN i <= k THEN 0.05 ELSE w * greatest(1 - k * 0.05, 0) / rest END, 6) + 0.0 AS w FROM n JOIN c USING (key)""")
def store_capped_weights(spark, sf_dir):
    w = monthly_panel(spark, sf_dir).where("x IS NOT NULL").select(F.col("di").alias("key"), F.col("sym").alias("id"), F.col("x").alias("w"))
    return _rounded(store.capped_weights(w, "key", 0.05))


@query("""SELECT threshold, count(*) FILTER (p_retailprice >= threshold) AS passed, count(DISTINCT p_brand) FILTER (p_retailprice >= threshold) AS brands
FROM part CROSS JOIN (SELECT unnest([900.0, 1000.0, 1100.0, 1200.0]) AS threshold) GROUP BY threshold""")
def store_threshold_sweep(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in (900, 1000, 1100, 1200)))))
    ok = F.col("p_retailprice") >= F.col("threshold")
    return part.groupBy("threshold").agg(F.count(F.when(ok, 1)).alias("passed"), F.count_distinct(F.when(ok, F.col("p_brand"))).alias("brands"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id AS id, list_sum(list_transform(list_zip(a, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)))) AS similarity FROM q JOIN embeddings ON qid <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity > 0)
SELECT qid, id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5""")
def similar_vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _rounded(similarity.top_k(v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), v))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem), s AS (SELECT 1::BIGINT AS node, 0 AS steps), s1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 1), s2 AS (SELECT DISTINCT a AS node FROM e WHERE b IN (SELECT node FROM s1) AND a <> 1)
SELECT node, steps FROM s UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM s2""")
def graph_within_steps(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10_000_000).alias("b"))
    return similarity.within_steps(e, spark.range(1, 2).select(F.col("id").alias("node")), 2)


_REDUCED = ["mean", "wmean", "std", "sum", "wsum", "min", "max", "range", "median", "skew", "kurt", "first", "last"]


@query(f"""WITH {MINUTE_SQL.strip()} SELECT date, sym, round(avg(close), 6) + 0.0 AS mean, round(sum(close * volume) / sum(volume), 6) + 0.0 AS wmean, round(stddev_samp(close), 6) + 0.0 AS std, round(sum(close), 6) + 0.0 AS sum, round(sum(close * volume), 6) + 0.0 AS wsum,
round(min(close), 6) + 0.0 AS min, round(max(close), 6) + 0.0 AS max, round(max(close) - min(close), 6) + 0.0 AS range, round(median(close), 6) + 0.0 AS median, CASE WHEN count(*) > 2 AND min(close) < max(close) THEN round(skewness(close), 6) + 0.0 END AS skew,
CASE WHEN count(*) > 3 AND min(close) < max(close) THEN round(kurtosis(close), 6) + 0.0 END AS kurt, round(arg_min(close, minute), 6) + 0.0 AS first, round(arg_max(close, minute), 6) + 0.0 AS last FROM b GROUP BY date, sym""")
def minute_reducers(spark, sf_dir):
    return _rounded(minute.daily(minute_bars(spark, sf_dir), _REDUCED))


@query(f"""WITH {MINUTE_SQL.strip()}, l AS (SELECT date, sym, list_sort(list(close)) AS a, sum(close * volume) / sum(volume) / nullif(avg(close), 0) AS vwap_ratio FROM b GROUP BY 1, 2)
SELECT date, sym, round(a[ceil(len(a) * 0.05)::INT], 6) + 0.0 AS var, round(list_avg(a[1:ceil(len(a) * 0.05)::INT]), 6) + 0.0 AS cvar, round(vwap_ratio, 6) + 0.0 AS vwap_ratio FROM l""")
def minute_tails(spark, sf_dir):
    return _rounded(minute.daily(minute_bars(spark, sf_dir), ["var", "cvar", "vwap_ratio"]))


@query(f"""WITH {MINUTE_SQL.strip()}, t AS (SELECT *, max(close) OVER (PARTITION BY date, sym ORDER BY minute ROWS UNBOUNDED PRECEDING) AS top FROM b)
SELECT date, sym, round(max(CASE WHEN top > 0 THEN greatest(1 - close / top, 0) ELSE 0 END), 6) + 0.0 AS maxdd FROM t GROUP BY 1, 2""")
def minute_drawdown(spark, sf_dir):
    return _rounded(minute.daily(minute_bars(spark, sf_dir), ["maxdd"]))


@query(f"""WITH {MINUTE_SQL.strip()}, k AS (SELECT date, sym, open AS x, lag(close) OVER (PARTITION BY date, sym ORDER BY minute) AS l, close AS c FROM b)
SELECT date, sym, CASE WHEN min(x) < max(x) AND min(c) < max(c) THEN round(corr(x, c), 6) + 0.0 END AS corr, CASE WHEN min(x) < max(x) THEN round(covar_pop(x, c) / var_pop(x), 6) + 0.0 END AS slope, CASE WHEN min(x) < max(x) THEN round(avg(c) - covar_pop(x, c) / var_pop(x) * avg(x), 6) + 0.0 END AS intercept,
CASE WHEN min(x) < max(x) AND min(c) < max(c) THEN round(pow(corr(x, c), 2), 6) + 0.0 END AS r2, round(covar_samp(x, c), 6) + 0.0 AS cov, round(sum(x * c) / nullif(sqrt(sum(x * x)) * sqrt(sum(c * c)), 0), 6) + 0.0 AS cos_sim FROM k GROUP BY 1, 2""")
def minute_pair_reducers(spark, sf_dir):
    found = minute.pair_reducers("open", "close")
    return _rounded(minute_bars(spark, sf_dir).groupBy("date", "sym").agg(*(c.alias(k) for k, c in found.items())))


@query(f"""WITH {MINUTE_SQL.strip()}, k AS (SELECT date, sym, close AS c, lag(close) OVER (PARTITION BY date, sym ORDER BY minute) AS x FROM b), v AS (SELECT * FROM k WHERE x IS NOT NULL)
SELECT b.date, b.sym, CASE WHEN min(x) < max(x) AND min(v.c) < max(v.c) THEN round(corr(x, v.c), 6) + 0.0 END AS corr FROM (SELECT DISTINCT date, sym FROM b) b LEFT JOIN v USING (date, sym) GROUP BY 1, 2""")
def minute_lagged_corr(spark, sf_dir):
    bars = minute.shifted(minute_bars(spark, sf_dir), "close", 1, "before")
    return _rounded(bars.groupBy("date", "sym").agg(minute.pair_reducers("before", "close")["corr"].alias("corr")))


@query(f"""WITH {MINUTE_SQL.strip()}, r AS (SELECT *, volume - lag(volume) OVER (PARTITION BY date, sym ORDER BY minute) AS rise, close / nullif(open, 0) - 1 AS ret FROM b), h AS (SELECT *, rise > avg(rise) OVER w + stddev_samp(rise) OVER w AS hit FROM r WINDOW w AS (PARTITION BY date, sym))
SELECT date, sym, count(*) FILTER (hit) AS surges, round(avg(ret) FILTER (hit), 6) + 0.0 AS surge_ret FROM h GROUP BY 1, 2""")
def minute_surges(spark, sf_dir):
    return _rounded(minute.surge_returns(minute_bars(spark, sf_dir)))


@query(f"""WITH {MINUTE_SQL.strip()}, r AS (SELECT *, close / nullif(open, 0) - 1 AS ret FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY date, sym ORDER BY ret DESC, minute) AS k FROM r WHERE ret IS NOT NULL)
SELECT date, sym, round(sum(CASE WHEN k <= 5 THEN volume ELSE 0 END) / sum(volume) * count(*) / least(count(*), 5), 6) + 0.0 AS share FROM k GROUP BY 1, 2""")
def minute_extreme_share(spark, sf_dir):
    return _rounded(minute.share_of_extremes(minute_bars(spark, sf_dir)))


@query(f"WITH {MINUTE_SQL.strip()}, q AS (SELECT date, sym, volume / sum(volume) OVER (PARTITION BY date, sym) AS p FROM b WHERE volume > 0) SELECT date, sym, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM q GROUP BY 1, 2")
def minute_entropy(spark, sf_dir):
    return _rounded(minute.entropy(minute_bars(spark, sf_dir)))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS events FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return sessions(read(spark, sf_dir, "events"))


@query(f"""WITH {MONTHLY_SQL.strip()}, a AS (SELECT *, lag(x) OVER o AS b FROM p {_W}), c AS (SELECT date, di, sym, CASE WHEN x > b AND y >= 200 THEN (x - b) / w WHEN NOT (x > b AND y >= 200) THEN -b END AS v FROM a)
SELECT date, di, sym, round(v, 4) + 0.0 AS v FROM c""")
def infix_formula(spark, sf_dir):
    tree = parse_infix("($x - DELAY($x,1)) / $w if $x > DELAY($x,1) and con else -DELAY($x,1)")
    return _rounded(evaluate(monthly_panel(spark, sf_dir), {"v": tree}), 4)


@query(f"""WITH {MONTHLY_SQL.strip()}, k AS (SELECT unnest(range(0, (SELECT (max(di) + 1 - 38) // 6 + 1 FROM cal))) AS k), r AS (SELECT k AS fold, 'train' AS part, k * 6 AS a, k * 6 + 23 AS b FROM k UNION ALL SELECT k, 'validation', k * 6 + 25, k * 6 + 30 FROM k UNION ALL SELECT k, 'test', k * 6 + 32, k * 6 + 37 FROM k)
SELECT CAST(fold AS INT) AS fold, part, count(x) AS cells, CAST(min(di) AS INT) AS first, CAST(max(di) AS INT) AS last FROM r JOIN p ON di BETWEEN a AND b GROUP BY 1, 2""")
def walk_forward_parts(spark, sf_dir):
    parts = labelled_parts(monthly_panel(spark, sf_dir), walk_forward(spark, _months(spark, sf_dir), 24, 6, 1, 6))
    return parts.groupBy("fold", "part").agg(F.count("x").alias("cells"), F.min("di").alias("first"), F.max("di").alias("last"))


_CLIP = "greatest(least({0}, quantile_cont({0}, 0.95) OVER (PARTITION BY di)), quantile_cont({0}, 0.05) OVER (PARTITION BY di))"


@query(f"""WITH {MONTHLY_SQL.strip()}, c AS (SELECT di, sym, w, CASE WHEN x IS NOT NULL THEN {_CLIP.format('x')} END AS a, CASE WHEN y IS NOT NULL THEN {_CLIP.format('y')} END AS b FROM p),
z AS (SELECT di, sym, CASE WHEN min(a) OVER cs < max(a) OVER cs THEN (a - sum(a * w) OVER cs / sum(CASE WHEN a IS NOT NULL THEN w END) OVER cs) / stddev_samp(a) OVER cs END AS za, CASE WHEN min(b) OVER cs < max(b) OVER cs THEN (b - sum(b * w) OVER cs / sum(CASE WHEN b IS NOT NULL THEN w END) OVER cs) / stddev_samp(b) OVER cs END AS zb FROM c WINDOW cs AS (PARTITION BY di))
SELECT di, sym, CASE WHEN za IS NOT NULL OR zb IS NOT NULL THEN round((coalesce(za, 0) + coalesce(zb, 0)) / ((za IS NOT NULL)::INT + (zb IS NOT NULL)::INT), 6) + 0.0 END AS style FROM z""")
def style_field(spark, sf_dir):
    return _rounded(styles.weighted_style(monthly_panel(spark, sf_dir), ["x", "y"], "w").select("di", "sym", "style"))


@query(f"WITH {MONTHLY_SQL.strip()} SELECT di, {_CORR.format(a='x', b='y')} AS y0, {_CORR.format(a='x', b='w')} AS w0 FROM p GROUP BY di".replace(_CORR.format(a='x', b='y') + " AS y0", "round(" + _CORR.format(a='x', b='y') + ", 6) AS y").replace(_CORR.format(a='x', b='w') + " AS w0", "round(" + _CORR.format(a='x', b='w') + ", 6) AS w"))
def style_exposures(spark, sf_dir):
    return _rounded(styles.exposures(monthly_panel(spark, sf_dir).withColumn("v", F.col("x")), ["y", "w"]))


@query(f"""WITH {MONTHLY_SQL.strip()}, r AS (SELECT di, sym, w, x / nullif(lag(x) OVER o, 0) - 1 AS r FROM p {_W}), mk AS (SELECT *, sum(r * w) OVER (PARTITION BY di) / sum(CASE WHEN r IS NOT NULL THEN w END) OVER (PARTITION BY di) AS m FROM r), b AS (SELECT di, sym, CASE WHEN r IS NOT NULL THEN m END AS a, CASE WHEN m IS NOT NULL THEN r END AS b FROM mk)
SELECT di, sym, CASE WHEN count(a) OVER t >= 6 AND min(a) OVER t < max(a) OVER t THEN round(covar_pop(a, b) OVER t / var_pop(a) OVER t, 5) + 0.0 END AS beta FROM b WINDOW t AS (PARTITION BY sym ORDER BY di ROWS 11 PRECEDING)""")
def market_beta(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    r = evaluate(p, {"r": "diff_q(x)", "w1": "ts_self(w)"})
    return _rounded(styles.market_beta(r, "r", "w1", 12, 6).select("di", "sym", "beta"), 5)


@query(f"""WITH {MONTHLY_SQL.strip()}, u AS (SELECT di, sym, unnest(['x', 'y', 'w']) AS f, unnest([x, y * 1.0, w * 30.0]) AS v FROM p), n AS (SELECT *, rank() OVER (PARTITION BY di, sym, v IS NULL ORDER BY v) AS r, count(v) OVER (PARTITION BY di, sym) AS n, count(v) OVER (PARTITION BY di, sym, v) AS k FROM u), q AS (SELECT di, sym, f, CASE WHEN v IS NULL THEN 0.5 ELSE (r + (k - 1) / 2.0 - 0.5) / n END AS v FROM n)
SELECT di, sym, round(max(v) FILTER (f = 'x'), 6) AS x_r, round(max(v) FILTER (f = 'y'), 6) AS y_r, round(max(v) FILTER (f = 'w'), 6) AS w_r FROM q GROUP BY di, sym""")
def row_ranked_features(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("w", F.col("w") * 30)
    return _rounded(styles.row_ranked(p, ["x", "y", "w"]).select("di", "sym", "x_r", "y_r", "w_r"))


@query(f"""WITH RECURSIVE {_VALUES}, top AS (SELECT di, sym, row_number() OVER (PARTITION BY di ORDER BY v DESC, sym) AS rank FROM vals WHERE v IS NOT NULL), days AS (SELECT di, list(sym ORDER BY rank) AS ids, row_number() OVER (ORDER BY di) AS n FROM top WHERE rank <= 8 GROUP BY di),
r AS (SELECT 0::BIGINT AS n, CAST(NULL AS INT) AS di, []::BIGINT[] AS held UNION ALL
  SELECT d.n, d.di, list_concat(list_filter(ids, lambda i: list_contains(held, i)), list_filter(ids, lambda i: NOT list_contains(held, i)))[1:4] FROM r JOIN days d ON d.n = r.n + 1)
SELECT di, unnest(held) AS id FROM r WHERE n > 0""")
def buffered_book(spark, sf_dir):
    return styles.buffered(styles.top_names(_values(spark, sf_dir), 8), 4, 8)


_MIN = "PARTITION BY date, minute"


@query(f"""WITH {MINUTE_SQL.strip()}, r AS (SELECT *, dense_rank() OVER (PARTITION BY date, minute ORDER BY close) AS r FROM b)
SELECT date, minute, sym, round(CASE WHEN max(r) OVER w = 1 THEN 0.5 ELSE (r - 1) / (max(r) OVER w - 1)::DOUBLE END, 6) AS rank, round(close - avg(close) OVER w, 6) + 0.0 AS neutral, round(CASE WHEN min(close) OVER w = max(close) OVER w THEN 0.5 ELSE (close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w) END, 6) + 0.0 AS scaled,
round(CASE WHEN volume > 0 THEN volume / sum(volume) FILTER (volume > 0) OVER w END, 6) + 0.0 AS weight FROM r WINDOW w AS ({_MIN})""")
def minute_cross_section(spark, sf_dir):
    b = minute_bars(spark, sf_dir).withColumns({"rank": F.col("close"), "neutral": F.col("close"), "scaled": F.col("close"), "weight": F.col("volume")})
    for c, how in (("rank", "rank"), ("neutral", "neutralize"), ("scaled", "scale"), ("weight", "weight")):
        b = minute.cross_section(b, c, how)
    return _rounded(b.select("date", "minute", "sym", "rank", "neutral", "scaled", "weight"))


@query(f"""WITH {MINUTE_SQL.strip()}, t AS (SELECT *, row_number() OVER (PARTITION BY date, sym ORDER BY minute DESC) AS k FROM b), l AS (SELECT *, first(close) OVER (PARTITION BY date, sym ORDER BY minute DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS own FROM t WHERE k <= 5)
SELECT date, sym, round(sum(CASE WHEN close < own THEN 1.0 WHEN close = own THEN 0.5 ELSE 0.0 END) / count(close), 6) + 0.0 AS ts_rank, CASE WHEN min(close) < max(close) THEN round((min(own) - avg(close)) / stddev_pop(close), 6) + 0.0 END AS ts_zscore,
CASE WHEN min(close) < max(close) AND min(open) < max(open) THEN round(corr(close, open), 6) + 0.0 END AS ts_corr, CASE WHEN min(open) < max(open) THEN round(covar_pop(close, open) / var_pop(open), 6) + 0.0 END AS ts_beta FROM l GROUP BY 1, 2""")
def minute_last(spark, sf_dir):
    return _rounded(minute.last_minutes(minute_bars(spark, sf_dir), "close", "open"))


@query(f"""WITH {MINUTE_SQL.strip()}, k AS (SELECT date, sym, minute, close AS c, lag(close) OVER (PARTITION BY date, sym ORDER BY minute) AS x FROM b WHERE minute BETWEEN 360 AND 1200)
SELECT date, sym, round(CASE WHEN count(x) < 5 THEN 0.0 ELSE coalesce(CASE WHEN min(x) < max(x) AND min(c) FILTER (x IS NOT NULL) < max(c) FILTER (x IS NOT NULL) THEN corr(x, c) END, 0.0) END, 6) + 0.0 AS value FROM k GROUP BY 1, 2""")
def minute_autocorr(spark, sf_dir):
    return _rounded(minute.parametric(minute_bars(spark, sf_dir), "close", "autocorr", start=360, end=1200))


@query(f"""WITH {MINUTE_SQL.strip()}, w AS (SELECT *, min(close) OVER (PARTITION BY date, sym) AS lo, max(close) OVER (PARTITION BY date, sym) AS hi FROM b), n AS (SELECT date, sym, CASE WHEN hi > lo THEN least(floor((close - lo) / (hi - lo) * 10), 9) ELSE 0 END AS k, count(*) AS n FROM w GROUP BY 1, 2, 3), q AS (SELECT date, sym, n / sum(n) OVER (PARTITION BY date, sym) AS p FROM n)
SELECT date, sym, round(-sum(p * ln(p)), 6) + 0.0 AS value FROM q GROUP BY 1, 2""")
def minute_binned_entropy(spark, sf_dir):
    return _rounded(minute.parametric(minute_bars(spark, sf_dir), "close", "entropy"))


@query(f"""WITH {MINUTE_SQL.strip()}, f AS (SELECT *, lag(volume, 2) OVER (PARTITION BY date, sym ORDER BY minute) AS v2 FROM b), k AS (SELECT * FROM f WHERE v2 IS NOT NULL),
r AS (SELECT date, sym, rank() OVER (PARTITION BY date, sym ORDER BY high) + (count(*) OVER (PARTITION BY date, sym, high) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, sym ORDER BY v2) + (count(*) OVER (PARTITION BY date, sym, v2) - 1) / 2.0 AS c FROM k)
SELECT date, sym, CASE WHEN min(a) < max(a) AND min(c) < max(c) THEN round(corr(a, c), 6) + 0.0 END AS value FROM r GROUP BY 1, 2""")
def minute_rank_corr(spark, sf_dir):
    return _rounded(minute.parametric(minute_bars(spark, sf_dir), "high", "rank_corr", "volume", lag=2))


_WC = "(sum(w * {0} * {1}) / sum(w) - sum(w * {0}) / sum(w) * sum(w * {1}) / sum(w)) / sqrt((sum(w * {0} * {0}) / sum(w) - pow(sum(w * {0}) / sum(w), 2)) * (sum(w * {1} * {1}) / sum(w) - pow(sum(w * {1}) / sum(w), 2)))"


@query(f"""WITH {MONTHLY_SQL.strip()}, k AS (SELECT di, w, x / 64 AS a, y / 64 AS b FROM p WHERE x IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY di ORDER BY a) + (count(*) OVER (PARTITION BY di, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY di ORDER BY b) + (count(*) OVER (PARTITION BY di, b) - 1) / 2.0 AS rb FROM k)
SELECT di, round({_WC.format('a', 'b')}, 6) + 0.0 AS pearson, round({_WC.format('ra', 'rb')}, 6) + 0.0 AS spearman, round(sum(w * abs(a - b)) / sum(w), 6) AS mae, round(sum(w * pow(a - b, 2)) / sum(w), 6) AS mse, round(sqrt(sum(w * pow(a - b, 2)) / sum(w)), 6) AS rmse FROM r GROUP BY di HAVING count(*) > 20""")
def fitness_scores(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).where("x IS NOT NULL").select("di", "w", (F.col("x") / 64).alias("a"), (F.col("y") / 64).alias("b"))
    many = p.groupBy("di").count().where("count > 20").select("di")
    return _rounded(fitness.scores(p.join(many, "di", "left_semi"), "di", "a", "b", "w"))


@query(f"""WITH {MONTHLY_SQL.strip()}, f AS (SELECT sum(w * -(CASE WHEN con THEN ln(q) ELSE ln(1 - q) END)) / sum(w) AS l FROM (SELECT *, 0.05 + 0.9 * (sym % 7) / 7.0 AS q FROM p WHERE w IS NOT NULL)) SELECT round(l, 6) AS log_loss FROM f""")
def fitness_log_loss(spark, sf_dir):
    p = monthly_panel(spark, sf_dir).withColumn("q", 0.05 + 0.9 * (F.col("sym") % 7) / F.lit(7.0))
    return _rounded(p.agg(fitness.log_loss(F.col("con").cast("double"), F.col("q"), F.col("w")).alias("log_loss")))


@query(f"""WITH {_VALUES}, b1 AS (SELECT di, ret, CAST(least(floor(rv * (10 - 1e-9)), 9) AS INT) AS bucket FROM ranked WHERE rv IS NOT NULL AND ret IS NOT NULL), g1 AS (SELECT di, bucket, avg(ret) AS ret FROM b1 GROUP BY 1, 2)
SELECT di, CASE WHEN min(bucket) < max(bucket) AND min(ret) < max(ret) THEN round(corr(bucket, ret), 6) + 0.0 END AS monotonicity, arg_max(bucket, ret) AS best FROM g1 GROUP BY di""")
def fitness_monotonicity(spark, sf_dir):
    return _rounded(fitness.monotonicity(evaluation.group_returns(_values(spark, sf_dir)), "di", "bucket", "ret"))


@query(f"""WITH {MONTHLY_SQL.strip()}, a AS (SELECT di, sym, CASE WHEN con THEN 1.0 ELSE 0.0 END AS h, coalesce(least(greatest(lead(x) OVER o / nullif(x, 0) - 1, -0.3), 0.3) * 0.1, 0) AS r, x IS NULL OR lead(x) OVER o IS NULL AS bad FROM p {_W}),
b AS (SELECT di, sym, CASE WHEN bad THEN 0 ELSE r END AS r, coalesce(h / nullif(sum(h) OVER (PARTITION BY di), 0), 0) AS w FROM a), c AS (SELECT *, sum(w * r) OVER (PARTITION BY di) AS t FROM b),
d AS (SELECT *, w - coalesce(lag(w * (1 + r) / (1 + t)) OVER (PARTITION BY sym ORDER BY di), 0) AS d FROM c), e AS (SELECT di, sum(w * r) AS gross, sum(CASE WHEN d > 0 THEN d * 0.0001 ELSE -d * 0.0006 END) AS cost, sum(abs(d)) AS turnover FROM d GROUP BY di)
SELECT di, round(gross, 6) + 0.0 AS gross, round(gross - cost, 6) + 0.0 AS net, round(turnover, 6) + 0.0 AS turnover, round(exp(sum(ln(1 + gross)) OVER h), 6) AS gross_nav, round(exp(sum(ln(1 + gross - cost)) OVER h), 6) AS net_nav FROM e WINDOW h AS (ORDER BY di ROWS UNBOUNDED PRECEDING)""")
def eval_nav(spark, sf_dir):
    p = evaluate(monthly_panel(spark, sf_dir), {"h": "ts_self(y)", "c": "con_not(con_not(con))", "q": "ts_delay(diff_q(x),-1)"})
    held = F.when(F.col("c"), 1.0).otherwise(0.0)
    book = p.withColumn("h", held).withColumn("w", F.coalesce(F.try_divide("h", F.sum("h").over(Window.partitionBy("di"))), F.lit(0.0)))
    r = F.when(F.col("q").isNotNull(), F.greatest(F.least("q", F.lit(0.3)), F.lit(-0.3)) * 0.1)
    return _rounded(evaluation.nav(book.select("di", "sym", "w", r.alias("r"))))


@query(f"""WITH {MINUTE_SQL.strip()}, e AS (SELECT date, sym, high AS a, minute::DOUBLE AS c FROM b), w AS (SELECT *, min(a) OVER k AS la, max(a) OVER k AS ha, min(c) OVER k AS lc, max(c) OVER k AS hc FROM e WINDOW k AS (PARTITION BY date, sym)),
n AS (SELECT date, sym, CASE WHEN ha > la THEN least(floor((a - la) / (ha - la) * 5), 4) ELSE 0 END AS x, CASE WHEN hc > lc THEN least(floor((c - lc) / (hc - lc) * 5), 4) ELSE 0 END AS y, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2, 3, 4),
q AS (SELECT date, sym, n, sum(n) OVER (PARTITION BY date, sym) AS t, sum(n) OVER (PARTITION BY date, sym, x) AS nx, sum(n) OVER (PARTITION BY date, sym, y) AS ny FROM n)
SELECT date, sym, round(sum(n / t * ln(n * t / (nx * ny))), 6) + 0.0 AS mutual_info FROM q GROUP BY 1, 2""")
def minute_mutual_information(spark, sf_dir):
    bars = minute_bars(spark, sf_dir).withColumn("at", F.col("minute").cast("double"))
    return _rounded(minute.mutual_information(bars, "high", "at"))


@query(f"""WITH {MONTHLY_SQL.strip()}, v AS (SELECT date, sym, CASE WHEN y >= 400 THEN 'inf'::DOUBLE ELSE x END AS v FROM p), k AS (SELECT date, sym, count(*) AS n, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (isinf(v)) AS infinite FROM v GROUP BY 1, 2), g AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY sym ORDER BY date), date) AS gap FROM k)
SELECT sum(n)::BIGINT AS rows, count(DISTINCT date) AS dates, count(DISTINCT sym) AS symbols, sum(missing)::BIGINT AS missing, sum(infinite)::BIGINT AS infinite, sum(n - 1)::BIGINT AS repeated, min(gap)::INT AS least_gap FROM g""")
def quality_profile(spark, sf_dir):
    v = monthly_panel(spark, sf_dir).select("date", "sym", F.when(F.col("y") >= 400, float("inf")).otherwise(F.col("x")).alias("v"))
    return quality.profile(v, "v")


@query(f"""WITH {MONTHLY_SQL.strip()}, a AS (SELECT date, sym, x AS v FROM p WHERE di % 7 <> 0), b AS (SELECT date, sym, CASE WHEN y < 100 THEN NULL WHEN w > 3 THEN x ELSE x * 2 END AS v FROM p WHERE di % 5 <> 0),
j AS (SELECT a.v AS x, b.v AS y, a.sym IS NOT NULL AS ia, b.sym IS NOT NULL AS ib FROM a FULL JOIN b USING (date, sym)), n AS (SELECT count(*) FILTER (ia) AS ra, count(*) FILTER (ib) AS rb, count(*) FILTER (ia AND ib) AS c, count(*) AS t, count(*) FILTER (ia AND x IS NULL) AS ma, count(*) FILTER (ib AND y IS NULL) AS mb,
avg(CASE WHEN abs(x - y) < 1e-6 THEN 1.0 ELSE 0.0 END) FILTER (x IS NOT NULL AND y IS NOT NULL) AS e, corr(x, y) AS r FROM j)
SELECT ra AS rows_a, rb AS rows_b, round(least(ra, rb) / greatest(ra, rb)::DOUBLE, 6) AS row_ratio, round(c / t::DOUBLE, 6) AS overlap, ma = mb AS missing_equal, round(e, 6) AS equal_share, round(r, 6) AS corr FROM n""")
def quality_compared(spark, sf_dir):
    p = monthly_panel(spark, sf_dir)
    other = F.when(F.col("y") < 100, None).when(F.col("w") > 3, F.col("x")).otherwise(F.col("x") * 2)
    return _rounded(quality.compared(p.where("di % 7 <> 0").select("date", "sym", F.col("x").alias("v")), p.where("di % 5 <> 0").select("date", "sym", other.alias("v")), "v"))


@query(f"WITH {_DAILY}, best AS (SELECT list(abs(rankic) ORDER BY abs(rankic) DESC) FILTER (rankic IS NOT NULL) AS a FROM daily) SELECT round(a[1] / list_sum(a), 6) AS top1, round(list_sum(a[1:5]) / list_sum(a), 6) AS top5 FROM best")
def quality_concentration(spark, sf_dir):
    return _rounded(quality.concentration(evaluation.daily_results(_values(spark, sf_dir)), "rankic"))


@query(f"""WITH {_DAILY}, k AS (SELECT round(rankic, 9) AS x, row_number() OVER (ORDER BY round(rankic, 9)) - 1 AS place FROM daily WHERE rankic IS NOT NULL), n AS (SELECT count(*) AS n FROM k),
e AS (SELECT draw, unnest(range(n)) AS i, n FROM range(5000) z(draw), n), f AS (SELECT draw, ('0x' || substr(md5('20260625:' || draw || ':' || i), 1, 8))::BIGINT % n AS place FROM e), g AS (SELECT draw, avg(x) AS m FROM f JOIN k USING (place) GROUP BY draw)
SELECT round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high, round((SELECT avg(x) FROM k), 6) + 0.0 AS mean FROM g""")
def quality_bootstrap(spark, sf_dir):
    return _rounded(quality.bootstrap(evaluation.daily_results(_values(spark, sf_dir)).select(F.round("rankic", 9).alias("rankic")), "rankic"))


@query(f"""WITH {_DAILY}, cut AS (SELECT di, rankic, ntile(5) OVER (ORDER BY di) AS block FROM (SELECT di, round(rankic, 9) AS rankic FROM daily) WHERE rankic IS NOT NULL), g AS (SELECT block, min(di) AS first, max(di) AS last, avg(rankic) AS mean, count(*) FILTER (rankic > 0) AS k, count(*) AS n FROM cut GROUP BY block)
SELECT block::INT AS block, first, last, round(mean, 6) + 0.0 AS mean, round(k / n::DOUBLE, 6) AS win_rate, round(least(1, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))))), 6) AS p FROM g""")
def quality_blocks(spark, sf_dir):
    return _rounded(quality.by_blocks(evaluation.daily_results(_values(spark, sf_dir)).select("di", F.round("rankic", 9).alias("rankic")), "rankic"))


@query("""SELECT s_suppkey, coalesce(s_acctbal >= 0 AND s_acctbal <= 5000 AND s_nationkey >= 3, false) AS ok FROM supplier""")
def quality_rules_pass(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", quality.passes(None, {"s_acctbal": (0, 5000), "s_nationkey": (3, None)}).alias("ok"))


@query(f"""WITH RECURSIVE {MONTHLY_SQL.strip()}, q AS (SELECT di, sym, con, x / nullif(lag(x) OVER o, 0) - 1 AS r FROM p {_W}), v AS (SELECT di, sym, con, CASE WHEN count(r) OVER t >= 3 THEN stddev_samp(r) OVER t END AS v FROM q WINDOW t AS (PARTITION BY sym ORDER BY di ROWS 5 PRECEDING)),
s AS (SELECT di AS key, sym AS id, 1 / v AS w FROM v WHERE con AND v > 0), l AS (SELECT key, list(w ORDER BY w DESC) AS a, sum(w) AS t FROM s GROUP BY key),
r AS (SELECT key, a, 0 AS k, t AS rest FROM l UNION ALL SELECT key, a, k + 1, rest - a[k + 1] FROM r WHERE k < len(a) AND a[k + 1] * greatest(1 - k * 0.2, 0) / rest >= 0.2), c AS (SELECT key, max(k) AS k, arg_max(rest, k) AS rest FROM r GROUP BY key),
n AS (SELECT s.key, id, w, row_number() OVER (PARTITION BY s.key ORDER BY w DESC, id) AS i FROM s), f AS (SELECT key, id, CASE WHEN i <= k THEN 0.2 ELSE w * greatest(1 - k * 0.2, 0) / rest END AS w FROM n JOIN c USING (key))
SELECT p.di, p.sym, round(coalesce(lag(coalesce(f.w, 0)) OVER (PARTITION BY p.sym ORDER BY p.di), 0), 6) + 0.0 AS w FROM p LEFT JOIN f ON f.key = p.di AND f.id = p.sym""")
def weights_inverse_volatility(spark, sf_dir):
    r = evaluate(monthly_panel(spark, sf_dir), {"r": "diff_q(x)", "con": "con_and(con,con)"})
    return _rounded(weights.next_day(weights.inverse_volatility(r, F.col("con"), F.col("r"), 6, 0.2)))


@query(f"WITH {_SERIES}, c AS (SELECT quantile_cont(abs(corr), 0.7) AS cut FROM k) SELECT a, b, round(corr, 6) + 0.0 AS corr, coalesce(abs(corr) >= cut, false) AS near FROM k, c")
def store_pairs_by_correlation(spark, sf_dir):
    return _rounded(weights.split_by_correlation(_pairs(spark, sf_dir).drop("days"), 0.7))


@query("SELECT x.p_brand, x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey WHERE x.p_size > 45 AND y.p_size > 45")
def store_pairs_within(spark, sf_dir):
    f = read(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("id"), "p_brand")
    return weights.inner_pairs(f, "p_brand").select("p_brand", "a", "b")


@query("SELECT x.p_brand, x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand WHERE x.p_size > 47 AND y.p_size < 4")
def store_pairs_across(spark, sf_dir):
    f = lambda ok: read(spark, sf_dir, "part").where(ok).select(F.col("p_partkey").alias("id"), "p_brand")
    return weights.cross_pairs(f("p_size > 47"), f("p_size < 4"), "p_brand").select("p_brand", "a", "b")


@query("""WITH q AS (SELECT o_custkey, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT * FROM (SELECT DISTINCT o_custkey FROM q), (SELECT DISTINCT y FROM q)), d AS (SELECT o_custkey, y, coalesce(n, 0) AS n FROM c LEFT JOIN q USING (o_custkey, y))
SELECT o_custkey, y, (y - coalesce(max(CASE WHEN n = 0 THEN y END) OVER (PARTITION BY o_custkey ORDER BY y ROWS UNBOUNDED PRECEDING), min(y) OVER (PARTITION BY o_custkey) - 1))::INT AS run FROM d""")
def store_consecutive(spark, sf_dir):
    q = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    whole = q.select("o_custkey").distinct().crossJoin(F.broadcast(q.select("y").distinct())).join(q, ["o_custkey", "y"], "left")
    return weights.consecutive(whole, "o_custkey", "y", "n").select("o_custkey", "y", "run")


@query(f"""WITH RECURSIVE {MONTHLY_SQL.strip()}, nd AS (SELECT count(*) AS n FROM cal), w AS (SELECT 0 AS fold, 37::BIGINT AS s, least(37 + 9, n) AS e FROM nd UNION ALL SELECT fold + 1, e, least(e + 9, n) FROM w, nd WHERE e < n),
r AS (SELECT fold, 'train' AS part, greatest(0, s - 7 - 30) AS a, s - 8 AS b FROM w UNION ALL SELECT fold, 'validation', s - 7, s - 2 FROM w UNION ALL SELECT fold, 'test', s, e - 1 FROM w)
SELECT CAST(fold AS INT) AS fold, part, count(x) AS cells, CAST(min(di) AS INT) AS first, CAST(max(di) AS INT) AS last FROM r JOIN p ON di BETWEEN a AND b GROUP BY 1, 2""")
def rolling_parts(spark, sf_dir):
    parts = labelled_parts(monthly_panel(spark, sf_dir), rolling_ranges(spark, _months(spark, sf_dir), 30, 6, 1, 9))
    return parts.groupBy("fold", "part").agg(F.count("x").alias("cells"), F.min("di").alias("first"), F.max("di").alias("last"))


@query(f"""WITH {MONTHLY_SQL.strip()}, r AS (SELECT *, CASE WHEN date BETWEEN DATE '1992-01-01' AND DATE '1994-12-31' THEN 'train' WHEN date BETWEEN DATE '1995-02-01' AND DATE '1995-12-31' THEN 'validation' WHEN date BETWEEN DATE '1996-02-01' AND DATE '1998-12-31' THEN 'test' END AS part FROM p)
SELECT part, count(x) AS cells, CAST(min(di) AS INT) AS first, CAST(max(di) AS INT) AS last FROM r WHERE part IS NOT NULL GROUP BY 1""")
def fixed_parts(spark, sf_dir):
    parts = fixed_dates(monthly_panel(spark, sf_dir), ("1992-01-01", "1994-12-31"), ("1995-02-01", "1995-12-31"), ("1996-02-01", "1998-12-31"))
    return parts.groupBy("part").agg(F.count("x").alias("cells"), F.min("di").alias("first"), F.max("di").alias("last"))


@query(f"""WITH {MINUTE_SQL.strip()}, a AS (SELECT *, amount4 / 10000.0 AS amount FROM b), m AS (SELECT *, avg(close) OVER (PARTITION BY date, sym) AS m FROM a)
SELECT date, sym, round(sum(ln(1 + abs(close / nullif(open, 0) - 1))) / nullif(sum(amount), 0), 6) + 0.0 AS path, round(sum(close * volume) / sum(volume) / nullif(avg(close), 0), 6) + 0.0 AS weighted_close,
CASE WHEN count(*) > 1 THEN round(CASE WHEN var_pop(close) > 1e-8 THEN sum(volume * pow(close - m, 3)) / sum(volume) / pow(stddev_pop(close), 3) ELSE 0 END, 6) + 0.0 END AS weighted_skew FROM m GROUP BY 1, 2""")
def minute_price_reducers(spark, sf_dir):
    bars = minute_bars(spark, sf_dir).withColumn("amount", F.col("amount4") / 10000.0)
    return _rounded(bars.groupBy("date", "sym").agg(*(c.alias(k) for k, c in minute.price_reducers().items())))


@query(f"""WITH {MINUTE_SQL.strip()}, k AS (SELECT date, sym, high AS y, open AS x FROM b WHERE close >= open), f AS (SELECT date, sym, count(*) AS n, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM k GROUP BY 1, 2)
SELECT b.date, b.sym, round(CASE WHEN n >= 5 THEN sqrt(greatest(vy - coalesce(c * c / nullif(vx, 0), 0), 0)) ELSE 0 END, 4) + 0.0 AS residual_std, round(CASE WHEN n >= 5 THEN sqrt(greatest(vy / (vy + 1e-12) + vx / (vx + 1e-12) - 2 * c / (sqrt(vy + 1e-12) * sqrt(vx + 1e-12)), 0)) ELSE 0 END, 4) + 0.0 AS distance
FROM (SELECT DISTINCT date, sym FROM b) b LEFT JOIN f USING (date, sym)""")
def minute_fits(spark, sf_dir):
    found = minute.fit_reducers("high", "open", F.col("close") >= F.col("open"))
    return _rounded(minute_bars(spark, sf_dir).groupBy("date", "sym").agg(*(c.alias(k) for k, c in found.items())), 4)


def _before(order: str) -> str:
    return f"""WITH {MINUTE_SQL.strip()}, a AS (SELECT date, minute, sym, close * volume AS a, coalesce(close / nullif(lag(close) OVER (PARTITION BY date, sym ORDER BY minute), 0) - 1, 0) AS r FROM b), s AS (SELECT *, a / nullif(sum(a) OVER (PARTITION BY date, minute), 0) AS s FROM a),
t AS (SELECT *, lag(s) OVER w AS before, row_number() OVER w = 1 AS first, row_number() OVER (PARTITION BY date, sym ORDER BY r {order}, minute) AS k FROM s WINDOW w AS (PARTITION BY date, sym ORDER BY minute))
SELECT date, sym, round(sum(coalesce(before, 0)) FILTER (k <= 30 AND NOT first) / nullif(count(*) FILTER (k <= 30 AND NOT first), 0) / nullif(avg(s), 0), 6) + 0.0 AS share FROM t GROUP BY 1, 2"""


@query(_before("DESC"))
def minute_share_before_highest(spark, sf_dir):
    return _rounded(minute.share_before(minute_bars(spark, sf_dir)))


@query(_before("ASC"))
def minute_share_before_lowest(spark, sf_dir):
    return _rounded(minute.share_before(minute_bars(spark, sf_dir), highest=False))


@query(f"""WITH {MINUTE_SQL.strip()}, m AS (SELECT date, sym, avg(close) AS m FROM b GROUP BY 1, 2), k AS (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY m) AS k FROM m), n AS (SELECT *, max(k) OVER (PARTITION BY date) AS n FROM k)
SELECT date, sym, count(*) AS minutes, round(max(high), 6) AS high FROM b JOIN n USING (date, sym) WHERE CASE WHEN n = 1 THEN 0.5 ELSE (k - 1) / (n - 1)::DOUBLE END BETWEEN 0.25 AND 0.75 GROUP BY 1, 2""")
def minute_state_mask(spark, sf_dir):
    return _rounded(minute.state_mask(minute_bars(spark, sf_dir), "close", 0.25, 0.75).groupBy("date", "sym").agg(F.count("*").alias("minutes"), F.max("high").alias("high")))


@query(f"""WITH {MINUTE_SQL.strip()}, a AS (SELECT *, amount4 / 10000.0 AS amount FROM b)
SELECT date, minute, sym, {', '.join(f"round({e}, 6) + 0.0 AS {k}" for k, e in {"spread": "high - low", "mid_price": "(high + low) / 2", "typical_price": "(high + low + close) / 3", "money_flow": "(high + low + close) / 3 * volume", "return_abs": "abs(close / nullif(open, 0) - 1)", "log_volume": "ln(1 + volume)", "log_amount": "ln(1 + greatest(amount, 0))", "price_range_pct": "(high - low) / nullif(close, 0)", "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low", "body": "abs(close - open)", "vwap_deviation": "(close - amount / volume) / nullif(amount / volume, 0)", "amihud": "abs(close / nullif(open, 0) - 1) / nullif(amount, 0)", "signed_volume": "sign(close - open) * volume"}.items())} FROM a""")
def minute_indicators(spark, sf_dir):
    bars = minute_bars(spark, sf_dir).withColumn("amount", F.col("amount4") / 10000.0)
    return _rounded(bars.select("date", "minute", "sym", *(c.alias(k) for k, c in minute.indicators().items())))

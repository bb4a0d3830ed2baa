"""Queries over tables with history: filings as known on a day, incremental runs, stores, universes, streams in batch
form, portfolios and clusters, each with SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .operator_queries import ORACLES, QUERIES, _rounded, query  # noqa: F401  the queries below go there
from .operators import bitemporal, crossday, evaluation, incremental, minute, portfolios, similarity, store, universes
from .sources import tables
from .sources.panels import MINUTE_SQL, MONTHLY_SQL, minute_bars, monthly_facts, monthly_panel, read, supplier_groups
from .streaming import bars, recurrence

# Filings of 50 firms made from orders: totals of the year so far and stocks a quarter, each known some weeks after it,
# a quarter of them restated months later.
FILINGS_SQL = """
o AS (SELECT o_custkey % 50 AS firm, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS period, round(o_totalprice * 100) / 64.0 AS v, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p FROM orders),
q AS (SELECT firm, period, sum(CASE WHEN s = 'F' THEN 2 * v ELSE -v END) AS profit, sum(v) AS revenue, sum(CASE WHEN p = '1' THEN -v ELSE v END) AS operating, sum(CASE WHEN p IN ('2', '3') THEN v ELSE v / 2 END) AS cost, sum(CASE WHEN s = 'O' THEN v ELSE 0 END) AS debt, sum(CASE WHEN p = '5' AND s = 'O' THEN v ELSE 0 END) AS long_debt FROM o GROUP BY 1, 2),
y AS (SELECT firm, period, sum(profit) OVER f AS profit, sum(revenue) OVER f AS revenue, sum(operating) OVER f AS operating, sum(cost) OVER f AS cost, sum(revenue) OVER h AS assets, sum(debt) OVER h AS debt, sum(revenue - debt) OVER h AS equity, sum(long_debt) OVER h AS long_debt FROM q
  WINDOW f AS (PARTITION BY firm, period // 4 ORDER BY period ROWS UNBOUNDED PRECEDING), h AS (PARTITION BY firm ORDER BY period ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, make_date(period // 4, CAST((period % 4) * 3 + 1 AS BIGINT), 1::BIGINT) + CAST(106 + (firm * 7 + period * 3) % 60 AS INT) AS known FROM y),
filings AS (SELECT firm, period, known, profit, revenue, operating, cost, assets, debt, equity, long_debt FROM k UNION ALL
  SELECT firm, period, known + CAST(120 + (firm + period) % 3 * 61 AS INT), profit * 0.75, revenue * 0.875, operating * 0.75, cost, assets, debt * 0.5, equity, long_debt FROM k WHERE (firm * 5 + period * 11) % 4 = 0)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    v, s, p = F.round(F.col("o_totalprice") * 100) / 64.0, F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    o = o.select((F.col("o_custkey") % 50).alias("firm"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("period"), v.alias("v"), s.alias("s"), p.alias("p"))
    given = {"profit": "IF(s = 'F', 2 * v, -v)", "revenue": "v", "operating": "IF(p = '1', -v, v)", "cost": "IF(p IN ('2', '3'), v, v / 2)", "debt": "IF(s = 'O', v, 0)", "long_debt": "IF(p = '5' AND s = 'O', v, 0)"}
    q = o.groupBy("firm", "period").agg(*(F.sum(F.expr(e)).alias(k) for k, e in given.items())).withColumn("assets", F.col("revenue")).withColumn("equity", F.col("revenue") - F.col("debt"))
    year, whole = (Window.partitionBy("firm", *by).orderBy("period").rowsBetween(Window.unboundedPreceding, 0) for by in ([F.expr("period DIV 4")], []))
    y = q.select("firm", "period", *(F.sum(f).over(year).alias(f) for f in bitemporal.FLOWS), *(F.sum(f).over(whole).alias(f) for f in bitemporal.STOCKS))
    k = y.withColumn("known", F.expr("date_add(make_date(CAST(period DIV 4 AS INT), CAST(period % 4 * 3 + 1 AS INT), 1), CAST(106 + (firm * 7 + period * 3) % 60 AS INT))"))
    again = k.where("(firm * 5 + period * 11) % 4 = 0").withColumns({"known": F.expr("date_add(known, CAST(120 + (firm + period) % 3 * 61 AS INT))"), "profit": F.col("profit") * 0.75, "revenue": F.col("revenue") * 0.875, "operating": F.col("operating") * 0.75, "debt": F.col("debt") * 0.5})
    return k.unionByName(again)


def _clip(e: str, low: float, high: float) -> str:
    return f"greatest(least({e}, {high}), {low})"


def _ratio(a: str, b: str, low: float, high: float) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} <> 0 THEN {_clip(f'{a} / {b}', low, high)} END"


def _growth(a: str, b: str, low: float, high: float, under: str = "{}") -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} <> 0 THEN {_clip(f'({a} - {b}) / ' + under.format(b), low, high)} END"


_SINGLE = ", ".join(f"CASE WHEN (latest - off) % 4 = 0 THEN {f} ELSE {f} - lead({f}) OVER w END AS {f}1" for f in bitemporal.FLOWS)
_YEARLY = ", ".join(f"CASE WHEN count({f}1) OVER t = 4 THEN sum({f}1) OVER t END AS {f}y" for f in bitemporal.FLOWS)
_AT = ", ".join([*(f"max({f}y) FILTER (off = {k}) AS {f}{k}" for f in bitemporal.FLOWS for k in (0, 4)), *(f"max({f}) FILTER (off = 0) AS {f}" for f in bitemporal.STOCKS), "max(assets) FILTER (off = 4) AS assets4", "max(roe) FILTER (off = 4) AS roe4", "list(roe ORDER BY off) FILTER (roe IS NOT NULL AND off <= 19) AS roes"])
_MEASURES = {
    **{f"{f}_ttm": f"{f}0" for f in bitemporal.FLOWS}, **{f: f for f in bitemporal.STOCKS},
    "roe": _ratio("profit0", "equity", -2, 2), "roe_trend": f"({_ratio('profit0', 'equity', -2, 2)}) - roe4", "roe_stability": "CASE WHEN len(roes) >= 8 THEN -list_aggregate(roes[1:12], 'stddev_samp') END",
    "profit_margin": _ratio("operating0", "revenue0", -5, 5), "cash_coverage": _ratio("operating0", "debt", -5, 5), "leverage": _ratio("debt", "assets", 0, 2), "asset_growth": _growth("assets", "assets4", -2, 10), "revenue_growth": _growth("revenue0", "revenue4", -2, 10),
    "earnings_growth": _growth("profit0", "profit4", -3, 10, "abs({})"), "net_margin": _ratio("profit0", "revenue0", -5, 5), "asset_turnover": _ratio("revenue0", "assets", 0, 20), "operating_cost_ratio": _ratio("cost0", "revenue0", 0, 5),
    "cost_ratio_trend": f"({_ratio('cost0', 'revenue0', 0, 5)}) - ({_ratio('cost4', 'revenue4', 0, 5)})", "long_term_debt_ratio": _ratio("long_debt", "debt", 0, 1),
}
SNAPSHOTS_SQL = f"""{FILINGS_SQL},
e AS (SELECT firm, known, max(max(period)) OVER (PARTITION BY firm ORDER BY known ROWS UNBOUNDED PRECEDING) AS latest FROM filings GROUP BY firm, known),
a AS (SELECT *, latest - off AS period FROM (SELECT *, unnest(range(0, 24)) AS off FROM e)),
once AS (SELECT DISTINCT ON (firm, period, known) * FROM filings ORDER BY firm, period, known, profit DESC),
l AS (SELECT a.firm, a.known, latest, off, profit, revenue, operating, cost, assets, debt, equity, long_debt FROM a ASOF LEFT JOIN once f ON a.firm = f.firm AND a.period = f.period AND a.known >= f.known),
s AS (SELECT *, {_SINGLE} FROM l WINDOW w AS (PARTITION BY firm, known ORDER BY off)),
t AS (SELECT *, {_YEARLY} FROM s WINDOW t AS (PARTITION BY firm, known ORDER BY off ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
r AS (SELECT *, {_ratio('profity', 'equity', -5, 5)} AS roe FROM t),
m AS (SELECT firm, known, latest, {_AT} FROM r GROUP BY firm, known, latest),
snapshots AS (SELECT firm, known, latest, {', '.join(f'{e} AS {k}' for k, e in _MEASURES.items())} FROM m)"""


def _round(columns) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


@query(f"WITH {SNAPSHOTS_SQL} SELECT firm, known, latest, {_round(_MEASURES)} FROM snapshots")
def bitemporal_snapshots(spark, sf_dir):
    return _rounded(bitemporal.fundamentals(filings(spark, sf_dir), ["firm"]))


_KEPT = ["profit_ttm", "revenue_growth", "roe", "roe_stability", "leverage"]


@query(f"""WITH {SNAPSHOTS_SQL}, cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), days AS (SELECT DISTINCT firm, last_day(date) AS date FROM cal, (SELECT DISTINCT o_custkey % 50 AS firm FROM orders)),
n AS (SELECT s.*, (SELECT min(date) FROM cal WHERE date > s.known) AS effective FROM snapshots s), u AS (SELECT DISTINCT ON (firm, effective) * FROM n WHERE effective IS NOT NULL ORDER BY firm, effective, known DESC)
SELECT d.firm, d.date, u.known, {', '.join(f'round(u.{c}, 6) + 0.0 AS {c}' for c in _KEPT)} FROM days d ASOF LEFT JOIN u ON d.firm = u.firm AND d.date >= u.effective""")
def bitemporal_panel(spark, sf_dir):
    events = bitemporal.fundamentals(filings(spark, sf_dir), ["firm"])
    calendar = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    firms = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("firm")).distinct()
    days = firms.crossJoin(calendar.select(F.last_day("date").alias("date")).distinct())
    return _rounded(bitemporal.panel(events, days, "firm", "known", calendar, _KEPT))


# the panel's dates are partitions; the last few were other values when the first run saw them
_CUT, _RESTATED = 70, 64
_GROWING = {"v": "ts_mean(x,6)", "r": "ts_delay(diff_q(x),-2)", "z": "cs_zscore(ts_delta(x,3))"}


def _source(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A table of the monthly panel as it was at the cut, and the panel as it is."""
    whole = monthly_panel(spark, sf_dir).select("date", "di", "sym", "x", "y", "w")
    path = tables.fresh_path(spark, "panel")
    early = F.when(F.col("di") >= _RESTATED, F.col("x") * 2).otherwise(F.col("x"))
    tables.replace_partitions(whole.where(F.col("di") < _CUT).withColumn("x", early), path, ["date"])
    return path, whole


_CS = "CASE WHEN {0} IS NOT NULL THEN CASE WHEN count({0}) OVER cs = 1 OR min({0}) OVER cs = max({0}) OVER cs THEN 0.0 ELSE ({0} - avg({0}) OVER cs) / stddev_samp({0}) OVER cs END END"


@query(f"""WITH {MONTHLY_SQL.strip()}, a AS (SELECT *, CASE WHEN count(x) OVER t >= 3 THEN avg(x) OVER t END AS v, x / nullif(lag(x) OVER o, 0) - 1 AS q, x - lag(x, 3) OVER o AS e FROM p WINDOW o AS (PARTITION BY sym ORDER BY di), t AS (PARTITION BY sym ORDER BY di ROWS 5 PRECEDING))
SELECT date, di, sym, round(v, 5) + 0.0 AS v, round(lead(q, 2) OVER (PARTITION BY sym ORDER BY di), 5) + 0.0 AS r, round({_CS.format('e')}, 5) + 0.0 AS z FROM a WINDOW cs AS (PARTITION BY di)""")
def incremental_values(spark, sf_dir):
    """A first run at the cut, then one more over the restated and the new dates."""
    source, whole = _source(spark, sf_dir)
    target = tables.fresh_path(spark, "values")
    incremental.refresh_formulas(spark, source, target, _GROWING)
    tables.replace_partitions(whole.where(F.col("di") >= _RESTATED), source, ["date"])
    since = whole.where(F.col("di") == _RESTATED).agg(F.min("date")).first()[0]
    incremental.refresh_formulas(spark, source, target, _GROWING, since)
    return _rounded(spark.read.parquet(target), 5)


@query(f"""WITH {MONTHLY_SQL.strip()} SELECT date, di, sym, CASE WHEN count(x) OVER t >= 3 THEN round(avg(x) OVER t, 5) + 0.0 END AS v, CASE WHEN di >= {_RESTATED} THEN 2 ELSE 1 END::INT AS run FROM p WINDOW t AS (PARTITION BY sym ORDER BY di ROWS 5 PRECEDING)""")
def stored_results(spark, sf_dir):
    """Run 1 at the cut, run 2 over all dates: it computes those from the first restated one on, the rest is reused."""
    source, whole = _source(spark, sf_dir)
    store = incremental.ResultStore(tables.fresh_path(spark, "results"))
    store.run(spark.read.parquet(source), "ts_mean(x,6)", run=1)
    tables.replace_partitions(whole.where(F.col("di") >= _RESTATED), source, ["date"])
    return _rounded(store.run(spark.read.parquet(source), "ts_mean(x,6)", run=2)[0], 5)


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::INT AS version FROM customer WHERE c_nationkey <> 7 AND c_custkey % 10 <> 4""")
def store_written(spark, sf_dir):
    """A table by nation: written, a third of it merged anew, rows and a whole nation deleted, read back."""
    path = tables.fresh_path(spark, "customers")
    first = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("balance"), F.lit(1).alias("version"))
    tables.replace_partitions(first, path, ["c_nationkey"])
    tables.merge(spark, path, first.where("c_custkey % 3 = 0").withColumns({"balance": F.round(F.col("balance") + 1, 2), "version": F.lit(2)}), ["c_custkey"], "version", ["c_nationkey"])
    tables.delete(spark, path, (F.col("c_nationkey") == 7) | (F.col("c_custkey") % 10 == 4), ["c_nationkey"])
    return spark.read.schema(first.schema).parquet(path)


# recurrences, windows and late duplicates of events, in the batch form of the streams
def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type").isin("view", "error"), False)
    return read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("x"), con.alias("con"))


_IDLE = 1.5
_SIGNALS = f"""s AS (SELECT user_id, event_id AS id, ts, CASE WHEN event_type <> 'error' THEN value END AS x, CASE WHEN event_type = 'purchase' THEN true WHEN event_type IN ('view', 'error') THEN false END AS con FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS stretch FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id)) > {int(_IDLE * 86_400_000_000)} THEN 1 ELSE 0 END AS new FROM s))"""


@query(f"""WITH {_SIGNALS}, k AS (SELECT user_id, stretch, id, ts, x, con, row_number() OVER (PARTITION BY user_id, stretch ORDER BY ts, id) AS n FROM b WHERE x IS NOT NULL AND con IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN con OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, stretch ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM k), o AS (SELECT id, list_reduce(list(x) OVER (PARTITION BY user_id, stretch, run ORDER BY n ROWS UNBOUNDED PRECEDING), lambda a, v: a * 0.8 + v * 0.2) AS out FROM r)
SELECT b.user_id, b.id, b.ts, round(o.out, 6) + 0.0 AS out FROM b LEFT JOIN o USING (id)""")
def event_blend(spark, sf_dir):
    return _rounded(recurrence.blended(_signals(spark, sf_dir), 0.2, idle_days=_IDLE))


@query(f"WITH {_SIGNALS} SELECT user_id, id, ts, coalesce(last_value(con::INT IGNORE NULLS) OVER (PARTITION BY user_id, stretch ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS out FROM b")
def event_holdings(spark, sf_dir):
    return recurrence.held(_signals(spark, sf_dir), idle_days=_IDLE)


@query("""WITH w AS (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 4 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS start, event_type, value FROM events)
SELECT start, start + INTERVAL 5 DAY AS "end", event_type, count(*) AS events, round(sum(value), 4) + 0.0 AS total, max(value) AS most FROM w GROUP BY start, event_type""")
def event_windows(spark, sf_dir):
    return bars.sliding(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4) + 0.0)


@query("SELECT date_trunc('minute', ts) AS minute, user_id AS sym, count(*) AS volume, min(value) AS low, max(value) AS high FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def event_bars(spark, sf_dir):
    return bars.streaming_bars(read(spark, sf_dir, "events"))


@query("SELECT event_id, user_id, event_type, ts, value FROM events")
def event_first_of_each(spark, sf_dir):
    """Events delivered once, and every third of them again up to forty minutes later with another value."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    again = e.where("event_id % 3 = 0").withColumns({"ts": F.expr("ts + make_dt_interval(0, 0, CAST(event_id % 40 + 1 AS INT))"), "value": F.col("value") + 1})
    return bars.first_of_each(again.unionByName(e), ["event_id", "user_id", "event_type"])


# selections over a grid of thresholds: suppliers' monthly quantities against the month's mean
_LEAST, _LEAST_IR, _MOST = [-2.0, 0.0, 0.25], [None, -0.02, 0.05], [0.0, 0.1, 0.2]
_SWEPT = f"""{MONTHLY_SQL.strip()}, v AS (SELECT sym AS id, di, (y - avg(y) OVER (PARTITION BY di)) / 64 AS v FROM p), st AS (SELECT id, avg(v) AS rankic, avg(v) / stddev_samp(v) AS rankicir FROM v WHERE v IS NOT NULL GROUP BY id),
co AS (SELECT a.id AS a, b.id AS b, corr(a.v, b.v) AS corr FROM v a JOIN v b ON a.di = b.di AND a.id < b.id WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2 HAVING min(a.v) < max(a.v) AND min(b.v) < max(b.v)),
gr1 AS (SELECT * FROM (SELECT unnest({[-9e9 if x is None else x for x in _LEAST_IR]}) AS ir), (SELECT unnest({_MOST}) AS c)),
n AS (SELECT ir, c, id, row_number() OVER (PARTITION BY ir, c ORDER BY rankic DESC, id) AS n FROM st, gr1 WHERE rankic >= {min(_LEAST)} AND (ir < -1e9 OR rankicir >= ir)),
u AS (SELECT a, b, corr FROM co UNION ALL SELECT b, a, corr FROM co), e AS (SELECT c, a, list(b) AS near FROM u JOIN (SELECT DISTINCT c FROM gr1) ON corr > c GROUP BY c, a), o AS (SELECT n.*, coalesce(near, []) AS near FROM n LEFT JOIN e ON e.c = n.c AND e.a = n.id),
r AS (SELECT ir, c, 0::BIGINT AS n, []::BIGINT[] AS kept FROM gr1 UNION ALL SELECT r.ir, r.c, o.n, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, id) END FROM r JOIN o ON o.ir = r.ir AND o.c = r.c AND o.n = r.n + 1),
k AS (SELECT ir, c, arg_max(kept, n) AS kept FROM r GROUP BY ir, c), picks AS (SELECT least, ir, c, id, rankic, rankicir FROM (SELECT ir, c, unnest(kept) AS id FROM k) JOIN st USING (id), (SELECT unnest({_LEAST}) AS least) WHERE rankic >= least)"""


def _swept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # pairs ask only that months be the same and sums that they be in order, so cells that are missing need no row; a
    # supplier that is listed twice counts twice in a month's mean, as in the panel
    y = monthly_facts(spark, sf_dir).where("date IS NOT NULL AND sym IS NOT NULL").join(supplier_groups(spark, sf_dir), "sym", "left")
    y = tables_written(y.select("date", F.col("sym").alias("id"), "y"), "quantities")
    level = F.broadcast(y.groupBy("date").agg(F.avg("y").alias("level")))
    v = y.join(level, "date").select("id", (F.year("date") * 12 + F.month("date")).alias("di"), ((F.col("y") - F.col("level")) / 64).alias("v"))
    return store.series_sweep(tables_written(store.packed_series(v), "series"), _LEAST, _LEAST_IR, _MOST)


def tables_written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, reread: what several steps start from is computed once."""
    path = tables.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(f"""WITH RECURSIVE {_SWEPT}, s AS (SELECT least, ir, c, count(*) AS count, avg(rankic) AS avg_rankic, min(rankic) AS min_rankic, avg(rankicir) AS avg_rankicir FROM picks GROUP BY 1, 2, 3),
w AS (SELECT x.least, x.ir, x.c, max(corr) AS mx, avg(corr) AS av FROM picks x JOIN co ON co.a = x.id JOIN picks z ON z.id = co.b AND z.least = x.least AND z.ir = x.ir AND z.c = x.c WHERE corr IS NOT NULL GROUP BY 1, 2, 3)
SELECT l.least, CASE WHEN g.ir > -1e9 THEN g.ir END::DOUBLE AS least_ir, g.c::DOUBLE AS most_corr, coalesce(count, 0) AS count, round(avg_rankic, 6) AS avg_rankic, round(min_rankic, 6) AS min_rankic, round(avg_rankicir, 6) AS avg_rankicir, round(mx, 6) AS max_pair_corr, round(av, 6) AS avg_pair_corr
FROM gr1 g CROSS JOIN (SELECT unnest({_LEAST})::DOUBLE AS least) l LEFT JOIN s ON s.least = l.least AND s.ir = g.ir AND s.c = g.c LEFT JOIN w ON w.least = l.least AND w.ir = g.ir AND w.c = g.c""")
def store_sweep(spark, sf_dir):
    return _rounded(_swept(spark, sf_dir)[0])


@query(f"WITH RECURSIVE {_SWEPT} SELECT least::DOUBLE AS least, CASE WHEN ir > -1e9 THEN ir END::DOUBLE AS least_ir, c::DOUBLE AS most_corr, id FROM picks")
def store_sweep_picks(spark, sf_dir):
    return _swept(spark, sf_dir)[1]


# five rounds of spherical k-means, each written out
_K, _ROUNDS = 20, 5


def _kmeans_sql() -> str:
    ctes = ["v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / coalesce(nullif(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 0), 1)) AS v FROM embeddings WHERE embedding IS NOT NULL)", f"c0 AS (SELECT row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS c, v AS m FROM v ORDER BY md5('42:' || id), id LIMIT {_K})"]
    dot = "round(list_sum(list_transform(list_zip(v, m), lambda z: z[1] * z[2])), 12)"
    for k in range(_ROUNDS + 1):
        ctes.append(f"a{k} AS (SELECT id, any_value(v) AS v, arg_max(c, {{'s': {dot}, 'c': -c}}) AS c, max({dot}) AS s FROM v, c{k} GROUP BY id)")
        if k < _ROUNDS:
            ctes.append(f"s{k} AS (SELECT c, i, sum(x) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) GROUP BY c, i)")
            ctes.append(f"u{k} AS (SELECT c, list(x ORDER BY i) AS l, sqrt(sum(x * x)) AS n FROM s{k} GROUP BY c)")
            ctes.append(f"c{k + 1} AS (SELECT c{k}.c, CASE WHEN n > 0 THEN list_transform(l, lambda x: x / n) ELSE m END AS m FROM c{k} LEFT JOIN u{k} USING (c))")
    return f"WITH {', '.join(ctes)} SELECT id, c::INT AS cluster, round(s, 6) + 0.0 AS similarity FROM a{_ROUNDS}"


@query(_kmeans_sql())
def vector_clusters(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _rounded(similarity.spherical_kmeans(v, _K, _ROUNDS))


# yearly portfolios of suppliers, held over the year's months
_SORTS = {"smb": portfolios.Sort("x", 0.5, 0.5, -1), "hml": portfolios.Sort("bp"), "cma": portfolios.Sort("growth", sign=-1), "hml2": portfolios.Sort("bp", within="half")}
_BUILT = f"""{MONTHLY_SQL.strip()}, a AS (SELECT *, y / w / 64 AS bp, x - lag(x, 3) OVER o AS growth, x / nullif(lag(x) OVER o, 0) - 1 AS r, year(date) AS period FROM p {"WINDOW o AS (PARTITION BY sym ORDER BY di)"}),
f AS (SELECT period, min(di) - 1 AS di FROM a GROUP BY period), s0 AS (SELECT f.period, a.sym, x, bp, growth FROM a JOIN f USING (di) WHERE w >= 1), s AS (SELECT *, CASE WHEN x IS NOT NULL THEN (x > median(x) OVER (PARTITION BY period))::INT END AS half FROM s0),
c1 AS (SELECT period, sym, 'smb' AS factor, -1 AS cell, x AS s, 0.5 AS lo, 0.5 AS hi FROM s UNION ALL SELECT period, sym, 'hml', -1, bp, 0.3, 0.7 FROM s UNION ALL SELECT period, sym, 'cma', -1, growth, 0.3, 0.7 FROM s UNION ALL SELECT period, sym, 'hml2', half, bp, 0.3, 0.7 FROM s WHERE half IS NOT NULL),
q AS (SELECT period, factor, cell, quantile_cont(s, 0.5) AS q5, quantile_cont(s, 0.3) AS q3, quantile_cont(s, 0.7) AS q7 FROM c1 WHERE s IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4),
mb AS (SELECT c1.period, sym, factor, cell, CASE WHEN s <= CASE WHEN factor = 'smb' THEN q5 ELSE q3 END THEN -1 WHEN CASE WHEN factor = 'smb' THEN s > q5 ELSE s >= q7 END THEN 1 END AS part FROM c1 JOIN q USING (period, factor, cell) WHERE s IS NOT NULL),
d AS (SELECT date, factor, cell, avg(r) FILTER (part = 1) - avg(r) FILTER (part = -1) AS d FROM a JOIN mb USING (period, sym) WHERE part IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT date, factor, avg(d) AS d FROM d GROUP BY 1, 2),
w AS (SELECT a.date, a.di, {', '.join(f"CASE WHEN count(*) FILTER (factor = '{n}') = 0 THEN 0.0 ELSE {'-' if n in ('smb', 'cma') else ''}max(d) FILTER (factor = '{n}') END AS {n}" for n in ('smb', 'hml', 'cma', 'hml2'))} FROM (SELECT DISTINCT date, di FROM a) a LEFT JOIN g USING (date) GROUP BY 1, 2)"""


@query(f"""WITH {_BUILT} SELECT date, di, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SORTS)}, {', '.join(f'CASE WHEN count({c}) OVER t{n} = {n} THEN round(sum({c}) OVER t{n}, 6) + 0.0 END AS {c}_{n}' for c in ('smb', 'hml') for n in (3, 12))}
FROM w WINDOW t3 AS (ORDER BY di ROWS 2 PRECEDING), t12 AS (ORDER BY di ROWS 11 PRECEDING)""")
def portfolio_factors(spark, sf_dir):
    o = Window.partitionBy("sym").orderBy("di")
    p = monthly_panel(spark, sf_dir).withColumns({"bp": F.col("y") / F.col("w") / 64, "growth": F.col("x") - F.lag("x", 3).over(o), "r": F.try_divide("x", F.lag("x").over(o)) - 1})
    signals = portfolios.halves(portfolios.signal_rows(p, F.year("date"), F.col("w") >= 1), "x", "half")
    held = portfolios.members(signals, _SORTS, least=4)
    return _rounded(portfolios.rolled(portfolios.factor_returns(p, F.year("date"), "r", held, _SORTS), ["smb", "hml"], (3, 12)))


# bars of three groups of users, so that a day has enough of them
_BUSY = f"""{MINUTE_SQL.strip()}, bb AS (SELECT date, minute, sym % 3 AS sym, min(open) AS open, max(close) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume, sum(amount4)::DOUBLE / 10000 AS amount FROM b GROUP BY 1, 2, 3)"""


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = minute_bars(spark, sf_dir).groupBy("date", "minute", (F.col("sym") % 3).alias("sym"))
    return b.agg(F.min("open").alias("open"), F.max("close").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), (F.sum("amount4").cast("double") / 10000).alias("amount"))


@query(f"""WITH {_BUSY}, r AS (SELECT *, close / nullif(open, 0) - 1 AS r, abs(close - lag(close) OVER (PARTITION BY date, sym ORDER BY minute)) AS d FROM bb),
f AS (SELECT date, sym, avg(abs(r) / (amount + 1e-8)) AS amihud, coalesce(sum(volume) FILTER (minute >= 1410), 0) / (sum(volume) + 1e-8) AS tail_vol_share, (max(high) - arg_max(close, minute)) / (abs(max(high) - arg_min(open, minute)) + 1e-8) AS high_to_close,
  coalesce(sum(sign(r) * volume), 0) / (sum(volume) + 1e-8) AS order_imbalance, abs(arg_max(close, minute) - arg_min(open, minute)) / (coalesce(sum(d), 0) + 1e-8) AS path_efficiency FROM r GROUP BY 1, 2),
c AS (SELECT date, row_number() OVER (ORDER BY date)::INT - 1 AS di FROM (SELECT DISTINCT date FROM f)), g AS (SELECT c.date, c.di, s.sym, f.* EXCLUDE (date, sym) FROM c CROSS JOIN (SELECT DISTINCT sym FROM f) s LEFT JOIN f ON f.date = c.date AND f.sym = s.sym)
SELECT date, di::INT AS di, sym, {', '.join(f"round(CASE WHEN {c} IS NOT NULL AND count({c}) OVER t >= 5 THEN ({c} - avg({c}) OVER t) / sqrt(greatest(var_pop({c}) OVER t, 1e-8)) ELSE 0 END, 4) + 0.0 AS anom_{c}_z20" for c in crossday.FEATURES)} FROM g WINDOW t AS (PARTITION BY sym ORDER BY di ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def minute_anomalies(spark, sf_dir):
    return _rounded(crossday.anomaly_panels(_busy(spark, sf_dir)), 4)


def _corr(a: str, b: str, over: str = "{0}") -> str:
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"CASE WHEN min({a}) {both} < max({a}) {both} AND min({b}) {both} < max({b}) {both} THEN corr({a}, {b}) END"


_LAGS = {k: f"corr_{'m' if k < 0 else 'p'}{abs(k)}" for k in range(-3, 4)}


@query(f"""WITH {_BUSY}, l AS (SELECT date, sym, close AS y, {', '.join(f'lag(volume, {k}) OVER o AS x{n}' for k, n in _LAGS.items())} FROM bb WINDOW o AS (PARTITION BY date, sym ORDER BY minute)), c AS (SELECT date, sym, {', '.join(f"{_corr('x' + n, 'y')} AS {n}" for n in _LAGS.values())} FROM l GROUP BY 1, 2),
u AS (SELECT date, sym, arg_max(k, {{'r': round(abs(c), 9), 'k': -k}}) AS best_lag, max(round(abs(c), 9)) AS best_corr FROM (SELECT date, sym, unnest([{', '.join(map(str, _LAGS))}]) AS k, unnest([{', '.join(_LAGS.values())}]) AS c FROM c) WHERE c IS NOT NULL GROUP BY 1, 2)
SELECT c.date, c.sym, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in _LAGS.values())}, best_lag::INT AS best_lag, round(best_corr, 6) + 0.0 AS best_corr FROM c LEFT JOIN u USING (date, sym)""")
def minute_lag_correlations(spark, sf_dir):
    return _rounded(minute.lag_correlations(_busy(spark, sf_dir), "volume", "close"))


@query(f"""WITH {_BUSY}, k AS (SELECT date, sym, (minute - 60) // 440 AS part, {_corr('close', 'high')} AS c FROM bb WHERE minute BETWEEN 60 AND 1380 GROUP BY 1, 2, 3), m AS (SELECT date, sym, CASE WHEN count(c) FILTER (part < 3) = 3 THEN max(abs(c)) FILTER (part < 3) END AS max_corr FROM k GROUP BY 1, 2),
q AS (SELECT date, sym, quantile_cont(close, 0.3) AS lo, quantile_cont(close, 0.7) AS hi FROM bb GROUP BY 1, 2), t AS (SELECT date, sym, CASE WHEN close <= lo OR close >= hi THEN close END AS a, CASE WHEN close <= lo OR close >= hi THEN volume + low END AS b FROM bb JOIN q USING (date, sym)), n AS (SELECT date, sym, {_corr('a', 'b')} AS tail_corr FROM t GROUP BY 1, 2)
SELECT date, sym, round(max_corr, 6) + 0.0 AS max_corr, round(tail_corr, 6) + 0.0 AS tail_corr FROM m FULL JOIN n USING (date, sym)""")
def minute_tail_correlations(spark, sf_dir):
    b = _busy(spark, sf_dir).withColumn("u", F.col("volume") + F.col("low"))
    parts = minute.part_correlation(b, "close", "high", 60, 1380)
    return _rounded(parts.join(minute.tail_correlation(b, "close", "u"), ["date", "sym"], "full"))


# universes of suppliers by month
_FLAGS = {"hs300s": "w >= 9", "zz500s": "w BETWEEN 7 AND 8", "zz1000s": "w BETWEEN 5 AND 6", "zzhls": "y > 260", "stables": "sym % 7 <> 3", "liquid": "x >= 40", "liq_div3y": "x >= 60 AND y >= 150"}
_IN = {n: f"coalesce({e}, false)" for n, e in _FLAGS.items()}
_IN |= {"standards": f"({_IN['stables']} AND {_IN['liquid']})", "top1800s": f"({_IN['zz1000s']} OR {_IN['zz500s']} OR {_IN['hs300s']})"}
_IN |= {"universe_A1800_zzhls": f"({_IN['top1800s']} OR {_IN['zzhls']})", "universe_liq_div3y_A1800": f"({_IN['liq_div3y']} OR {_IN['top1800s']} OR {_IN['zzhls']})", "smalls": f"({_IN['standards']} AND NOT {_IN['hs300s']} AND NOT {_IN['zz500s']})"}


def _universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = monthly_panel(spark, sf_dir)
    made = universes.DAILY.made(p, {n: F.expr(e) for n, e in _FLAGS.items()})
    return universes.DAILY.derive(made, universes.RULES)


@query(f"""WITH {MONTHLY_SQL.strip()} SELECT date, sym, ({' + '.join(f'(CASE WHEN {_IN[n]} THEN {1 << k} ELSE 0 END)' for k, n in enumerate(universes.DAILY.names))})::BIGINT AS bits, CASE WHEN {_IN['smalls']} THEN round(x, 6) END AS small_x, {_IN['smalls']} OR {_IN['zzhls']} AS either FROM p""")
def universe_bits(spark, sf_dir):
    u = universes.DAILY
    return _rounded(_universes(spark, sf_dir).select("date", "sym", "bits", u.within(F.col("x"), "smalls", F.col("bits")).alias("small_x"), u.has(F.col("bits"), any_of=("smalls", "zzhls")).alias("either")))


@query(f"""WITH {MONTHLY_SQL.strip()} SELECT date, {', '.join(f'count(*) FILTER ({_IN[n]}) AS {n}' for n in universes.DAILY.names)}, ({' + '.join(f'(CASE WHEN bool_or({_IN[n]}) THEN {1 << k} ELSE 0 END)' for k, n in enumerate(universes.DAILY.names))})::BIGINT AS some,
({' + '.join(f'(CASE WHEN bool_and({_IN[n]}) THEN {1 << k} ELSE 0 END)' for k, n in enumerate(universes.DAILY.names))})::BIGINT AS every FROM p GROUP BY date""")
def universe_sizes(spark, sf_dir):
    return universes.DAILY.sizes(_universes(spark, sf_dir), ["date"])


@query(ORACLES["eval_neutralized"])
def incremental_neutralized(spark, sf_dir):
    """Values neutralised on size and group date by date, kept up to date: a run at the cut, one over the rest."""
    whole = monthly_panel(spark, sf_dir).select("date", "di", "sym", F.col("x").alias("v"), F.col("w").alias("size"), "g")
    source, target = tables.fresh_path(spark, "fields"), tables.fresh_path(spark, "neutralized")

    def neutral(part: DataFrame) -> DataFrame:
        return evaluation.neutralized(part).join(F.broadcast(part.select("date", "di").distinct()), "di")

    tables.replace_partitions(whole.where(F.col("di") < _CUT).withColumn("v", F.when(F.col("di") >= _RESTATED, F.col("v") + 1).otherwise(F.col("v"))), source, ["date"])
    incremental.refresh(spark, source, target, neutral, (0, 0))
    tables.replace_partitions(whole.where(F.col("di") >= _RESTATED), source, ["date"])
    since = whole.where(F.col("di") == _RESTATED).agg(F.min("date")).first()[0]
    incremental.refresh(spark, source, target, neutral, (0, 0), since)
    return _rounded(spark.read.parquet(target).select("di", "sym", "v"))

"""Evaluation of formula values against later returns: correlations, long portfolio, turnover, coverage, summaries.

One row per date leaves each grouped step; only the summary over dates meets in one task, a row for each date."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.canonical import unit_rank
from ..functions.registry import OPS, cs, history


def run_stages(df: DataFrame, stages) -> tuple[DataFrame, Column]:
    """Materialises a function builder's stages on df; returns the frame and the result."""
    sent, k = None, len(df.columns)
    try:
        while True:
            asked = stages.send(sent)
            names = {c: f"_{k + i}_{c}" for i, c in enumerate(asked)}
            k += len(asked)
            df = df.withColumns({names[c]: e for c, e in asked.items()})
            sent = {c: F.col(n) for c, n in names.items()}
    except StopIteration as e:
        return df, e.value


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's correlation as an aggregate; NULL where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))


def daily_results(values: DataFrame, top: float = 0.8) -> DataFrame:
    """values(di, sym, v, ret): per date ic, rankic, longret (mean return of ranks from top up), coverage, n."""
    df, rank = run_stages(values, unit_rank(F.col("v"), "di"))
    df = df.withColumn("rv", rank)
    df, rank = run_stages(df, unit_rank(F.col("ret"), "di"))
    df = df.withColumn("rr", rank)
    return df.groupBy("di").agg(
        safe_corr(F.col("v"), F.col("ret")).alias("ic"), safe_corr(F.col("rv"), F.col("rr")).alias("rankic"),
        F.avg(F.when(F.col("rv") >= top, F.col("ret"))).alias("longret"), (F.count("v") / F.count("*")).alias("coverage"), F.count("v").alias("n"),
    )


def turnover(values: DataFrame, top: float = 0.8) -> DataFrame:
    """Per date the sum of absolute changes of equal weights on the ranks from top up."""
    df, rank = run_stages(values.select("di", "sym", "v"), unit_rank(F.col("v"), "di"))
    held = df.withColumn("h", F.when(rank >= top, 1.0).otherwise(0.0))
    weight = F.coalesce(F.try_divide(F.col("h"), F.sum("h").over(cs())), F.lit(0.0))
    moved = held.withColumn("w", weight).withColumn("d", F.abs(F.col("w") - F.lag("w", 1, 0.0).over(history())))
    return moved.groupBy("di").agg(F.sum("d").alias("turnover"))


def summary(daily: DataFrame, year: float = 243.0) -> DataFrame:
    """One row: means, information ratios and the annualised long return."""
    ratio = lambda c: F.when(F.min(c) < F.max(c), F.avg(c) / F.stddev_samp(c))
    return daily.agg(F.avg("ic").alias("ic"), ratio("ic").alias("icir"), F.avg("rankic").alias("rankic"), ratio("rankic").alias("rankicir"), (F.avg("longret") * year).alias("longret"), F.avg("coverage").alias("coverage"), F.count("rankic").alias("dates"))


def group_returns(values: DataFrame, n: int = 10) -> DataFrame:
    """Per date and rank bucket: mean return and members."""
    df, rank = run_stages(values, unit_rank(F.col("v"), "di"))
    bucket = F.when(rank.isNotNull(), F.least(F.floor(rank * (n - 1e-9)), F.lit(n - 1))).cast("int")
    return df.withColumn("bucket", bucket).where("bucket IS NOT NULL AND ret IS NOT NULL").groupBy("di", "bucket").agg(F.avg("ret").alias("ret"), F.count("*").alias("members"))


def performance(returns: DataFrame, key: str = "key", year: float = 243.0) -> DataFrame:
    """returns(key, di, r): per key annualised return, information ratio, wealth, and greatest drawdown."""
    to_here = Window.partitionBy(key).orderBy("di").rowsBetween(Window.unboundedPreceding, 0)
    wealth = returns.withColumn("w", F.exp(F.sum(F.log1p("r")).over(to_here)))
    fall = wealth.withColumn("fall", 1 - F.col("w") / F.greatest(F.max("w").over(to_here), F.lit(1.0)))
    ratio = F.when(F.min("r") < F.max("r"), F.avg("r") / F.stddev_samp("r") * (year**0.5))
    return fall.groupBy(key).agg((F.avg("r") * year).alias("ann_ret"), ratio.alias("ir"), F.max_by("w", "di").alias("wealth"), F.max("fall").alias("max_drawdown"))


def holdings(signals: DataFrame) -> DataFrame:
    """signals(sym, di, target, buyable, sellable): held (0/1). A target is bought when it can be, what is no target is
    sold when it can be; otherwise the position stays. The last decisive event decides, so no day loop is needed."""
    event = F.when(F.col("target") & F.col("buyable"), 1).when(~F.col("target") & F.col("sellable"), 0)
    to_here = history().rowsBetween(Window.unboundedPreceding, 0)
    return signals.withColumn("held", F.coalesce(F.last(event, ignorenulls=True).over(to_here), F.lit(0)))


def portrait(daily: DataFrame, date: str = "date") -> DataFrame:
    """Mean RankIC over all dates, by year and by quarter, as grouping sets."""
    keyed = daily.select(F.year(date).alias("y"), F.quarter(date).alias("q"), "rankic")
    return keyed.rollup("y", "q").agg(F.avg("rankic").alias("rankic"), F.count("rankic").alias("dates"))


def neutralized(values: DataFrame, least: int = 50, mult: float = 5 * 1.4826) -> DataFrame:
    """values(di, sym, v, size, g): per date, v clipped at median +- mult MADs, standardised, and its residual on size
    and group dummies, standardised: demeaning both within the group leaves one regression through the origin."""
    w = cs()
    df = values.withColumn("_m", F.percentile("v", F.lit(0.5)).over(w)).withColumn("_d", F.abs(F.col("v") - F.col("_m")))
    df = df.withColumn("_k", F.percentile("_d", F.lit(0.5)).over(w) * mult)
    df = df.withColumn("_c", F.when(F.col("v").isNotNull() & F.col("size").isNotNull() & F.col("g").isNotNull(), F.greatest(F.least(F.col("v"), F.col("_m") + F.col("_k")), F.col("_m") - F.col("_k")))).withColumn("_s", F.when(F.col("_c").isNotNull(), F.col("size")))
    g = Window.partitionBy("di", "g")
    df = df.withColumn("_y", F.col("_c") - F.avg("_c").over(g)).withColumn("_x", F.col("_s") - F.avg("_s").over(g))
    beta = F.coalesce(F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(w), F.sum(F.col("_x") * F.col("_x")).over(w)), F.lit(0.0))
    df = df.withColumn("_b", beta).withColumn("_r", F.col("_y") - F.col("_b") * F.col("_x"))
    z = F.when((F.count("_r").over(w) >= least) & (F.min("_r").over(w) < F.max("_r").over(w)), (F.col("_r") - F.avg("_r").over(w)) / F.stddev_samp("_r").over(w))
    return df.select("di", "sym", z.alias("v"))


def nav(book: DataFrame, buy: float = 0.0001, sell: float = 0.0006) -> DataFrame:
    """book(di, sym, w, r): weights held over a date and the date's returns. Per date: gross and net return, turnover,
    and both wealths. Trades go from the drifted weights of the date before to the new ones; buying and selling cost
    their rates. Every name is taken to be tradable, so the dates couple through windows only."""
    c = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    day = book.select("di", "sym", c("w").alias("w"), c("r").alias("r")).withColumn("whole", F.sum(F.col("w") * F.col("r")).over(cs()))
    drifted = F.coalesce(F.lag(F.col("w") * (1 + F.col("r")) / (1 + F.col("whole"))).over(history()), F.lit(0.0))
    moved = day.withColumn("d", F.col("w") - drifted)
    cost = F.when(F.col("d") > 0, F.col("d") * buy).otherwise(-F.col("d") * sell)
    daily = moved.groupBy("di").agg(F.sum(F.col("w") * F.col("r")).alias("gross"), F.sum(cost).alias("cost"), F.sum(F.abs("d")).alias("turnover"))
    to_here = Window.orderBy("di").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    wealth = lambda e: F.exp(F.sum(F.log1p(e)).over(to_here))
    net = F.col("gross") - F.col("cost")
    return daily.select("di", "gross", net.alias("net"), "turnover", wealth(F.col("gross")).alias("gross_nav"), wealth(net).alias("net_nav"))


def processed(values: DataFrame, decay: int, standards: Column) -> DataFrame:
    """values(di, sym, v, ...) after post-processing: v decayed over so many rows (0: as it is), then kept where standards
    holds."""
    v = F.col("v")
    if decay:
        values, v = run_stages(values, _returned(OPS["ts_decay_linear"].build(v, decay)))
    return values.withColumn("v", F.when(F.coalesce(standards, F.lit(False)), v))


def _returned(made):
    """A builder's result as stages, whether it has some or none."""
    return (yield from made) if inspect.isgenerator(made) else made


def profiled(values: DataFrame, profiles: dict[str, tuple[int, int | None]], top: float = 0.8, year: float = 243.0, ahead: int = 2) -> DataFrame:
    """values(di, sym, v, universe, buyable, ret) evaluated for each profile, a range of dates (from, to or none).

    Returns count where universe and buyable hold, values are ranked among the buyable, coverage is of the universe. A
    profile leaves out its last `ahead` dates, whose returns lie beyond it, and its first date has no turnover. Every
    date is worked out once, whatever the number of profiles; a profile then reads one row a date."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = values.select("di", "sym", "v", flag("universe").alias("universe"), flag("buyable").alias("buyable"), F.when(flag("universe") & flag("buyable"), F.col("ret")).alias("ret"))
    df = df.withColumn("_b", F.when(F.col("buyable"), F.col("v")))
    df, rank = run_stages(df, unit_rank(F.col("_b"), "di"))
    df = df.withColumn("_rv", rank)
    df, rank = run_stages(df, unit_rank(F.col("ret"), "di"))
    top_here = F.coalesce(F.col("_rv") >= top, F.lit(False))
    df = df.withColumn("_rr", rank).withColumn("_top", F.when(top_here, 1).otherwise(0))
    weight = F.coalesce(F.try_divide(F.col("_top").cast("double"), F.sum("_top").over(cs())), F.lit(0.0))
    df = df.withColumn("_w", weight).withColumn("_d", F.abs(F.col("_w") - F.lag("_w").over(history())))
    ranked = F.count("_rv") > 0
    daily = df.groupBy("di").agg(
        safe_corr(F.col("_b"), F.col("ret")).alias("ic"), safe_corr(F.col("_rv"), F.col("_rr")).alias("rankic"),
        F.when(ranked, F.coalesce(F.try_divide(F.sum(F.when(F.col("_top") == 1, F.col("ret"))), F.sum("_top")), F.lit(0.0)) * year).alias("longret"),
        F.try_divide(F.count(F.when(F.col("universe"), F.col("v"))), F.count(F.when(F.col("universe"), 1))).alias("coverage"), F.sum("_d").alias("turnover"),
    )
    spark = values.sparkSession
    ranges = spark.createDataFrame([(n, a, b) for n, (a, b) in profiles.items()], "profile string, a int, b int")
    last = daily.agg(F.max("di").alias("_last"))
    bounds = F.broadcast(ranges.crossJoin(last).select("profile", "a", (F.least(F.coalesce("b", "_last"), F.col("_last")) - ahead).alias("b")))
    part = daily.join(bounds, F.col("di").between(F.col("a"), F.col("b")))
    ir = F.when(F.min("rankic") < F.max("rankic"), F.avg("rankic") / F.stddev_samp("rankic"))
    return part.groupBy("profile").agg(F.avg("ic").alias("ic"), F.avg("rankic").alias("rankic"), ir.alias("rankicir"), F.avg("longret").alias("longret"), F.avg(F.when(F.col("di") > F.col("a"), F.col("turnover"))).alias("turnover"), F.avg("coverage").alias("coverage"), F.count("*").alias("dates"))


def both_sides(values: DataFrame, share: float = 0.2) -> DataFrame:
    """values(di, sym, v, ret): per date the mean return of the lowest and of the highest ranks, how many are high, and how
    much of each side's equal weights is traded against the date before (0 on the first)."""
    df, rank = run_stages(values.select("di", "sym", "v", "ret"), unit_rank(F.col("v"), "di"))
    df = df.withColumn("_r", rank)
    sides = {"low": F.coalesce(F.col("_r") < share, F.lit(False)), "high": F.coalesce(F.col("_r") > 1 - share, F.lit(False))}
    df = df.withColumns({f"_{k}": F.when(s, 1.0).otherwise(0.0) for k, s in sides.items()})
    df = df.withColumns({f"_w{k}": F.coalesce(F.try_divide(F.col(f"_{k}"), F.sum(f"_{k}").over(cs())), F.lit(0.0)) for k in sides})
    df = df.withColumns({f"_d{k}": F.abs(F.col(f"_w{k}") - F.lag(f"_w{k}").over(history())) for k in sides})
    mean = lambda k: F.avg(F.when(F.col(f"_{k}") == 1, F.col("ret")))
    return df.groupBy("di").agg(mean("low").alias("low_ret"), mean("high").alias("high_ret"), F.sum("_high").cast("long").alias("n_high"), *(F.coalesce(F.sum(f"_d{k}"), F.lit(0.0)).alias(f"{k}_trade") for k in sides))


def long_short_fitness(values: DataFrame, share: float = 0.2, year: float = 252.0, clip: float | None = None) -> DataFrame:
    """One row: the information ratio a year of high less low ranks, whichever way round is better; 0 without spread."""
    spread = F.col("high_ret") - F.col("low_ret")
    spread = spread if clip is None else F.when(spread.isNotNull(), F.greatest(F.least(spread, F.lit(clip)), F.lit(-clip)))
    daily = both_sides(values, share).select(spread.alias("s"))
    return daily.agg(F.coalesce(F.abs(F.when(F.min("s") < F.max("s"), F.avg("s") / F.stddev_samp("s") * year**0.5)), F.lit(0.0)).alias("ir"), F.count("s").alias("dates"))


def group_summary(groups: DataFrame) -> DataFrame:
    """groups(di, bucket, ret): per bucket the mean return and the whole compounded one; a missing return compounds as 0."""
    return groups.groupBy("bucket").agg(F.avg("ret").alias("mean_return"), (F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0))))) - 1).alias("final_return"))


# What a measure is set against, and by what it is divided, before it is squashed to 0..1.
SCORED = {"long_ret": (0.12, 0.02), "long_netret": (0.07, 0.02), "ls_ir": (2.48, 0.43), "ls_netir": (1.33, 0.43), "rankic": (0.03, 0.0085), "rankicir": (5.58, 1.06), "mono": (0.09, 0.016), "monoir": (0.16, 0.36)}


def score() -> Column:
    """Half the return's side, half the balance of spread, rank correlation and monotonicity; a missing measure counts as 0."""
    part = {k: 1 / (1 + F.exp(-(F.coalesce(F.col(k), F.lit(0.0)) - mid) / width)) for k, (mid, width) in SCORED.items()}
    pair = lambda a, b: (part[a] + part[b]) / 2
    return pair("long_ret", "long_netret") * 0.5 + (pair("ls_ir", "ls_netir") + pair("rankic", "rankicir") + pair("mono", "monoir")) / 3 * 0.5


def timing_performance(series: DataFrame, n_groups: int = 10) -> tuple[DataFrame, DataFrame]:
    """series(date, factor, main, aux), a row a period: the correlation of the period before's factor with aux less main, by
    year and over all (year NULL), and the mean difference by group of the factor's rank (ties by date). A row a period
    meets in one task."""
    w = Window.orderBy("date")
    df = series.select("date", F.lag("factor").over(w).alias("f"), (F.col("aux") - F.col("main")).alias("d")).where("f IS NOT NULL AND d IS NOT NULL")
    ic = df.rollup(F.year("date").alias("year")).agg(safe_corr(F.col("f"), F.col("d")).alias("ic"), F.count("*").alias("periods"))
    n = F.count("*").over(Window.partitionBy())
    place = df.select("d", (F.row_number().over(Window.orderBy("f", "date")) - 1).alias("k"), n.alias("n"))
    # equally wide quantile groups of the ranks 1..n: group g holds the ranks up to 1 + (n - 1) * g / groups
    groups = F.least(F.lit(n_groups), F.col("n"))
    group = F.greatest(F.ceil(F.col("k") * groups / F.greatest(F.col("n") - 1, F.lit(1))), F.lit(1)).cast("int")
    return ic, place.groupBy(group.alias("group")).agg(F.avg("d").alias("mean"), F.count("*").alias("periods"))

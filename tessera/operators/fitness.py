"""Fitness of predictions against outcomes, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Weighted Pearson correlation, from weighted sums."""
    ok = x.isNotNull() & y.isNotNull() & w.isNotNull()
    s = lambda e: F.sum(F.when(ok, e))
    sw = F.nullif(s(w), F.lit(0.0))
    mx, my = s(w * x) / sw, s(w * y) / sw
    vx, vy = s(w * x * x) / sw - mx * mx, s(w * y * y) / sw - my * my
    return F.when((vx > 1e-15) & (vy > 1e-15), (s(w * x * y) / sw - mx * my) / F.sqrt(F.when(vx > 1e-15, vx) * F.when(vy > 1e-15, vy)))


def errors(y: Column, p: Column, w: Column) -> dict[str, Column]:
    """Weighted mean absolute, mean squared and root mean squared error."""
    ok = y.isNotNull() & p.isNotNull() & w.isNotNull()
    mean = lambda e: F.try_divide(F.sum(F.when(ok, w * e)), F.sum(F.when(ok, w)))
    square = mean((y - p) * (y - p))
    return {"mae": mean(F.abs(y - p)), "mse": square, "rmse": F.sqrt(square)}


def log_loss(y: Column, p: Column, w: Column) -> Column:
    """Weighted loss of probabilities p for outcomes y in 0, 1."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    ok = y.isNotNull() & p.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(ok, -w * (y * F.ln(q) + (1 - y) * F.ln(1 - q)))), F.sum(F.when(ok, w)))


def scores(df: DataFrame, by: str, y: str, p: str, w: str) -> DataFrame:
    """Per group: weighted Pearson and Spearman (average ranks) correlation and the errors."""
    average = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(w).isNotNull()).withColumns({"_ry": average(y), "_rp": average(p)})
    return known.groupBy(by).agg(weighted_corr(F.col(y), F.col(p), F.col(w)).alias("pearson"), weighted_corr(F.col("_ry"), F.col("_rp"), F.col(w)).alias("spearman"), *(c.alias(k) for k, c in errors(F.col(y), F.col(p), F.col(w)).items()))


def monotonicity(buckets: DataFrame, by: str, bucket: str, value: str) -> DataFrame:
    """Per group the correlation of the bucket's number with its value, and the best bucket."""
    b, v = F.col(bucket).cast("double"), F.col(value)
    varied = (F.min(b) < F.max(b)) & (F.min(v) < F.max(v))
    corr = F.when(varied, F.try_divide(F.covar_samp(b, v), F.stddev_samp(b) * F.stddev_samp(v)))
    return buckets.groupBy(by).agg(corr.alias("monotonicity"), F.max(F.struct(v.alias("v"), F.col(bucket).alias("b")))["b"].alias("best"))

"""Quality classification by hierarchical empirical Bayes.

A logistic model over the rule ledger's measurements, learnt from a bounded sample of labelled documents, gives each
document its own evidence. The evidence of all documents is summed by host and by host and path; a host's rate is
shrunk toward the global rate and a path's toward its host's, with strengths fitted from the rates' spread (method of
moments), so that sites with few documents keep to the level above. A document's posterior joins its evidence with the
rate of its path, its own share left out.

Defined results: a null text is empty; null hosts or paths are sites of their own, one with the empty ones; repeated rows count and are judged
each on its own; labels that are null are not learnt from; without labels of both kinds the evidence is even (0.5) and
every document is kept; an empty table gives no rows; further columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .quality_rules import measured
from .shared import written

#: Labelled documents learnt from, at most: those with the least hash of the id.
SAMPLE = 6000
#: Documents go only where their posterior of good quality is below this: losing a clean one costs more than a bad one.
THRESHOLD = 0.05
#: Rejected documents whose keys are broadcast at most, when documents are filtered.
BROADCAST_KEYS = 500_000
#: Sites whose rates are broadcast at most; parts of a site's documents beyond that.
BROADCAST_SITES, SALTS = 200_000, 64

# name: expression over the measurements
FEATURES = {
    "symbols": "sqrt(n_symbols / greatest(word_chars, 1))",
    "bangs": "sqrt(n_bangs / greatest(word_chars, 1))",
    "capitals": "n_upper / greatest(n_upper + n_lower, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "length": "ln(1 + n_words) / 10",
    "word_length": "ln(1 + word_chars / greatest(n_words, 1))",
    "symbols_high": "IF(100 * n_symbols > 5 * word_chars AND n_symbols > 0, 1.0, 0.0)",
    "bangs_high": "IF(100 * n_bangs > 5 * word_chars AND n_bangs > 0, 1.0, 0.0)",
    "repeats_high": "IF(n_repeat_words > 0.4 * n_words AND n_words > 0, 1.0, 0.0)",
}


def fit_evidence(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model by damped Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.diag([l2] * x.shape[1] + [1e-9]) * len(x) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + ridge @ w
        h = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + ridge
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def evidence(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, key (hash of the text), host, path, p (the document's own probability of good quality); written."""
    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    shaped = shaped.withColumn("key", F.xxhash64("text"))
    rows = measured(shaped, ("doc_id", "key", "host", "path")).select("doc_id", "key", "host", "path", *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()))
    rows = written(rows, "measured")
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(SAMPLE)
    # one row for each label, so that rows which repeat an id leave the sample's bound
    told = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min_by(F.struct(*FEATURES), F.struct("key", "host", "path")).alias("x"))
    told = told.select("y", "x.*").toPandas().sort_values(["y", *FEATURES])
    y = (told["y"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        x = told[list(FEATURES)].to_numpy(float)
        mean, spread = x.mean(0), x.std(0) + 1e-6
        w, b = fit_evidence((x - mean) / spread, y)
        w, b = w / spread, b - float((w * mean / spread).sum())
        z = sum((F.col(n) * F.lit(float(k)) for n, k in zip(FEATURES, w)), F.lit(b))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(15.0)), F.lit(-15.0))))
    else:
        p = F.lit(0.5)
    return rows.select("doc_id", "key", "host", "path", p.alias("p"))


def _strength(sites: DataFrame, rate: Column, above: Column) -> float:
    """Pseudo-documents of the level above: within-site variance over between-site variance, from grouped sums."""
    gap, n = rate - above, F.col("n")
    got = sites.where("n > 1").agg(F.sum(n * gap * gap).alias("spread"), F.sum(above * (1 - above)).alias("noise"), F.sum(n).alias("n"), F.sum(n * above * (1 - above)).alias("within"), F.count("*").alias("sites")).first()
    if not got.sites or not got.n:
        return 10.0
    between = max((got.spread - got.noise) / got.n, 1e-6)
    return float(min(max((got.within / got.n) / between, 2.0), 1000.0))


def site_rates(found: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, s, host_rate, host_strength, path_strength), and the global rate. One row for each path."""
    paths = written(found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = float(((whole.s or 0.0) + 0.5) / ((whole.n or 0) + 1))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k1 = _strength(hosts, F.col("s") / F.col("n"), F.lit(base))
    hosts = hosts.select("host", ((F.col("s") + k1 * base) / (F.col("n") + k1)).alias("host_rate"))
    joined = paths.join(hosts, "host")
    k2 = _strength(joined, F.col("s") / F.col("n"), F.col("host_rate"))
    return joined.withColumn("strength", F.lit(k2)), base


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, key, host, path, evidence, host_rate, path_rate, score (posterior probability of good quality), kept."""
    found = evidence(docs, labels, host, path)
    sites, base = site_rates(found)
    # the path's rate without the document itself
    rate = (F.col("s") - F.col("p") + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    sites = written(sites, "sites")
    if sites.count() <= BROADCAST_SITES:
        out = found.join(F.broadcast(sites), ["host", "path"])
    else:  # a site may hold a third of all documents: they are dealt to SALTS parts, its one row to each of them
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    out = out.withColumn("path_rate", rate)
    posterior = 1 / (1 + F.exp(-(_logit(F.col("p")) - _logit(F.lit(base)) + _logit(F.col("path_rate")))))
    return out.select("doc_id", "key", "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", posterior.alias("score"), (posterior >= THRESHOLD).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """docs without those judged of bad quality; columns as in docs."""
    bad = written(judged(docs, labels, host, path).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "rejected")
    few = bad.count() <= BROADCAST_KEYS
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_key"])
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")

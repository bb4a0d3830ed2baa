"""Vector search and graph neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import written_table


#: Queries and rows compared with each other at a time; both bound what a worker holds besides its block of queries.
AT_ONCE, ROWS = 512, 2048


def _near(queries, k: int, least: float):
    """qid, id, similarity: of each piece of rows what may be among a query's k best of all seen so far by the task, ties
    for the last place included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries.value
        best = np.full((len(qid), k), -np.inf)
        for piece in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            ids, v = piece.column(0).to_numpy(), piece.column(1)
            m = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            norm = np.sqrt((m * m).sum(1))
            m, ids = m[norm > 0] / norm[norm > 0, None], ids[norm > 0]
            for at in range(0, len(qid) if len(ids) else 0, AT_ONCE):
                some = slice(at, at + AT_ONCE)
                s = np.round(q[some] @ m.T, 12)  # so that equal vectors are ties whatever their place in a batch
                s[(qid[some, None] == ids) | ~(s > least)] = -np.inf
                best[some] = np.partition(np.concatenate([best[some], s], axis=1), -k, axis=1)[:, -k:]
                row, column = np.nonzero((s >= best[some].min(1)[:, None]) & (s > -np.inf))
                if len(row):
                    yield pa.record_batch({"qid": qid[some][row], "id": ids[column], "similarity": s[row, column]})

    return run


def top_k(queries: DataFrame, base: DataFrame, k: int = 5, least: float = 0.0, queries_bytes: int = 16 << 20) -> DataFrame:
    """queries(qid, v), base(id, v): per query the k most similar base rows by cosine above least: qid, id, similarity,
    rank; vectors of other lengths, without length or with missing values are near to none. The stated query set goes to
    the tasks in blocks of bounded bytes; each batch of the base sends on only what may be among a query's best, so what
    is shuffled does not grow with the product of both sides."""
    spark = queries.sparkSession
    vector = lambda c: F.col(c).cast("array<double>")
    whole = lambda c: (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    q = queries.select(F.col("qid").cast("long"), vector("v").alias("v")).where(whole("v"))
    b = base.select(F.col("id").cast("long"), vector("v").alias("v")).where(whole("v"))
    sizes = q.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    out = spark.createDataFrame([], "qid long, id long, similarity double")
    for d, n in sizes:
        blocks = -(-n * (8 * d + 8) // queries_bytes)
        for i in range(blocks):
            some = q.where((F.size("v") == d) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)).toArrow()
            m = some["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
            norm = np.sqrt((m * m).sum(1))
            sent = spark.sparkContext.broadcast((some["qid"].to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0, None]))
            out = out.unionByName(b.where(F.size("v") == d).mapInArrow(_near(sent, k, least), "qid long, id long, similarity double"))
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within_steps(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """edges(a, b) both ways, start(node): nodes reached in at most so many steps, with the least number of steps.

    A step only asks which edges leave its front, so repeated edges cost nothing and the edges are never gathered. Each
    front is a table: the next step knows its size, sends it to the edges if it is small, and doesn't make it again."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = front = written_table(start.select("node", F.lit(0).alias("steps")).distinct(), "front")
    for k in range(1, steps + 1):
        reached = both.join(front.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        front = written_table(reached.join(seen, "node", "left_anti").withColumn("steps", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen


def _unit(column: pa.ListArray) -> np.ndarray:
    m = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    norm = np.sqrt((m * m).sum(1))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


def _nearest(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the most similar centres, and how similar; so rounded that equal vectors are alike in any batch."""
    s = np.round(m @ centres.T, 12)
    best = s.argmax(1)
    return best, s[np.arange(len(m)), best]


def spherical_kmeans(vectors: DataFrame, k: int = 20, rounds: int = 100, seed: int = 42) -> DataFrame:
    """vectors(id, v) to id, cluster, similarity: k-means by the cosine. The first centres are the k vectors whose ids come
    first by md5 of seed and id; a round assigns each vector to the most similar centre (the lower number among equals)
    and takes the unit mean of each cluster; an empty cluster keeps its centre; it ends when no centre moves, or after so
    many rounds. Rows without a vector are left out; a vector of zeros is as near to all, so it goes to cluster 0.

    The centres, k rows, are all that goes to the tasks and all that comes back: sums are made within each partition and
    then added by cluster and place."""
    spark = vectors.sparkSession
    rows = vectors.where("v IS NOT NULL").select("id", "v")
    first = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(k).select("v").toArrow()
    if not len(first):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity"))
    centres = _unit(first.column(0).combine_chunks())

    def sums(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total, n = np.zeros(now.shape), np.zeros(len(now), np.int64)
            for batch in batches:
                if batch.num_rows:
                    m = _unit(batch.column(0))
                    best, _ = _nearest(m, now)
                    np.add.at(total, best, m)
                    n += np.bincount(best, minlength=len(now))
            c, d = np.indices(now.shape)
            some = n[c.ravel()] > 0
            yield pa.record_batch({"c": pa.array(c.ravel()[some], pa.int32()), "d": pa.array(d.ravel()[some], pa.int32()), "s": pa.array(total.ravel()[some])})

        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)
        found = rows.select("v").mapInArrow(sums(shared), "c int, d int, s double").groupBy("c", "d").agg(F.sum("s").alias("s")).toArrow()
        total = np.zeros(centres.shape)
        c = found["c"].to_numpy()
        total[c, found["d"].to_numpy()] = found["s"].to_numpy()
        norm = np.sqrt((total * total).sum(1))
        moved = np.where((norm > 0)[:, None], total / np.where(norm > 0, norm, 1.0)[:, None], centres)
        shared.destroy()
        if np.allclose(centres, moved):
            break
        centres = moved

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, near = _nearest(_unit(batch.column(1)), centres) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.record_batch({"id": batch.column(0), "cluster": pa.array(best, pa.int32()), "similarity": pa.array(near)})

    return rows.mapInArrow(assigned, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, similarity double")

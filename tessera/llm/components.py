"""Connected components by repeated contraction, in joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) to (node, root) for every node that has an edge to another; root is one node of its component.

    Each round sends a node to the least of itself and its neighbours, follows these pointers four steps, and maps the
    edges to where they lead; edges inside a component vanish and parallel ones merge, so the graph at least halves.
    Every round is written, so lineage stays short. Minima are combined before the shuffle, so a node with very many
    edges costs no task more than its share.
    """
    spark = edges.sparkSession
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    levels: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root"))
        up = written(up, "pointers")
        for _ in range(2):
            far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            up = up.join(far, "root").select("node", F.col("far").alias("root"))
        up = written(up, "level")
        levels.append(up)
        a, b = up.select(F.col("node").alias("u"), F.col("root").alias("ru")), up.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        now = written(now.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
    if not levels:
        return spark.createDataFrame([], "node long, root long")
    out = levels[0]
    for up in levels[1:]:
        out = out.join(up.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    return out

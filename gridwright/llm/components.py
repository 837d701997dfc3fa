"""Connected components of an edge table, by alternating large-star and small-star steps.

Hubs' minima are aggregated and joined back, so no task gathers a hub's
neighbours; every round is stored in the shared folder.  The number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridwright.llm.common import materialize


def _small(e: DataFrame) -> DataFrame:
    """Small star: a node's smaller neighbours, and itself, join the least of them.

    A node has few smaller neighbours (at most one for each band and pair of
    blocks that it was compared in), so a window is enough and no join is needed.
    """
    m = F.min("v").over(Window.partitionBy("u"))
    kept = e.withColumn("m", m).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return kept.distinct()


def _large(e: DataFrame) -> DataFrame:
    """Large star: a node's larger neighbours join the least of all.  A hub has many, so its minimum is aggregated and joined back."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _stored(e: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges as they are stored, and what tells whether they have changed: summed up while they are written."""
    seen = Observation()
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("u", "v")]
    stored = materialize(e.observe(seen, F.count("*").alias("n"), *sums), "edges")
    return stored, tuple(seen.get[k] for k in ("n", "u", "v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node of its component."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = _stored(e)
    while True:
        e, now = _stored(_large(_small(e)))
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.durable import written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``; a component is named by its least id.

    Alternating large-star and small-star contraction (Kiveris et al., 2014):
    each round is two shuffles of slim rows by vertex, and the number of rounds
    is logarithmic. Every round is a written table, so a lost executor costs no
    earlier round. Loops and repeated edges do no harm; no edges, no rows.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = F.min("b").over(Window.partitionBy("a"))
        starred = large.withColumn("m", least)
        small = starred.select("a", F.col("m").alias("b")).unionByName(starred.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()

"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations (combined before the shuffle) and two joins of the edges with one row
per node, so a hub of any size is split by Spark's skew join; nothing is collected but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v), u > v: connect neighbours with the smallest node around u."""
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = joined.unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of ``edges``; component is the smallest node id reachable.

    Self-links, repeated links and either direction are fine; nulls are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    e, before = written(e, "edges"), None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        e = written(_star(_star(e, True), False), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v"), F.col("v")).distinct())

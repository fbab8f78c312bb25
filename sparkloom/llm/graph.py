"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Each vertex links its larger neighbours to the least vertex around it. The minima are a table of their own, so that the join has a plain exchange on either side and adaptive execution can split a hub."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them; after a large star these are few."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each vertex with an edge to a lesser one has no other edge: then the lesser ends are the roots."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n")).filter("down > 0 and n > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, tag: str, most_rounds: int = 60) -> DataFrame:
    """(id, root) of each vertex of edges (u, v): root is the least vertex of its component. Minima are aggregated before shuffles; each round is a written table."""
    now = scratch.save(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0")
    for k in range(1, most_rounds + 1):
        if _settled(now):
            break
        now = scratch.save(_small_star(_large_star(now, scratch, f"{tag}-least")), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}", f"{tag}-least")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)

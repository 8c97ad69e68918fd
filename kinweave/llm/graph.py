"""Connected components on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links`` (long columns); ``root`` is the smallest node reachable.

    Each round takes the smallest root among a node's neighbours, then the
    root of that root, and writes the table.  It ends when no root changed.
    Tables are read back from files, so a hub's rows are split by the
    adaptive skew join.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = stored(one.union(one.select("v", "u")).distinct())
    roots = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("root")))
    last = _sum(roots)
    while last is not None:
        near = both.join(roots, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "root")
        step = stored(near.union(roots).groupBy("node").agg(F.min("root").alias("root")))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = stored(step.join(up, "root").select("node", F.col("top").alias("root")))
        now = _sum(roots)
        if now == last:
            break
        last = now
    return roots


def _sum(roots: DataFrame):
    """Roots only get smaller, so an equal sum means that none changed.  None for an empty table."""
    return roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]

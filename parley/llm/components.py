"""Connected components of an edge table, every node labelled with the smallest node it reaches.

Alternating large-star and small-star rounds until the edges stop changing. Each step is one
pre-aggregated minimum and one join of two written tables, so adaptive execution can split a hub's
rows; nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())


def _ordered(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node with an edge to another node; roots map to themselves.

    ``edges`` has two long columns, in any order, repeats and loops allowed. Rows with a null end
    are no edges. An empty table gives no rows.
    """
    a, b = edges.columns[:2]
    now = work.put(edges.where(F.col(a) != F.col(b)).select(*_ordered(F.col(a), F.col(b))).distinct(), "cc0")
    mark, k = _mark(now), 0
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), f"min{k}")
        large = work.put(now.join(least, now.u == least.n).select(F.col("m").alias("u"), "v").distinct(), f"large{k}")
        parent = work.put(large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("p")), f"parent{k}")
        met = large.join(parent, large.v == parent.n)
        small = met.select(F.explode(F.array(F.struct("p", F.col("u").alias("c")), F.struct("p", F.col("v").alias("c")))).alias("e"))
        then = work.put(small.where("e.p != e.c").select(*_ordered(F.col("e.p"), F.col("e.c"))).distinct(), f"cc{k + 1}")
        work.drop(f"cc{k}", f"min{k}", f"large{k}", f"parent{k}")
        now, last, mark, k = then, mark, _mark(then), k + 1
        if mark == last:
            break
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())

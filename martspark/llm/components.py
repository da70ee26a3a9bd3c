"""Connected components of a link table, as rounds of joins over written tables.

Large-star and small-star steps alternate until nothing changes: each node's
larger neighbours, then its smaller ones, are attached to the smallest node it
knows. Every round is one grouping and one join on the node, and its result is a
written table, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.session import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over ``links(a, b)`` with ``a > b``."""
    if large:
        around = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = around.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every linked node with the smallest node of its component.

    ``links(a, b)`` holds one orientable type; self links, repeated links and
    either order are fine, null ends are ignored. Nodes without links are not in
    the result.
    """
    clean = links.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = written(clean, "links")
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = _mark(current)
    while True:
        current = written(_star(_star(current, True), False), "links")
        now = _mark(current)
        if now == mark:
            break
        mark = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    """A digest of the link set: equal marks of two rounds mean that nothing moved."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                           F.bit_xor(F.xxhash64("b", "a"))).first())

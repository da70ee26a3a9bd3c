"""A plane that keeps neighbours: power iteration on the graph of nearest neighbours.

Items become nodes of a graph with an edge to each of their ``k`` nearest neighbours, both
ways, weighted by similarity. The plane's axes are the leading smooth vectors of that graph: from the
two main axes of the items on, every step replaces a node's place by its own and its neighbours' weighted
mean, and then takes the constant part and the overlap of the axes out again. Neighbours move
together, which a projection onto fixed axes cannot do.

A step is one join of the edge table with the places and one grouping by node. Edges per node are
bounded on the way out only: a node that very many name as neighbour is a hot key, whose
partial sums are combined before the shuffle. Places are written every few steps; what reaches the
driver is one row of five sums per step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.session import written

NEIGHBOURS, STEPS, STEPS_PER_WRITE = 10, 24, 4


def neighbour_edges(neighbours: DataFrame) -> DataFrame:
    """``a, b, weight`` in both directions from ``query_id, item_id, similarity``; pairs that name each other count once."""
    weight = F.greatest((F.col("similarity") + 1) / 2, F.lit(1e-6))
    one = neighbours.filter(F.col("query_id") != F.col("item_id")).select(
        F.col("query_id").alias("a"), F.col("item_id").alias("b"), weight.alias("weight"))
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(
        F.max("weight").alias("weight"))


def _turned(places: DataFrame) -> DataFrame:
    """Places with weighted mean zero, unit spread and no overlap of the axes."""
    d, x, y = F.col("degree"), F.col("x"), F.col("y")
    s = places.agg(F.sum(d).alias("d"), F.sum(d * x).alias("x"), F.sum(d * y).alias("y"), F.sum(d * x * x).alias("xx"),
                   F.sum(d * x * y).alias("xy"), F.sum(d * y * y).alias("yy")).first()
    if not s.d:
        return places
    mx, my = s.x / s.d, s.y / s.d
    spread = np.array([[s.xx / s.d - mx * mx, s.xy / s.d - mx * my], [s.xy / s.d - mx * my, s.yy / s.d - my * my]])
    size, turn = np.linalg.eigh(spread)
    turn = turn[:, ::-1] / np.sqrt(np.maximum(size[::-1], 1e-18))
    new = [sum((F.lit(float(turn[i, j])) * (c - F.lit(float(m))) for i, (c, m) in enumerate(((x, mx), (y, my)))), F.lit(0.0))
           for j in range(2)]
    return places.select("id", "degree", new[0].alias("x"), new[1].alias("y"))


def neighbour_plane(start: DataFrame, neighbours: DataFrame, steps: int = STEPS) -> DataFrame:
    """``id, x, y`` for the items of ``start(id, x, y)``, whose axes are where the iteration begins.

    An item without neighbours stays where the turned start puts it; ids are distinct and not
    null. An empty table gives no place.
    """
    edges = written(neighbour_edges(neighbours), "neighbour-edges")
    degrees = edges.groupBy("a").agg(F.sum("weight").alias("degree"))
    places = written(start.join(degrees, F.col("id") == F.col("a"), "left").select(
        "id", F.coalesce("degree", F.lit(1.0)).alias("degree"), F.col("x").cast("double"), F.col("y").cast("double")), "places")
    places = _turned(places)
    for step in range(steps):
        around = edges.join(places.select(F.col("id").alias("b"), "x", "y"), "b").groupBy("a").agg(
            F.sum(F.col("weight") * F.col("x")).alias("_x"), F.sum(F.col("weight") * F.col("y")).alias("_y"))
        moved = places.join(around, F.col("id") == F.col("a"), "left").select(
            "id", "degree", *(((F.col(c) + F.coalesce(F.col(f"_{c}") / F.col("degree"), F.col(c))) / 2).alias(c) for c in ("x", "y")))
        places = written(moved, "places")  # the turn below and the next step's two sides read it
        if step % STEPS_PER_WRITE == STEPS_PER_WRITE - 1 or step == steps - 1:
            places = _turned(places)
    return places.select("id", "x", "y")


def kept_neighbours(flat: DataFrame, neighbours: DataFrame, near, k: int = NEIGHBOURS) -> DataFrame:
    """One row: neighbours in the full space, and how many are among the ``k`` nearest on the plane.

    ``near(queries, corpus, k)`` gives the ``k`` most similar by cosine; points are lifted onto a
    sphere, where the order of cosines is nearly that of distances on the plane.
    """
    spread = flat.agg(F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    size = 20 * max(spread.x or 0.0, spread.y or 0.0, 1e-9)  # the plane is a small patch of the sphere
    x, y = F.col("x") / size, F.col("y") / size
    lifted = flat.select(F.col("id").alias("item_id"), F.array(2 * x, 2 * y, 1 - x * x - y * y).alias("vector"))
    found = near(lifted.withColumnRenamed("item_id", "query_id"), lifted, k).select("query_id", "item_id", F.lit(1).alias("_kept"))
    return neighbours.select("query_id", "item_id").join(found, ["query_id", "item_id"], "left").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("_kept").alias("kept"))

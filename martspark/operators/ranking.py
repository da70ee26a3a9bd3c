"""Global order positions, ranks and quantiles without sending all rows to one task.

A window without a partition key sorts the whole table in a single task. Here
Spark range-partitions the rows by the sort key, each partition is ordered on
its own, and the number of rows in lower partitions is added as an offset.

The sorted rows are written to the shared folder together with their range and
their place in it: the offsets must see the same boundaries, also when a lost task
is run again, and row numbers need no second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.session import written

_PART, _PLACE, _COUNT, _BEFORE = "_part", "_place", "_rows", "_rows_before"


def _named(order: list[Column]) -> dict[str, Column]:
    return {f"_k{i}": column for i, column in enumerate(order)}


def descending(value: Column) -> list[Column]:
    """Ascending order columns equal to ``value DESC NULLS LAST`` for a number."""
    return [value.isNull(), -value]


def _in_ranges(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows with the number of their key range; equal keys always share one."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    # No number of ranges is given, so Spark chooses it from the size of the rows at run time.
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # The high bits of the id are the range, the low bits the place in it.
    return written(placed.withColumns({
        _PART: F.shiftright("_id", 33), _PLACE: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), label)


def _with_rows_before(ranged: DataFrame, rows: Column) -> DataFrame:
    """Add the number of rows in all lower ranges; there is one sum per range to broadcast."""
    totals = ranged.groupBy(_PART).agg(F.sum(rows).alias("_total"))
    lower = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, F.coalesce(F.sum("_total").over(lower), F.lit(0)).alias(_BEFORE))
    return ranged.join(F.broadcast(offsets), _PART)


def _inside(keys: list[str]) -> Window:
    return Window.partitionBy(_PART).orderBy(*[F.col(k).asc_nulls_first() for k in keys])


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 1-based position of every row in the order of ``order``.

    ``order`` should identify a row; rows that tie on all of it are numbered in
    an arbitrary order, as ``row_number`` does.
    """
    keys = _named(order)
    placed = _with_rows_before(_in_ranges(df.withColumns(keys), list(keys), "row-numbers"), F.lit(1))
    position = F.col(_BEFORE) + F.col(_PLACE) + 1
    return placed.withColumn(name, position.cast("bigint")).drop(*keys, _PART, _PLACE, _BEFORE)


def _first_positions(counts: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct keys with their row count and the number of rows before the first of them."""
    placed = _with_rows_before(_in_ranges(counts, keys, label), F.col(_COUNT))
    lower = _inside(keys).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col(_BEFORE) + F.coalesce(F.sum(_COUNT).over(lower), F.lit(0))
    return placed.select(*keys, _COUNT, first.alias("_first"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``rank()`` over the whole table in the order of ``order``.

    Rows are counted per distinct key first, so however many rows tie on one key
    they reach the ordering step as a single row, and the ranks are joined back.
    """
    keys = _named(order)
    keyed = df.withColumns(keys)
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias(_COUNT))
    ranks = _first_positions(counts, list(keys), "ranks").select(
        *[F.col(k).alias(f"_r{k}") for k in keys], (F.col("_first") + 1).cast("bigint").alias(name)
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return keyed.join(ranks, same).drop(*keys, *[f"_r{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: Column, quantiles: dict[str, float]) -> DataFrame:
    """One row of exact quantiles, linearly interpolated between neighbouring rows.

    The built-in exact percentile keeps every distinct value in one aggregation
    buffer. Here values are counted and placed in distributed ranges, and only
    the values at the wanted positions reach the final row.
    """
    present = df.select(value.alias("_k0")).filter(F.col("_k0").isNotNull())
    counts = present.groupBy("_k0").agg(F.count(F.lit(1)).alias(_COUNT))
    placed = _first_positions(counts, ["_k0"], "quantiles")
    total = placed.agg(F.sum(_COUNT))
    positions = placed.withColumn("_n", total.scalar())
    at = lambda place: F.max(F.when((F.col("_first") <= place) & (place < F.col("_first") + F.col(_COUNT)), F.col("_k0")))
    edges = {}
    for name, q in quantiles.items():
        place = (F.col("_n") - 1) * F.lit(float(q))
        edges[f"{name}_lo"], edges[f"{name}_hi"] = at(F.floor(place)), at(F.ceil(place))
        edges[f"{name}_part"] = F.max(place - F.floor(place))
    picked = positions.agg(*[c.alias(name) for name, c in edges.items()])
    return picked.select(*[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in quantiles
    ])

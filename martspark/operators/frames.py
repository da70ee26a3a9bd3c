"""Trailing row frames over long or uneven groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000

_POSITION, _BLOCK, _HOME, _BEFORE = "_position", "_block", "_home_block", "_rows_before"


def trailing_frames(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_by: Column,
    preceding: int,
    measures: dict[str, Column],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Aggregates over the ``preceding`` rows before each row of a group.

    Equal to ``ROWS BETWEEN preceding PRECEDING AND 1 PRECEDING``, but a group is
    worked on in blocks: rows are numbered inside ``slice_by`` (which must rise
    with ``order``, such as the quarter of a date), a prefix sum over the slice
    counts turns that into a position in the group, and each block of positions
    also receives the last ``preceding`` rows of the block before it. No task
    holds more than one slice or one block of a group.
    """
    if block_rows < preceding:
        raise ValueError(f"block_rows ({block_rows}) must not be below preceding ({preceding}): a frame spans two blocks at most")
    sliced = df.withColumn("_slice", slice_by)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    lower = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_slice").alias("_o_slice"),
        F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias(_BEFORE),
    )
    same = F.col("_slice").eqNullSafe(F.col("_o_slice"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    numbered = (
        sliced.withColumn("_inside", inside)
        .join(offsets, same)
        .withColumn(_POSITION, F.col(_BEFORE) + F.col("_inside") - 1)
        .withColumn(_HOME, F.floor(F.col(_POSITION) / block_rows))
        .drop("_slice", "_inside", "_o_slice", _BEFORE, *[f"_o_{k}" for k in keys])
    )
    is_tail = F.col(_POSITION) % block_rows >= block_rows - preceding
    targets = F.when(is_tail, F.array(F.col(_HOME), F.col(_HOME) + 1)).otherwise(F.array(F.col(_HOME)))
    frame = Window.partitionBy(*keys, _BLOCK).orderBy(_POSITION).rowsBetween(-preceding, -1)
    framed = numbered.withColumn(_BLOCK, F.explode(targets)).select(
        "*", *[measure.over(frame).alias(name) for name, measure in measures.items()]
    )
    return framed.filter(F.col(_BLOCK) == F.col(_HOME)).drop(_BLOCK, _HOME, _POSITION)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"

# The separators of the word contract: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as one struct ``_row`` beside freshly computed columns.

    Input columns of any name can then not clash with an operator's own.
    """
    return df.select(F.struct(*(F.col(f"`{name}`") for name in df.columns)).alias(ROW),
                     *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """Back to the input's own columns."""
    return df.select(*(F.col(f"{ROW}.`{name}`").alias(name) for name in names))


def batches(frame_iterator):
    """Arrow batches that hold rows."""
    return (batch for batch in frame_iterator if batch.num_rows)

"""Vector arithmetic over ``array`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit_vector(vector: Column) -> Column:
    """Vector divided by its length; the length is floored so a zero vector stays zero.

    An expression inside a lambda is computed again for every element. The length is therefore
    bound first, as the only element of an outer array: work grows with the width, not with its square.
    """
    length = F.greatest(l2_norm(vector), F.lit(NORM_FLOOR))
    return F.transform(F.array(length), lambda bound: F.transform(vector, lambda x: x.cast("double") / bound))[0]

"""Profiling reports, each a single distributed aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.functions.calendar import weekday_label
from martspark.operators.ranking import exact_quantiles


def null_report(df: DataFrame) -> DataFrame:
    """Missing values and their percentage per column, from one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"),
            (F.col(f"n{i}") / F.nullif(F.col("_n"), F.lit(0)) * 100).alias("null_pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*rows)))


def describe(df: DataFrame, value: Column) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of one number."""
    number = df.select(value.cast("double").alias("v"))
    quartiles = exact_quantiles(number, F.col("v"), {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select(
        F.struct("p25", "p50", "p75")
    )
    basic = number.agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return basic.withColumn("_q", quartiles.scalar()).select("count", "mean", "std", "min", "_q.*", "max")


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; equal counts are ordered by value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.orderBy(F.desc("rows"), "value").limit(k)


def clipped_histogram(df: DataFrame, value: Column, upper: float, bins: int = 50) -> DataFrame:
    """Equal-width histogram from the minimum to the maximum after clipping at ``upper``."""
    clipped = df.select(F.least(value.cast("double"), F.lit(float(upper))).alias("v")).filter(F.col("v").isNotNull())
    bounds = clipped.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")))
    placed = clipped.withColumn("_b", bounds.scalar())
    width = F.nullif(F.col("_b.hi") - F.col("_b.lo"), F.lit(0.0))
    bin_no = F.least(F.floor(F.coalesce((F.col("v") - F.col("_b.lo")) / width, F.lit(0.0)) * bins), F.lit(bins - 1))
    return placed.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def invalid_invoices(raw: DataFrame) -> DataFrame:
    """Counts of unusable quantities, prices and invoices, with the number of codes."""
    return raw.agg(
        F.count_if(F.col("Quantity") < 0).alias("negative_quantities"),
        F.count_if(F.col("Quantity") == 0).alias("zero_quantities"),
        F.count_if(F.col("Price") < 0).alias("negative_prices"),
        F.count_if(F.col("Price") == 0).alias("zero_prices"),
        F.count_if(F.col("Invoice").startswith("C")).alias("cancelled"),
        F.countDistinct("StockCode").alias("stock_codes"),
    )


def non_product_codes(raw: DataFrame, k: int = 15) -> DataFrame:
    """Most frequent codes that do not begin with five digits."""
    return value_counts(raw.filter(~F.col("StockCode").rlike("^[0-9]{5}")), "StockCode", k)


def cleaning_estimate(raw: DataFrame) -> DataFrame:
    """Rows that every cleaning rule keeps, each rule taken as its own condition."""
    keep = (
        F.col("Customer ID").isNotNull()
        & (F.col("Quantity") > 0)
        & (F.col("Price") > 0)
        & ~F.col("Invoice").startswith("C")
        & F.col("StockCode").rlike("^[0-9]{5}")
        & F.col("Description").isNotNull()
    )
    return raw.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(keep).alias("rows_after"))


def zero_share(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.avg((F.col(column) == 0).cast("double")) * 100).alias("zero_pct"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def size_thresholds(sizes: DataFrame, many: int = 10) -> DataFrame:
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("size") == 1).alias("single"),
        F.count_if(F.col("size") >= many).alias("many"), F.avg("size").alias("mean_size"),
    )


def orders_by_hour(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_hour_of_day").agg(F.count(F.lit(1)).alias("orders"))


def orders_by_weekday(orders: DataFrame) -> DataFrame:
    return orders.groupBy(weekday_label(F.col("order_dow")).alias("weekday")).agg(F.count(F.lit(1)).alias("orders"))


def text_profile(df: DataFrame, text: str, key: str, sample_chars: int = 100) -> DataFrame:
    """Non-missing texts, their mean length and the start of the first one by key."""
    kept = df.filter(F.col(text).isNotNull())
    return kept.agg(
        F.count(F.lit(1)).alias("non_null"), F.avg(F.length(text)).alias("mean_length"),
        F.min_by(F.substring(text, 1, sample_chars), key).alias("sample"),
    )


def benefit_days(calendar: DataFrame, columns: list[str]) -> DataFrame:
    return calendar.agg(*[F.sum(c).alias(c) for c in columns])


def sampled(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows chosen by a digest of key and seed: the same rows for any file layout."""
    digest = F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return df.withColumn("_d", digest).orderBy("_d").limit(n).drop("_d")

"""Staging layer: typed, renamed projections of the raw tables.

Identifiers are 64-bit, since customer and order numbers outgrow 32 bits on
large data. A column is staged when the raw frame has the columns it is made
from, so a caller may hand in a narrower frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.functions.calendar import day_of_week
from martspark.functions.numeric import nan_to_null


def _typed(raw: DataFrame, columns: list[tuple[str, str, Column]]) -> DataFrame:
    present = set(raw.columns)
    return raw.select(*[expression.alias(name) for name, source, expression in columns if source in present])


def transactions(raw: DataFrame) -> DataFrame:
    stamp = F.col("invoice_date").cast("timestamp")
    return _typed(raw, [
        ("invoice_id", "invoice_id", F.col("invoice_id")),
        ("product_id", "product_id", F.col("product_id")),
        ("product_name", "description", F.col("description")),
        ("quantity", "quantity", F.col("quantity").cast("int")),
        ("invoice_ts", "invoice_date", stamp),
        ("invoice_date", "invoice_date", stamp.cast("date")),
        ("unit_price", "unit_price", F.col("unit_price").cast("double")),
        ("customer_id", "customer_id", F.col("customer_id").cast("bigint")),
        ("country", "country", F.col("country")),
        ("revenue", "revenue", F.col("revenue").cast("double")),
        ("tx_year", "invoice_date", F.year(stamp)),
        ("tx_month", "invoice_date", F.month(stamp)),
        ("tx_hour", "invoice_date", F.hour(stamp)),
        ("tx_dow", "invoice_date", day_of_week(stamp)),
    ])


def sales(raw: DataFrame) -> DataFrame:
    day = F.col("date").cast("date")
    return _typed(raw.filter(F.col("date").isNotNull()), [
        ("sale_id", "id", F.col("id")),
        ("item_id", "item_id", F.col("item_id")),
        ("dept_id", "dept_id", F.col("dept_id")),
        ("cat_id", "cat_id", F.col("cat_id")),
        ("store_id", "store_id", F.col("store_id")),
        ("state_id", "state_id", F.col("state_id")),
        ("sale_date", "date", day),
        ("unit_sales", "unit_sales", F.col("unit_sales").cast("int")),
        ("sell_price", "sell_price", F.col("sell_price").cast("double")),
        ("revenue", "revenue", F.col("revenue").cast("double")),
        ("sale_year", "date", F.year(day)),
        ("sale_month", "date", F.month(day)),
        ("day_of_week", "date", day_of_week(day)),
        ("has_sales", "unit_sales", F.when(F.col("unit_sales") > 0, 1).otherwise(0)),
    ])


def interactions(raw: DataFrame) -> DataFrame:
    return _typed(raw, [
        ("order_id", "order_id", F.col("order_id").cast("bigint")),
        ("user_id", "user_id", F.col("user_id").cast("bigint")),
        ("product_id", "product_id", F.col("product_id").cast("bigint")),
        ("product_name", "product_name", F.col("product_name")),
        ("aisle", "aisle", F.col("aisle")),
        ("department", "department", F.col("department")),
        ("cart_position", "add_to_cart_order", F.col("add_to_cart_order").cast("int")),
        ("is_reorder", "reordered", F.col("reordered").cast("boolean")),
        ("order_number", "order_number", F.col("order_number").cast("int")),
        ("order_dow", "order_dow", F.col("order_dow").cast("int")),
        ("order_hour", "order_hour_of_day", F.col("order_hour_of_day").cast("int")),
        ("days_since_prior_order", "days_since_prior_order", F.col("days_since_prior_order").cast("double")),
    ])


def rating_tier(rating: Column) -> Column:
    """A missing rating counts as poor."""
    return (
        F.when(rating >= 4.5, "excellent").when(rating >= 4.0, "good").when(rating >= 3.0, "average").otherwise("poor")
    )


def discount_tier(percent: Column) -> Column:
    """A missing discount counts as none."""
    return (
        F.when(percent >= 50, "high_discount")
        .when(percent >= 20, "medium_discount")
        .when(percent > 0, "low_discount")
        .otherwise("no_discount")
    )


def products(raw: DataFrame) -> DataFrame:
    rating = nan_to_null(F.col("avg_rating").cast("double"))
    percent = nan_to_null(F.col("discount_pct").cast("double"))
    return _typed(raw.filter(F.col("product_name").isNotNull()), [
        ("product_id", "product_id", F.col("product_id")),
        ("product_name", "product_name", F.col("product_name")),
        ("main_category", "category", F.col("category")),
        ("sub_category", "sub_category", F.col("sub_category")),
        ("rating", "avg_rating", rating),
        ("rating_count", "rating_count", F.col("rating_count").cast("int")),
        ("discount_price", "sale_price", F.col("sale_price").cast("double")),
        ("actual_price", "list_price", F.col("list_price").cast("double")),
        ("discount_pct", "discount_pct", percent),
        ("rating_tier", "avg_rating", rating_tier(rating)),
        ("discount_tier", "discount_pct", discount_tier(percent)),
    ])

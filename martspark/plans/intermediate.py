"""Intermediate layer: aggregates that the marts build on.

Aggregates here combine on the map side first, but for the daily sales. An exact distinct count is
planned by Spark as a de-duplication on (group, counted value) before the count,
so a group that holds much of the table is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lower bound of each score, best first; below all bounds the score is 1.
FREQUENCY_STEPS = [(20, 5), (10, 4), (5, 3), (2, 2)]
MONETARY_STEPS = [(5000, 5), (2000, 4), (1000, 3), (500, 2)]


def daily_store_sales(sales: DataFrame) -> DataFrame:
    """Sales per day, store, department and category.

    A group is one day of one category in a store, so lines are moved to their group at once; a
    de-duplication by item before it would move nearly every line, and then its sums, again.
    """
    group = ["sale_date", "store_id", "state_id", "dept_id", "cat_id"]
    measured = sales.select(*group, "item_id", "unit_sales", "revenue", "sell_price", "has_sales")
    return measured.repartition(*group).groupBy(*group).agg(
        F.countDistinct("item_id").alias("unique_items_sold"),
        F.sum("unit_sales").alias("total_units"),
        F.sum("revenue").alias("total_revenue"),
        F.avg("sell_price").alias("avg_price"),
        F.sum("has_sales").alias("items_with_sales"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def _score(value, steps):
    score = F.lit(1)
    for bound, points in reversed(steps):
        score = F.when(value >= bound, points).otherwise(score)
    return score


def customer_rfm(transactions: DataFrame, frequency_steps=FREQUENCY_STEPS, monetary_steps=MONETARY_STEPS) -> DataFrame:
    """Recency, frequency and money per customer, with scores for the latter two."""
    latest = transactions.agg(F.max("invoice_date"))
    per_customer = transactions.groupBy("customer_id").agg(
        F.max("country").alias("country"),
        F.max("invoice_date").alias("last_purchase_date"),
        F.countDistinct("invoice_id").alias("frequency"),
        F.sum("revenue").alias("monetary_value"),
        F.countDistinct("invoice_date").alias("active_days"),
    )
    return per_customer.select(
        "*",
        F.datediff(latest.scalar(), "last_purchase_date").alias("recency_days"),
        _score(F.col("frequency"), frequency_steps).alias("frequency_score"),
        _score(F.col("monetary_value"), monetary_steps).alias("monetary_score"),
    )


def user_product_interactions(interactions: DataFrame) -> DataFrame:
    """Per user and product: orders, reorders and an implicit feedback score."""
    pairs = interactions.groupBy("user_id", "product_id", "product_name", "department", "aisle").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum(F.when(F.col("is_reorder"), 1).otherwise(0)).alias("reorder_count"),
        F.min("order_number").alias("first_order_number"),
        F.max("order_number").alias("last_order_number"),
        F.avg("cart_position").alias("avg_cart_position"),
    )
    score = F.log1p("total_orders") + 0.5 * F.log1p("reorder_count")
    return pairs.withColumn("interaction_score", score)

"""Transaction feed: enrichment, alerts and summaries, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.operators.ranking import descending, global_row_number
from martspark.session import written

TOP_SELLER_RANK = 100
VOLUME_FACTOR = 5
MIN_ALERT_QUANTITY = 10
REVENUE_LIMIT = 500

# Label of each alert type, and the label of any other type.
ALERT_LABELS = {"high_volume_order": "⚠️  INVENTORY", "high_value_transaction": "💰 REVENUE"}
OTHER_ALERT_LABEL = "🔔 ALERT"


def product_lookup(transactions: DataFrame) -> DataFrame:
    """Per product: name, totals and its place by revenue (product id breaks ties).

    Written once, as numbering reads the totals more than once and a stream reads
    the lookup in every batch.
    """
    totals = written(
        transactions.groupBy("product_id").agg(
            F.max("product_name").alias("product_name"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("quantity").alias("total_units_sold"),
        ),
        "lookup-totals",
    )
    order = [*descending(F.round("total_revenue", 4)), F.col("product_id")]
    return global_row_number(totals, order, "revenue_rank")


def feed_events(transactions: DataFrame) -> DataFrame:
    """Transactions as feed messages; rows without customer or product are not sent."""
    return transactions.dropna(subset=["customer_id", "product_id"]).select(
        F.col("invoice_id").cast("string").alias("txn_id"),
        "customer_id",
        "product_id",
        F.col("product_name").alias("description"),
        "quantity",
        "unit_price",
        "revenue",
        "country",
        F.col("invoice_ts").alias("timestamp"),
    )


def enrich(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add category, revenue rank and the top-seller flag; unknown products get defaults.

    Whether the lookup is broadcast is left to its size. The totals that the
    volume alert needs stay on the row.
    """
    facts = lookup.select(
        "product_id", F.col("product_name").alias("_name"), F.col("revenue_rank").alias("_rank"),
        F.col("total_units_sold").alias("_units"),
    )
    return events.join(facts, "product_id", "left").select(
        *events.columns,
        F.when(F.col("_rank").isNotNull(), F.coalesce("_name", F.lit("None"))).otherwise("unknown").alias("category"),
        F.coalesce("_rank", F.lit(-1)).alias("revenue_rank"),
        F.coalesce(F.col("_rank") <= TOP_SELLER_RANK, F.lit(False)).alias("is_top_seller"),
        F.col("_units").alias("product_units"),
    )


def enriched_messages(enriched: DataFrame) -> DataFrame:
    return enriched.drop("product_units")


def inventory_alerts(enriched: DataFrame, min_quantity: int = MIN_ALERT_QUANTITY, factor: float = VOLUME_FACTOR) -> DataFrame:
    """Large orders of known products: more than ``factor`` times units sold per rank."""
    usual = F.col("product_units") / F.greatest(F.col("revenue_rank"), F.lit(1))
    limit = usual * factor
    known = F.col("revenue_rank") != -1
    return enriched.filter(known & (F.col("quantity") >= min_quantity) & (F.col("quantity") > limit)).select(
        F.lit("high_volume_order").alias("alert_type"),
        F.col("country").alias("store_id"),
        "product_id",
        "quantity",
        F.bround(limit, 1).alias("threshold"),
        "timestamp",
    )


def revenue_alerts(enriched: DataFrame, limit: float = REVENUE_LIMIT) -> DataFrame:
    """Single transactions above the revenue limit."""
    return enriched.filter(F.col("revenue") > limit).select(
        F.lit("high_value_transaction").alias("alert_type"), "txn_id", "customer_id", "revenue", "product_id", "timestamp"
    )


def labelled_alerts(inventory: DataFrame, revenue: DataFrame) -> DataFrame:
    """Both alert streams in one frame with topic and label."""
    both = inventory.withColumn("topic", F.lit("alerts.inventory")).unionByName(
        revenue.withColumn("topic", F.lit("alerts.revenue")), allowMissingColumns=True
    )
    label = F.lit(OTHER_ALERT_LABEL)
    for kind, text in ALERT_LABELS.items():
        label = F.when(F.col("alert_type") == kind, text).otherwise(label)
    return both.withColumn("label", label)


def tail(messages: DataFrame, n: int, *offset: str) -> DataFrame:
    """The last ``n`` messages by offset columns."""
    return messages.orderBy(*[F.desc_nulls_last(c) for c in offset]).limit(n)


def feed_totals(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("revenue").alias("total_revenue"),
        F.countDistinct("product_id").alias("unique_products"),
        F.count_if("is_top_seller").alias("top_seller_hits"),
    )


def seller_mix(messages: DataFrame) -> DataFrame:
    """Number and share of top-seller and other messages."""
    total = messages.agg(F.count(F.lit(1)))
    return messages.groupBy("is_top_seller").agg(F.count(F.lit(1)).alias("messages")).select(
        F.when(F.col("is_top_seller"), "Top Seller").otherwise("Standard").alias("label"),
        "messages",
        (F.col("messages") / total.scalar()).alias("share"),
    )
